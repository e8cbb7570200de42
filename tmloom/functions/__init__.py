"""See the package docstring of tmloom."""
