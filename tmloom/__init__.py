"""tmloom: translation-memory analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame in,
DataFrame out), ``sources`` (readers and writers), ``plans`` (named queries),
``streaming`` and the optional ``llm`` (training-data operators; nothing else
imports it).
"""
