"""All named queries of the core and their SQL counterparts."""

from __future__ import annotations

from tmloom.plans import matching, problems, reports, retrieval, revisions, texts, workbench

MODULES = (problems, texts, matching, retrieval, reports, revisions, workbench)
FLAGSHIP = "combined_retrieval"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
