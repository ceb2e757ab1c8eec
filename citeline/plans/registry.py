"""All queries of the core engine and their DuckDB oracles, by name."""

from __future__ import annotations

from citeline.plans import (  # noqa: F401  each registers its queries
    catalog_plans,
    chunk_plans,
    context_plans,
    eval_plans,
    extract_plans,
    layout_plans,
    retrieval_plans,
    text_plans,
    verify_plans,
)
from citeline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
