"""The query catalogue: every operator bound to the driver's tables, with its DuckDB twin."""

from __future__ import annotations

from citebase.plans import audits, facts, retrieval, store, web  # noqa: F401  (they register their queries)
from citebase.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
