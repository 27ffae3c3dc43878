"""Queries over the given tables, one per operator, with the SQL to compare."""

from checks import (  # noqa: F401
    q_bins,
    q_items,
    q_joins,
    q_metrics,
    q_plans,
    q_scoring,
    q_sources,
    q_streaming,
)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
