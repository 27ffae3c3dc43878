"""Bin edges and bin lookup.

Edges are literal doubles and are compared one by one in generated code, so a
value on an edge lands exactly where the edge list says.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
UNIFORM_EDGES = tuple(i * 0.05 for i in range(21))
CUSTOM_EDGES = (
    0.0, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 1.0,
)
LOG_EDGES = tuple(float(i) for i in range(11))
BAND_EDGES = (0.0, 0.2, 0.5, 1.0)
BUCKET_EDGES = (0.0, 0.3, 0.5, 0.7, 1.0)
DIFFICULTY_LIMITS = {"easy": 0.3, "medium": 0.6, "hard": 1.0}
HARD_SCORE = 0.7
PER_BIN = 80


def floor_2(score: Column) -> Column:
    """Cut a score to two decimals without rounding."""
    return F.floor(score * 100) / F.lit(100.0)


def is_valid_score(score: Column) -> Column:
    """Numeric and within [0, 1]; null and NaN are not."""
    return F.coalesce(score.between(0.0, 1.0), F.lit(False))


def in_range(value: Column, edges: Sequence[float], last_closed: bool = True) -> Column:
    """Within the outer edges; false for NaN, null for null."""
    first, last = F.lit(float(edges[0])), F.lit(float(edges[-1]))
    return (value >= first) & ((value <= last) if last_closed else (value < last))


def bin_number(value: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """0-based bin of a value that is within the edges.

    Filter with :func:`in_range` and number afterwards: a filter on the number
    itself would be pushed down and repeat the value once per edge.
    """
    inner = [F.lit(float(e)) for e in edges[1:-1]]
    if closed == "left":
        passed = [value >= e for e in inner]
    elif closed == "right":
        passed = [value > e for e in inner]
    else:
        raise ValueError("closed must be 'left' or 'right'")
    return reduce(lambda a, b: a + b, [p.cast("int") for p in passed], F.lit(0))


def bin_index(
    value: Column,
    edges: Sequence[float],
    closed: str = "left",
    last_closed: bool = True,
) -> Column:
    """0-based bin of ``value``, null outside the edges.

    ``closed="left"`` means ``[lo, hi)`` with the last bin closed unless
    ``last_closed`` is false; ``closed="right"`` means ``(lo, hi]`` with the
    lowest edge included.
    """
    return F.when(in_range(value, edges, last_closed), bin_number(value, edges, closed))


def edge_at(index: Column, edges: Sequence[float]) -> Column:
    """Edge number ``index`` (0-based)."""
    return F.element_at(F.array(*[F.lit(float(e)) for e in edges]), (index + 1).cast("int"))


def interval_text(lower: Column, upper: Column, closed_right: Column) -> Column:
    """``[lo - hi)`` with two decimals, ``]`` for the closed one."""
    return F.concat(
        F.format_string("[%.2f - %.2f", lower, upper),
        F.when(closed_right, "]").otherwise(")"),
    )


def range_label(lower: float, upper: float, decimals: int) -> str:
    return f"{lower:.{decimals}f}-{upper:.{decimals}f}"
