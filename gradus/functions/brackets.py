"""Structure of a logical expression: bracket depth and operator count.

Both are JVM-side column expressions.  The depth of the k-th opening bracket at
position p of the bracket-only string is ``2k - p``, so the maximum needs no
running state and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
BRACKETS = r"()\[\]{}"
NESTED = r"[(\[{][^()\[\]{}]*[(\[{]"
OPERATORS = "∧∨→¬~←"
ARROW_TEXT = "->"
PLAIN_RUN = r"[\x00-}\x7f]+"  # ASCII without the tilde


def nesting_depth(expression: Column) -> Column:
    """Largest running (opened - closed) count, at least 1; null for null.

    Unless an opening bracket follows another with no bracket between them, the
    depth cannot pass 1; only the other texts are looked at bracket by bracket.
    """
    kinds = F.translate(F.regexp_replace(expression, f"[^{BRACKETS}]+", ""), "[]{}", "()()")
    opened = F.filter(
        F.transform(F.split(kinds, ""), lambda c, i: F.when(c == "(", i + 1)),
        lambda p: p.isNotNull(),
    )
    deepest = F.array_max(F.transform(opened, lambda p, k: (k + 1) * 2 - p))
    return (
        F.when(expression.rlike(NESTED), F.greatest(F.lit(1), deepest))
        .when(expression.isNotNull(), F.lit(1))
    )


def count_operators(expression: Column) -> Column:
    """Logical connectives in the text; ``->`` counts as one arrow.

    Every connective becomes ``~`` and everything else goes.  Plain ASCII runs go
    first: a character class of non-ASCII symbols is slow over a whole text.
    """
    marked = F.regexp_replace(F.replace(expression, F.lit(ARROW_TEXT), F.lit("~")), PLAIN_RUN, "")
    one_kind = F.translate(marked, OPERATORS, "~" * len(OPERATORS))
    return F.length(F.regexp_replace(one_kind, "[^~]+", ""))


def average_depth(expressions: Column) -> Column:
    """Mean depth over the non-null expressions; 1 when there is none."""
    depths = F.filter(F.transform(expressions, nesting_depth), lambda d: d.isNotNull())
    return F.coalesce(
        F.aggregate(
            depths,
            F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, d: F.struct((acc.total + d).alias("total"), (acc.n + 1).alias("n")),
            lambda acc: F.when(acc.n > 0, acc.total.cast("double") / acc.n),
        ),
        F.lit(1.0),
    )
