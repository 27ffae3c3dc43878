"""Row-local complexity score.  No expression here shuffles or explodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions.brackets import average_depth, count_operators, nesting_depth
from gradus.functions.text import strip

# Fixed values
ZERO_MARKERS = ("N/A", "Derivation cannot proceed")
EPSILON, GAMMA, BETA = 1e-5, 1.0, 0.0


def _size(array: Column) -> Column:
    return F.when(array.isNotNull(), F.size(array)).otherwise(0)


def _sum(array: Column) -> Column:
    return F.coalesce(
        F.aggregate(array, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))), F.lit(0.0)
    )


def context_score(expressions: Column, predicates: Column, constants: Column) -> Column:
    """``E * D^2 + P + C`` with D the average depth of the expressions."""
    return (
        _size(expressions) * F.pow(average_depth(expressions), F.lit(2.0))
        + _size(predicates)
        + _size(constants)
    )


def preconditions_score(preconditions: Column) -> Column:
    """``E * D^2`` of an option's preconditions, 0 without any."""
    return _size(preconditions) * F.pow(average_depth(preconditions), F.lit(2.0))


def step_score(expression: Column, zero_markers: Sequence[str] = ZERO_MARKERS) -> Column:
    """``D^2 * (operators + 1)`` of one step; 0 for the marker texts.

    A text is trimmed only when it contains a marker, since trimming changes
    neither depth nor operators.
    """
    text = F.coalesce(expression, F.lit(""))
    named = F.lit(False)
    for marker in zero_markers:
        named = named | text.contains(marker)
    return F.when(named & strip(text).isin(*zero_markers), F.lit(0.0)).otherwise(
        F.pow(nesting_depth(text).cast("double"), F.lit(2.0)) * (count_operators(text) + 1)
    )


def deduction_score(steps: Column, zero_markers: Sequence[str] = ZERO_MARKERS) -> Column:
    """Sum of the step scores of one option."""
    return _sum(
        F.transform(
            steps, lambda s: F.when(s.isNotNull(), step_score(s["expression"], zero_markers))
        )
    )


def options_score(option_analysis: Column, zero_markers: Sequence[str] = ZERO_MARKERS) -> Column:
    """Preconditions plus deductions over all options."""
    return _sum(
        F.transform(
            option_analysis,
            lambda o: preconditions_score(o["preconditions"])
            + deduction_score(o["deduction_steps"], zero_markers),
        )
    )


def raw_log_score(
    expressions: Column,
    predicates: Column,
    constants: Column,
    option_analysis: Column,
    zero_markers: Sequence[str] = ZERO_MARKERS,
) -> Column:
    """``ln(max(total, 0) + 1)``; 0 when the total cannot be computed."""
    total = context_score(expressions, predicates, constants) + options_score(
        option_analysis, zero_markers
    )
    return F.coalesce(F.ln(F.greatest(total, F.lit(0.0)) + 1), F.lit(0.0))


def layernorm_sigmoid(
    score: Column,
    mean: Column,
    variance: Column,
    epsilon: float = EPSILON,
    gamma: float = GAMMA,
    beta: float = BETA,
) -> Column:
    """Sigmoid of the standardised score."""
    z = (score - mean) / F.sqrt(variance + F.lit(epsilon))
    return F.lit(1.0) / (F.exp(-(z * F.lit(gamma) + F.lit(beta))) + F.lit(1.0))
