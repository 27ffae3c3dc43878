"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times whose mean is the repetition
rate of its source.  The number is the inverse of the distribution at a uniform
hashed from (seed, id), so it depends on nothing but the row, its source's rate and
the seed: no document waits for another one, and a retried task repeats its work.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.hashing import hash60
from gradus.storage import materialise

#: Means above this are drawn as a sum of equal independent parts.
PART = 32.0
#: Steps of the distribution of one part; the rest is below the resolution of a double.
STEPS = 160
#: Sources (each with its distribution, about 1.3 kB) that are broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 10_000


def uniform53(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1), exact in 53 bits."""
    return F.shiftright(hash60(*parts), 7) / F.lit(float(2**53))


def poisson_steps(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... for a mean of at most ``PART``.

    Only those below the largest are listed: the number of listed values at or below
    a uniform is the draw.
    """
    first = F.exp(-mean)
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(first.alias("p"), F.array(first).alias("all")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(
                acc["all"], F.array(F.element_at(acc["all"], -1) + acc["p"] * mean / k)
            ).alias("all"),
        ),
    )["all"]
    return F.filter(steps, lambda c: c < F.element_at(steps, -1))


def source_rates(
    docs: DataFrame,
    source_col: str,
    weights: Mapping[str | None, float] | None,
    power: float,
    target_rows: int | None,
) -> DataFrame:
    """(source, rows, rate): the mean repetition of the rows of each source."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame(
            [(s, float(w)) for s, w in weights.items()], "name string, weight double"
        )
        sizes = (
            sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left")
            .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
            .drop("name")
        )
    sizes = materialise(sizes, "sources")
    total = sizes.agg(F.sum("weight"), F.sum("rows")).first()
    whole, rows = total[0] or 0.0, total[1] or 0
    target = rows if target_rows is None else target_rows
    rate = F.lit(float(target)) * F.col("weight") / F.lit(whole) / F.col("rows") if whole > 0 else F.lit(0.0)
    return sizes.withColumn("rate", rate)


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    target_rows: int | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str = "copy",
    order_col: str = "shuffle_key",
) -> DataFrame:
    """``docs`` repeated to the target weights, in shuffled order.

    ``weights`` gives the wanted share of rows per source; a source it does not name
    has share 0, one that has no rows is left out of the shares.  Without it a source
    weighs its rows to ``power`` (1 keeps the shares, 0 makes them equal).
    ``target_rows`` is the expected size of the result, by default that of the input.

    A null source is a source.  Rows of one id get the same number of copies; all
    null ids too.  All columns are kept; columns named as ``copy_col`` (1, 2, ...) or
    ``order_col`` are replaced.  An empty table or no weight at all gives an empty
    result.  Rows are dealt out by ``order_col``, a hash of (seed, id, copy), and
    sorted by it within a partition; it also orders the whole.
    """
    if any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights must not be negative")
    rates = source_rates(docs, source_col, weights, power, target_rows).where("rate > 0")
    parts = F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1))
    table = materialise(
        rates.select(
            F.col("source").alias("_mix_source"),
            parts.alias("_mix_parts"),
            poisson_steps(F.col("rate") / parts).alias("_mix_steps"),
        ),
        "rates",
    )
    side = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table
    parts = F.sequence(F.lit(1), F.col("_mix_parts"))
    uniforms = F.transform(parts, lambda j: uniform53(seed, "poisson", F.col(id_col), j))
    draw = F.aggregate(
        uniforms, F.lit(0), lambda n, u: n + F.size(F.filter("_mix_steps", lambda c: c <= u))
    )
    drawn = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    kept = [c for c in docs.columns if c.lower() not in (copy_col.lower(), order_col.lower())]
    repeated = (
        docs.select(*[F.col(f"`{c}`") for c in kept])
        .join(side, F.col(source_col).eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_n", draw)
        .where("_mix_n > 0")
        .withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
        .select(
            *[F.col(f"`{c}`") for c in kept],
            copy_col,
            hash60(seed, "order", drawn, F.col(copy_col)).alias(order_col),
        )
    )
    return repeated.repartition(order_col).sortWithinPartitions(order_col)
