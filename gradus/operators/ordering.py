"""Dense positions in a total order, without a single-task window.

Rows are range-partitioned and sorted on the order key, written once, and each
range partition's offset is the row count of the partitions before it.  The
offset table has one row per range partition (and group), so it is small
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.storage import materialise

# monotonically_increasing_id keeps the partition number above this many bits.
_ROW_BITS = 33
# Columns the readers add: file, block of the file, row.
SCAN_ORDER = ("_file", "_block", "_row")
# Added by readers that unnest a record.
NESTED_ORDER = ("_sample", "_pair")


#: Names the setting that overrides how many ranges are made.
RANGES_SETTING = "gradus.ranges"


def range_partitions(df: DataFrame) -> int:
    """Ranges to cut an order into: ``gradus.ranges``, or else the shuffle partitions.

    Adaptive execution does not change this number, so set one of the two to the
    size of the input on the cluster.
    """
    conf = df.sparkSession.conf
    return int(conf.get(RANGES_SETTING, None) or conf.get("spark.sql.shuffle.partitions"))


def sorted_ranges(df: DataFrame, keys: Sequence[Column | str], label: str) -> DataFrame:
    """``df`` range-partitioned and sorted on ``keys``, written to the shared folder.

    Whole rows are moved and written: with wide rows, pass keys and join the rest.
    Adds ``_part`` (range number) and ``_seq`` (row number inside the range).
    """
    marked = (
        df.repartitionByRange(range_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mark", F.monotonically_increasing_id())
    )
    return materialise(marked, label).select(
        "*",
        F.shiftright("_mark", _ROW_BITS).alias("_part"),
        F.col("_mark").bitwiseAND(2**_ROW_BITS - 1).alias("_seq"),
    ).drop("_mark")


def with_position(
    df: DataFrame,
    order_by: Sequence[Column | str],
    within: Sequence[str] = (),
    start: int = 0,
    name: str = "position",
) -> DataFrame:
    """Add a dense ``name`` column counting from ``start`` in ``order_by`` order.

    ``order_by`` must be a total order (end it with a unique key): ties would
    otherwise be placed arbitrarily, and one hot value could not be split over
    ranges.  With ``within`` the count restarts per group; a group may be of any
    size, since ranges cut through it.
    """
    within = list(within)
    ranged = sorted_ranges(df, [*[F.col(c) for c in within], *order_by], "positions")
    sizes = ranged.groupBy(*within, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first")
    )
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)],
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + start).alias("_off"),
    )
    # Without groups there are at most as many offsets as range partitions.
    offsets = offsets if within else F.broadcast(offsets)
    condition = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ranged.join(offsets, condition).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_off") + F.col("_seq")).alias(name)
    )


def assign_ids(
    df: DataFrame,
    order_by: Sequence[Column | str] = SCAN_ORDER,
    start: int = 1,
    within: Sequence[str] = (),
) -> DataFrame:
    """Sequential ids.  The default is the order of the files as a reader scans them.

    In scan order the rows are written as they come, without a shuffle: each file
    block is read by one task, so its rows already stand in order and only the
    counts of the blocks before are needed.
    """
    kept = [c for c in df.columns if c != "id" and not c.startswith("_")]
    if list(order_by) == list(SCAN_ORDER) and not within:
        numbered = _positions_in_scan_order(df.drop("id"), start)
    else:
        numbered = with_position(df.drop("id"), order_by, within, start, "id")
    return numbered.select("id", *kept)


def _positions_in_scan_order(df: DataFrame, start: int) -> DataFrame:
    marked = materialise(df.withColumn("_mark", F.monotonically_increasing_id()), "scan")
    block = list(SCAN_ORDER[:2])
    blocks = marked.groupBy(*block).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_mark").alias("_first"),
        F.max("_mark").alias("_last"),
    )
    # A block whose rows are not in one piece was moved by a shuffle after the scan.
    if not blocks.filter(F.col("_last") - F.col("_first") + 1 != F.col("_rows")).isEmpty():
        order = [c for c in (*SCAN_ORDER, *NESTED_ORDER) if c in df.columns]
        return with_position(marked.drop("_mark"), order, start=start, name="id")
    offsets = running_sum(blocks, block, "_rows", "_before").select(
        *block, (F.col("_before") - F.col("_first") + start).alias("_off")
    )
    return marked.join(offsets, block).select(
        (F.col("_off") + F.col("_mark")).alias("id"), *[F.col(f"`{c}`") for c in df.columns]
    )


def running_sum(df: DataFrame, order_by: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before, in ``order_by`` order.

    Sums run inside each range; only the totals of the ranges are added up in one
    place, as many as there are range partitions.
    """
    ranged = sorted_ranges(df, order_by, "sums")
    earlier = (Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    over = Window.orderBy("_part").rowsBetween(*earlier)
    before = totals.select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_earlier")
    )
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_seq").rowsBetween(*earlier))
    return (
        ranged.withColumn("_own", F.coalesce(own, F.lit(0)))
        .join(F.broadcast(before), F.col("_part") == F.col("_p"))
        .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_own") + F.col("_earlier")).alias(name))
    )


def order_by_score(
    df: DataFrame, score: str, tie: str, descending: bool = False
) -> DataFrame:
    """Stable sort by score as a dense ``position``; ties keep their ``tie`` order."""
    key = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_first()
    return with_position(df, [key, F.col(tie)])


def head_tail(df: DataFrame, score: str, tie: str, n: int = 3, descending: bool = False) -> DataFrame:
    """First and last ``n`` rows of the sorted order, as (side, rank, score)."""
    up = [F.col(score).asc(), F.col(tie).asc()]
    down = [F.col(score).desc(), F.col(tie).asc()]
    reverse_up = [F.col(score).desc(), F.col(tie).desc()]
    reverse_down = [F.col(score).asc(), F.col(tie).desc()]
    head, tail = (down, reverse_down) if descending else (up, reverse_up)

    def side(order: list[Column], label: str) -> DataFrame:
        # the limit keeps n rows, so numbering them is a window over n rows
        return (
            df.select(score, tie)
            .orderBy(*order)
            .limit(n)
            .select(
                F.lit(label).alias("side"),
                F.row_number().over(Window.orderBy(*order)).alias("rank"),
                F.col(score),
                F.col(tie),
            )
        )

    return side(head, "first").unionByName(side(tail, "last"))


def chunk_slices(df: DataFrame, position: str = "position", chunk: int = 10_000, batch: int = 128) -> DataFrame:
    """Chunk and batch number of each row from its position."""
    offset = F.col(position) % chunk
    return df.select(
        "*",
        F.floor(F.col(position) / chunk).alias("chunk"),
        F.floor(offset / batch).alias("batch"),
    )
