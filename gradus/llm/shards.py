"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group and stay together.  Differencing starts with one
partial partition per group, the group in one of its parts, and keeps combining the
two partial partitions of largest spread in opposite order, until one is left.

It runs in three steps, all by the same rule.  The largest groups, at most ``LARGE``, are differenced
first, on the driver; their sums are the start of every task.  (Sizes are counted by their
number of bits, and whole classes taken, so any other group is below 2/``LARGE`` of all bytes.)
A task then takes the other groups in blocks, and differences each block together with what
its parts hold so far: its share of the start, and the groups of the blocks before.  So a task evens out its share of the large groups, whatever their sizes, and its memory is
bounded.  What is left uneven, a partial partition of ``shards`` sums per task, is combined on
the driver; parts may be exchanged where the start has equal sums.  No group is bundled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators.ordering import with_position
from gradus.storage import materialise

#: Groups of one block: what a task differences at a time, some 30 MB.
BLOCK = 16_384
#: So many of the largest groups, by whole size classes, are differenced first.
LARGE = 16_384
#: Groups with at least one in so many rows are looked up in a broadcast table.
HEAVY = 1_024


def _combine(partials: list[tuple[list[int], list]]) -> list:
    """Members of each part, from the largest sum to the smallest, when all partial partitions are combined.

    A partial partition is its sums from large to small and the members of each part:
    None, a leaf, or a tree (left, right) of leaves, so that combining copies no members.
    The two of largest spread are combined in opposite order until one is left;
    ties in spread are taken in the order given, so the result is repeatable.
    """
    heap = [
        (sums[-1] - sums[0], i, [s - sums[-1] for s in sums], members)
        for i, (sums, members) in enumerate(partials)
    ]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, sums, members = heapq.heappop(heap)
        _, _, other_sums, other_members = heapq.heappop(heap)
        joined = sorted(
            (
                (a + b, (x, y) if x is not None and y is not None else x if y is None else y)
                for a, b, x, y in zip(sums, reversed(other_sums), members, reversed(other_members))
            ),
            key=lambda pair: -pair[0],
        )
        low = joined[-1][0]
        heapq.heappush(
            heap, (low - joined[0][0], number, [s - low for s, _ in joined], [m for _, m in joined])
        )
        number += 1
    return heap[0][3]


def _part_of_leaves(members: list, leaves: int) -> list[int]:
    """The part that holds each leaf, a number."""
    part_of = [0] * leaves
    for part, tree in enumerate(members):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            elif node is not None:
                part_of[node] = part
    return part_of


def differencing(sizes: Sequence[int], parts: int, start: Sequence[int] | None = None) -> list[int]:
    """The part of each size, when the parts hold ``start`` (or nothing) before."""
    if parts < 1:
        raise ValueError("parts must be at least 1")
    start = start or [0] * parts
    n, empty = len(sizes), parts - 1
    order = sorted(range(parts), key=lambda p: -start[p])
    before = [([start[p] for p in order], [n + p for p in order])]
    single = [([size] + [0] * empty, [i] + [None] * empty) for i, size in enumerate(sizes)]
    found = _part_of_leaves(_combine(before + single), n + parts)
    # Every part holds one part of the start, and has its name.
    name = {found[n + p]: p for p in range(parts)}
    return [name[part] for part in found[:n]]


def combined(partials: Sequence[Sequence[int]]) -> list[list[int]]:
    """For each partial partition, given by its sums from large to small, the final part of each of its parts."""
    if not partials:
        return []
    parts = len(partials[0])
    named = [(list(sums), list(range(i * parts, (i + 1) * parts))) for i, sums in enumerate(partials)]
    flat = _part_of_leaves(_combine(named), len(partials) * parts)
    return [flat[i : i + parts] for i in range(0, len(flat), parts)]


def exchanged(partials: Sequence[Sequence[int]], start: Sequence[int]) -> list[list[int]]:
    """For each partial partition the final part of each of its parts, exchanging only parts of equal ``start``."""
    moves = [[0] * len(start) for _ in partials]
    for value in set(start):
        alike = [p for p, s in enumerate(start) if s == value]
        orders = [sorted(alike, key=lambda p: -sums[p]) for sums in partials]
        sorted_sums = [[sums[p] for p in order] for sums, order in zip(partials, orders)]
        for move, order, final in zip(moves, orders, combined(sorted_sums)):
            for part, k in zip(order, final):
                move[part] = alike[k]
    return moves


def summed(partials: Sequence[Sequence[int]], moves: Sequence[Sequence[int]], parts: int) -> list[int]:
    """Sums of the final parts when each partial partition goes where ``moves`` sends it."""
    out = [0] * parts
    for sums, move in zip(partials, moves):
        for part, size in zip(move, sums):
            out[part] += size
    return out


_PLACED = "grp long, n long, task int, part int, sums array<long>"
_PLACED_SCHEMA = pa.schema(
    [("grp", pa.int64()), ("n", pa.int64()), ("task", pa.int32()), ("part", pa.int32())]
    + [("sums", pa.list_(pa.int64()))]
)


def _difference(shards: int, block: int, start: list[int], total: int):
    """A row per group with its part; then one, without a group, with the sums of the task's parts.

    ``total`` is the bytes of all groups that go through tasks: a task has a share of ``start``
    as large as its share of these.
    """

    def place(groups: pa.Table, sums: list[int], task: int) -> pa.RecordBatch:
        # By size, then hash: the parts of a block do not depend on the order of arrival.
        groups = groups.sort_by([("bytes", "descending"), ("grp", "ascending")])
        sizes = groups.column("bytes").to_pylist()
        share = sum(sums) + sum(sizes)
        part_of = differencing(sizes, shards, [s * share // total + held for s, held in zip(start, sums)])
        for size, part in zip(sizes, part_of):
            sums[part] += size
        n = len(sizes)
        columns = [
            groups.column("grp").combine_chunks(),
            groups.column("n").combine_chunks(),
            pa.array(np.full(n, task, dtype=np.int32)),
            pa.array(part_of, pa.int32()),
            pa.nulls(n, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_PLACED_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, sums, task = [], 0, [0] * shards, None
        for batch in batches:
            if task is None and batch.num_rows:
                task = batch.column("task")[0].as_py()
            while batch.num_rows:
                take = batch.slice(0, block - rows)
                held.append(take)
                rows += take.num_rows
                batch = batch.slice(take.num_rows)
                if rows == block:
                    yield place(pa.Table.from_batches(held), sums, task)
                    held, rows = [], 0
        if rows:
            yield place(pa.Table.from_batches(held), sums, task)
        if task is not None:
            yield pa.RecordBatch.from_pylist([{"task": task, "sums": sums}], _PLACED_SCHEMA)

    return run


def shard_by_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    block: int = BLOCK,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every row in one shard.

    ``size`` is the bytes of the text in UTF-8 plus 1.  A null text counts as an empty
    one: size 1, checksum 0, in the group of the empty texts.  Repeated rows and ids
    are rows like any others; a null id comes first in its shard.  ``slot`` counts
    from 0 in the order of (id, checksum, size).  The law is ``bytes``, so there is no
    ``grown_shard``.  An empty table gives an empty result.  Two different texts of
    one 64-bit hash share a group, which costs balance only.  A very long text is one size;
    a group heavier than a shard stays whole, and its shard is that much larger.

    Building the frame reads the texts once, and writes ids, sizes and hashes, then the
    sizes of the groups and their parts.  The driver sees at most ``LARGE`` groups and one row
    of ``shards`` sums per task.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("grp"),
        ),
        "shard-rows",
    )
    spark = docs.sparkSession
    # Summed before the shuffle, so many copies are no hot key.
    groups = materialise(
        own.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-sizes"
    )
    bits = F.length(F.bin("bytes"))
    classes = groups.groupBy(bits.alias("bits")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n")
    )
    sizes = classes.orderBy(F.desc("bits")).collect()
    total, rows, n_groups = (sum(c[k] for c in sizes) for k in ("bytes", "n", "groups"))
    least, taken = 64, 0
    for c in sizes:
        taken += c.groups
        if taken > LARGE:
            break
        least = c.bits
    large = bits >= least
    first = sorted(groups.where(large).collect(), key=lambda g: (-g.bytes, g.grp))
    first_part = differencing([g.bytes for g in first], shards)
    start = [0] * shards
    for group, part in zip(first, first_part):
        start[part] += group.bytes
    rest = total - sum(start)
    # A task has a block of groups or more, so that the last ones are small beside its share.
    others = groups.where(~large).coalesce(n_groups // block + 1).withColumn("task", F.spark_partition_id())
    placed = materialise(others.mapInArrow(_difference(shards, block, start, rest), _PLACED), "shard-parts")
    tasks = placed.where("grp IS NULL").select("task", "sums").orderBy("task").collect()
    final = [(t.task, move) for t, move in zip(tasks, exchanged([t.sums for t in tasks], start))]
    moves = F.broadcast(spark.createDataFrame(final, "task int, final array<int>"))
    of_first = spark.createDataFrame(
        [(g.grp, g.n, part) for g, part in zip(first, first_part)], "grp long, n long, shard int"
    )
    shard_of = materialise(
        placed.where("grp IS NOT NULL").join(moves, "task")
        .select("grp", "n", F.get("final", F.col("part")).alias("shard")).unionByName(of_first),
        "shard-groups",
    )
    # Groups with 1/HEAVY of all rows are at most HEAVY by construction: their rows are not shuffled to them.
    heavy = F.col("n") * HEAVY >= rows
    few = F.broadcast(shard_of.where(heavy).select("grp", "shard"))
    light = own.join(few, "grp", "left_anti").join(shard_of.where(~heavy).select("grp", "shard"), "grp")
    sharded = own.join(few, "grp").unionByName(light).select("id", "size", "crc", "shard")
    return with_position(sharded, ["id", "crc", "size"], within=["shard"], name="slot").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
