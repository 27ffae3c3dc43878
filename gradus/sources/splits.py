"""Files read in splits by a machine whose state no split knows by itself.

Every split is read once to find what it does to each state it could start in, these
maps are chained per file, and every split is read again from its true state.  What
lies whole in a split is made where it was read; only records that splits cut, at most
one per cut, are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.storage import materialise

SPLIT = ["_file", "_block"]
#: Splits (about 150 bytes each) whose states are broadcast; beyond, the lines are shuffled to them.
BROADCAST_SPLITS = 100_000


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Stretches of rows of one split, and whether the split ends with it."""
    held: pa.RecordBatch | None = None

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(c)[row].as_py() for c in SPLIT)

    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows - 1, dtype=bool)
        for name in SPLIT:
            column = batch.column(name)
            changes |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held is not None:
                yield held, key(held, 0) != key(part, 0)
            held = part
    if held is not None:
        yield held, True


def split_of(batch: pa.RecordBatch) -> tuple[str, int]:
    return batch.column("_file")[0].as_py(), batch.column("_block")[0].as_py()


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def with_states(lines: DataFrame, states: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``states``, a written table with a row per split.

    Rows of a split stay together and in order.  A few states are broadcast, so that no
    line moves; many are joined, and the lines dealt out and sorted again.
    """
    if states.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        return lines.join(F.broadcast(states), SPLIT, "left")
    joined = lines.join(states, SPLIT, "left")
    return joined.repartition(*SPLIT).sortWithinPartitions(*SPLIT, "_row")


def per_file(rows: DataFrame, run: Callable[[list[dict]], list[dict]], ddl: str, schema: pa.Schema) -> DataFrame:
    """``run`` on the rows of every file, in the order of their splits.

    ``rows`` are small, one or two per split.  Files are sorted and streamed through a task,
    so that a folder of many small files costs a call per batch of rows, not one per file.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            made: list[dict] = []
            for row in batch.to_pylist():
                if held and row["_file"] != held[0]["_file"]:
                    made += run(held)
                    held = []
                held.append(row)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
        if held:
            yield pa.RecordBatch.from_pylist(run(held), schema)

    return rows.repartition("_file").sortWithinPartitions(*SPLIT).mapInArrow(stream, ddl)


def chained(summaries: DataFrame, chain: Callable[[list[dict]], list[dict]], ddl: str, schema: pa.Schema) -> DataFrame:
    """The states of all splits: ``chain`` sees the summaries of one file."""
    return materialise(per_file(summaries, chain, ddl, schema), "states")
