"""Multiple-choice blocks in text files, read line by line over any number of splits.

A block is an optional answer letter, a context, a question and four options, each on
a line of its own; blank lines between blocks are passed over.  What a line is depends
only on how many lines of the block stand before it, one of seven states.  A line is
blank, a letter or neither, and each of these is a map of the seven states.  Maps of
neighbours are composed two by two, so a batch of lines takes as many NumPy steps as
its length has binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.sources.splits import SPLIT, chained, rows_of, runs, split_of, with_states
from gradus.storage import materialise

# What is expected next: 0 a new block, 1 the context after a letter, 2 the question, 3 to 6 options.
STATES = 7
BLANK, LETTER, OTHER = 0, 1, 2
#: Lines of a block without its letter.
LINES = 6

_ONWARD = [(s + 1) % STATES for s in range(1, STATES)]
#: The state each class of line makes of each state.
MAPS = np.array([[start, *_ONWARD] for start in (0, 1, 2)], dtype=np.int8)
_SAME = np.arange(STATES, dtype=np.int8)


def classes(lines: pa.Array) -> np.ndarray:
    """Class of each line: blank, a single letter, or other."""
    text = pc.utf8_trim_whitespace(lines)
    size = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    kinds = np.where(size == 0, BLANK, OTHER)
    single = np.flatnonzero(size == 1)
    letter = [c.isalpha() for c in text.take(pa.array(single)).to_pylist()]
    kinds[single[np.array(letter, dtype=bool)]] = LETTER
    return kinds


def _pairs(maps: np.ndarray) -> np.ndarray:
    """Composition of every two neighbours, the earlier one first."""
    if len(maps) % 2:
        maps = np.concatenate([maps, _SAME[None]])
    return np.take_along_axis(maps[1::2], maps[::2].astype(np.intp), axis=1)


def compose(kinds: np.ndarray) -> np.ndarray:
    """What all lines together make of each state."""
    maps = MAPS[kinds]
    while len(maps) > 1:
        maps = _pairs(maps)
    return maps[0] if len(maps) else _SAME


def states_before(kinds: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each line, and after the last, from the state before the first."""
    levels = [MAPS[kinds]]
    while len(levels[-1]) > 1:
        levels.append(_pairs(levels[-1]))
    before = np.array([state], dtype=np.int8)
    for maps in reversed(levels[:-1]):
        # The left one of a pair starts as the pair does, the right one after the left.
        after = np.take_along_axis(maps[::2], before[:, None].astype(np.intp), axis=1)[:, 0]
        before = np.stack([before, after], axis=1).ravel()[: len(maps)]
    last = int(levels[0][-1, before[-1]]) if len(kinds) else state
    return before, last


_SUMMARY = "_file string, _block long, ends array<int>, n long"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: the state it makes of each state, and its number of lines."""
    schema = pa.schema(
        [("_file", pa.string()), ("_block", pa.int64()), ("ends", pa.list_(pa.int32())), ("n", pa.int64())]
    )
    whole, n = _SAME, 0
    for batch, last in runs(batches):
        whole, n = compose(classes(batch.column("value")))[whole], n + batch.num_rows
        if last:
            yield rows_of(schema, [(*split_of(batch), whole.tolist(), n)])
            whole, n = _SAME, 0


def _chain(splits: list[dict]) -> list[dict]:
    """State at the start of each split of a file, and the split an open block began in."""
    state, began, rows = 0, -1, []
    for split in splits:
        rows.append({"_file": split["_file"], "_block": split["_block"], "state": state, "began": began})
        goes_on = state and split["n"] < STATES - state
        state = int(split["ends"][state])
        began = began if goes_on else split["_block"] if state else -1
    return rows


_STATES = "_file string, _block long, state int, began long"
_STATES_SCHEMA = pa.schema(
    [("_file", pa.string()), ("_block", pa.int64()), ("state", pa.int32()), ("began", pa.int64())]
)
_CUT = "_file string, _block long, _row long, key long, letter string, lines array<string>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks, and the lines of those the split does not hold whole.

    ``key`` is null for a whole block; the two parts of a cut block share the place of the
    split that the later one starts.
    """
    schema = pa.schema(
        [("_file", pa.string()), ("_block", pa.int64()), ("_row", pa.int64()), ("key", pa.int64())]
        + [("letter", pa.string()), ("lines", pa.list_(pa.string()))]
    )
    state, held, fresh = 0, None, True
    for batch, last in runs(batches):
        file, block = split_of(batch)
        lines, rows = batch.column("value"), batch.column("_row").to_numpy()
        if fresh:
            given = batch.column("state")[0].as_py()
            state = lead = 0 if given is None else given
            fresh = False
        kinds = classes(lines)
        before, after = states_before(kinds, state)
        begins = np.flatnonzero((before == 0) & (kinds != BLANK))
        if held is not None:
            # The block that the batch before left open.
            shift = len(held[0])
            lines, rows = pa.concat_arrays([held[0], lines]), np.concatenate([held[1], rows])
            begins = np.concatenate([[0], begins + shift]).astype(np.int64)
            kinds = np.concatenate([held[2], kinds])
            held = None
        first = int(begins[0]) if len(begins) else len(lines)
        if lead:
            # Lines of a block that an earlier split began: it goes on to its last option.
            own = min(STATES - lead, first, len(lines))
            if own:
                yield rows_of(schema, [(file, block, int(rows[0]), block, None, lines[:own].to_pylist())])
            lead = (lead + own) % STATES
        lettered = kinds[begins] == LETTER
        ends = begins + LINES + lettered
        whole = ends <= len(lines)
        at, more = begins[whole], lettered[whole].astype(np.int64)
        if len(at):
            body = (at + more)[:, None] + np.arange(LINES)
            letters = pc.if_else(pa.array(more == 1), lines.take(pa.array(at)), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * len(at), pa.string()),
                    pa.array(np.full(len(at), block), pa.int64()),
                    pa.array(rows[at], pa.int64()),
                    pa.nulls(len(at), pa.int64()),
                    letters,
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(at) + 1) * LINES, pa.int32()), lines.take(pa.array(body.ravel()))
                    ),
                ],
                schema=schema,
            )
        state = after
        if len(begins) and not whole[-1]:
            tail = int(begins[-1])
            held = lines[tail:], rows[tail:], kinds[tail:]
        if last:
            if held is not None:
                text, skip = held[0].to_pylist(), int(held[2][0] == LETTER)
                first = text[0] if skip else None
                yield rows_of(schema, [(file, block, int(held[1][0]), -1, first, text[skip:])])
            state, held, fresh = 0, None, True


def blocks_of_lines(lines: DataFrame) -> DataFrame:
    """(_file, _block, _row, letter, lines, raw): one row per block, at the place of its first line.

    ``lines`` has ``value`` and the scan-order columns.  ``lines`` of the result are the
    context, the question and the four options, or fewer where the file ends before the
    last one; ``raw`` then has the lines as they stand.
    """
    lines = lines.select("_file", "_block", "_row", "value")
    summaries = lines.mapInArrow(_summarise, _SUMMARY)
    states = chained(summaries, _chain, _STATES, _STATES_SCHEMA)
    cut = materialise(
        with_states(lines, states.select(*SPLIT, "state").where("state <> 0")).mapInArrow(_cut, _CUT), "blocks"
    )
    whole = cut.where("key IS NULL").select(
        *SPLIT, "_row", "letter", "lines", F.lit(None).cast("string").alias("raw")
    )
    # The parts of a block meet under the split it began in.
    begun = states.where("state <> 0").select(*SPLIT, "began")
    parts = cut.where("key IS NOT NULL").join(begun, SPLIT, "left").select(
        "_file",
        F.when(F.col("key") < 0, F.col("_block")).otherwise(F.col("began")).alias("_began"),
        F.struct("_block", "_row", "letter", "lines").alias("_part"),
    )
    stitched = (
        parts.groupBy("_file", "_began")
        .agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
        .select("_file", "_parts", F.flatten(F.col("_parts.lines")).alias("_lines"))
    )
    first = F.col("_parts")[0]
    return whole.unionByName(
        stitched.select(
            "_file",
            first["_block"].alias("_block"),
            first["_row"].alias("_row"),
            first["letter"].alias("letter"),
            F.col("_lines").alias("lines"),
            F.when(F.size("_lines") < LINES, F.concat_ws("\n", first["letter"], "_lines")).alias("raw"),
        )
    )
