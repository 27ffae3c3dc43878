"""Records of JSON documents, read over any number of splits of a file.

The text source hands out a file in pieces between closing braces, whatever stands
around them, so no line structure is needed.  What a brace or a quote means depends on
whether it stands in a string and how deep, which no split knows by itself: a split
turns (in a string) into (in a string) and adds to the depth, these maps are chained per
file, and every split is then cut from its true state.

What stands between the records is kept as the skeleton of the file: its text with a mark
for every run of records that only commas part.  The skeleton is small and is parsed
as JSON, which tells a whole file from a broken one and which array a run lies in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.sources.splits import SPLIT, chained, per_file, rows_of, runs, split_of, with_states
from gradus.storage import materialise

QUOTE, OPEN, CLOSE = 1, 2, 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord('"')] = QUOTE
_CLASS[[ord("{"), ord("[")]] = OPEN
_CLASS[[ord("}"), ord("]")]] = CLOSE
_SPACE = b" \t\r\n"
#: Stands for a run of records in a skeleton; a private character, so that no key is like it.
MARK = "\uf8ff"
#: The separator of the scan ends every piece of a file but perhaps the last.
SEPARATOR = "}"
_BOM = 3


def events(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and classes of the quotes and brackets that no backslash escapes."""
    kinds = _CLASS[data]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    slashes = np.flatnonzero(data == 0x5C)
    if len(slashes):
        # A character is escaped by an odd number of backslashes right before it.
        starts = np.r_[True, np.diff(slashes) != 1]
        run = slashes[np.maximum.accumulate(np.where(starts, np.arange(len(slashes)), 0))]
        place = np.minimum(np.searchsorted(slashes, at - 1), len(slashes) - 1)
        escaped = (slashes[place] == at - 1) & ((at - run[place]) % 2 == 1)
        at, kinds = at[~escaped], kinds[~escaped]
    return at, kinds


def steps(kinds: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Change of depth at each event, and whether a string is open after the last."""
    quotes = kinds == QUOTE
    parity = np.cumsum(quotes) + inside
    change = np.where(kinds == OPEN, 1, -1)
    change[quotes | (parity % 2 == 1)] = 0
    return change, int(parity[-1] % 2) if len(kinds) else inside


def _pieces(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("value").cast(pa.binary()).to_pylist()


def _whole(pieces: list[bytes]) -> bytes:
    """Pieces as they stand in the file, each with its separator."""
    return b"}".join(pieces) + b"}"


def _strings(texts: tuple[bytes, ...]) -> pa.Array:
    """Texts as Spark takes them; what is no UTF-8 becomes replacement characters."""
    try:
        return pa.array(texts, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())


_SUMMARY = (
    "_file string, _block long, size long, bytes long, first string, "
    "inside array<int>, depth array<long>, least array<long>"
)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, for both states it may start in: the state after it, the depth gained and the least on the way."""
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema(
        [("_file", pa.string()), ("_block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64())]
        + [("first", pa.string()), ("inside", ints), ("depth", longs), ("least", longs)]
    )
    total, first, inside, depth, least = 0, "", [0, 1], [0, 0], [0, 0]
    for batch, last in runs(batches):
        text = _whole(_pieces(batch))
        total += len(text)
        if not first:
            first = text.lstrip(_SPACE)[:1].decode("latin-1")
        _, kinds = events(np.frombuffer(text, dtype=np.uint8))
        for start in (0, 1):
            change, inside[start] = steps(kinds, inside[start])
            gained = np.cumsum(change)
            if len(gained):
                least[start] = min(least[start], depth[start] + int(gained.min()))
                depth[start] += int(gained[-1])
        if last:
            size = batch.column("_size")[0].as_py()
            yield rows_of(schema, [(*split_of(batch), size, total, first, inside, depth, least)])
            total, first, inside, depth, least = 0, "", [0, 1], [0, 0], [0, 0]


def _ended(size: int) -> tuple[int, int]:
    """Bytes of the pieces with their separators, if the last one has its own; Spark drops a byte order mark."""
    return size, size - _BOM


def record_depth(first: str, nested: bool) -> int:
    """Depth of a record: elements of an array, a single object, or elements of an array in it; 0 for none."""
    if first == "[":
        return 0 if nested else 2
    return 0 if first != "{" else 3 if nested else 1


def _chain(nested: bool):
    def run(splits: list[dict]) -> list[dict]:
        first = next((s["first"] for s in splits if s["first"]), "")
        level = record_depth(first, nested)
        # The last piece has no separator unless the sizes say so.
        size = splits[0]["size"]
        ended = sum(s["bytes"] for s in splits) in _ended(size)
        inside, depth, began, rows = 0, 0, -1, []
        for split in splits:
            open_end = not ended and split is splits[-1]
            state = {"inside": inside, "depth": depth, "began": began, "level": level, "open_end": open_end}
            rows.append({"_file": split["_file"], "_block": split["_block"], **state})
            lowest, depth = depth + split["least"][inside], depth + split["depth"][inside]
            inside = split["inside"][inside]
            if not level or depth < level:
                began = -1
            elif began < 0 or lowest < level:
                began = split["_block"]
        return rows

    return run


_STATES = "_file string, _block long, inside int, depth long, began long, level int, open_end boolean"
_STATES_SCHEMA = pa.schema(
    [("_file", pa.string()), ("_block", pa.int64()), ("inside", pa.int32()), ("depth", pa.int64())]
    + [("began", pa.int64()), ("level", pa.int32()), ("open_end", pa.bool_())]
)
_CUT = "_file string, _block long, _row long, kind int, began long, run string, text string"
WHOLE, PART, SKELETON = 0, 1, 2


class _Cutter:
    """Cuts the records out of one split; without a state, the split is a whole file."""

    def __init__(self, batch: pa.RecordBatch, nested: bool) -> None:
        self.file, self.block = split_of(batch)
        self.nested, self.size, self.bytes = nested, batch.column("_size")[0].as_py(), 0
        self.alone = "level" not in batch.schema.names
        self.inside, self.depth, self.began, self.level, self.open_end = (
            (0, 0, -1, 0, False)
            if self.alone
            else (batch.column(c)[0].as_py() for c in ("inside", "depth", "began", "level", "open_end"))
        )
        #: The open record: its text so far, the row it starts in, the split it began in (-1: this one).
        self.open = self.level > 0 and self.depth >= self.level
        self.held: list[bytes] = []
        self.row: int | None = None
        self.run: str | None = None
        #: What stands since the last record, and the skeleton up to there.
        self.gap: list[bytes] = []
        self.skeleton: list[bytes] = []
        self.marks = 0
        self.out: list[tuple] = []

    def _begin(self) -> None:
        """A record begins: what stands since the last one, and a mark, unless that is one comma."""
        gap = b"".join(self.gap)
        self.gap = []
        if self.run is None or gap.strip(_SPACE) != b",":
            self.run = f"{MARK}{self.block}:{self.marks}"
            self.marks += 1
            self.skeleton += [gap, f'"{self.run}"'.encode()]

    def _emit(self, kind: int, began: int | None) -> None:
        self.out.append((self.file, self.block, self.row, kind, began, self.run, b"".join(self.held)))
        self.open, self.held = False, []

    def add(self, batch: pa.RecordBatch, last: bool) -> None:
        pieces = _pieces(batch)
        text = _whole(pieces)
        if self.alone:
            if not self.level and not self.skeleton and not self.gap:
                self.level = record_depth(text.lstrip(_SPACE)[:1].decode("latin-1"), self.nested)
            self.bytes += len(text)
            self.open_end = self.bytes not in _ended(self.size)
        if last and self.open_end:
            text = text[:-1]
        at, kinds = events(np.frombuffer(text, dtype=np.uint8))
        change, self.inside = steps(kinds, self.inside)
        depth = self.depth + np.cumsum(change)
        rows = batch.column("_row").to_numpy()
        if self.open and self.row is None:
            self.row = int(rows[0])
        cursor = 0
        if self.level:
            up = (change == 1) & (depth == self.level)
            down = (change == -1) & (depth == self.level - 1)
            ends = np.cumsum([len(p) + 1 for p in pieces])
            turns = np.flatnonzero(up | down)
            row_of = rows[np.searchsorted(ends, at[turns], side="right")]
            for place, opens, row in zip(at[turns].tolist(), up[turns].tolist(), row_of.tolist()):
                if opens:
                    self.gap.append(text[cursor:place])
                    self._begin()
                    self.open, self.row, self.began, cursor = True, row, -1, place
                elif self.open:
                    self.held.append(text[cursor : place + 1])
                    cursor = place + 1
                    self._emit(*((WHOLE, None) if self.began < 0 else (PART, self.began)))
        (self.held if self.open else self.gap).append(text[cursor:])
        if len(depth):
            self.depth = int(depth[-1])

    def finish(self) -> None:
        """The split ends: the record that is open goes on in the next one."""
        if self.open:
            self._emit(PART, self.block if self.began < 0 else self.began)
        rest = b"".join([*self.skeleton, *self.gap])
        if rest:
            self.out.append((self.file, self.block, 0, SKELETON, None, None, rest))


def _cut(batches: Iterator[pa.RecordBatch], nested: bool) -> Iterator[pa.RecordBatch]:
    """Whole records, parts of cut ones and the skeleton of each split."""
    names = ["_file", "_block", "_row", "kind", "began", "run", "text"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    cutter = None
    for batch, last in runs(batches):
        cutter = cutter or _Cutter(batch, nested)
        cutter.add(batch, last)
        if last:
            cutter.finish()
        if cutter.out:
            *columns, texts = zip(*cutter.out)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*arrays, _strings(texts)], names=names)
            cutter.out = []
        if last:
            cutter = None


def _judge(inside_key: str | None):
    """Whether a file is whole, and the runs of records that lie outside the array asked for."""

    def kept(text: str) -> list[str] | None:
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if inside_key is not None:
            value = value.get(inside_key) or [] if isinstance(value, dict) else None
        found = [value] if isinstance(value, str) and inside_key is None else value
        good = isinstance(found, list) and all(isinstance(v, str) and v.startswith(MARK) for v in found)
        return found if good else None

    def run(parts: list[dict]) -> list[dict]:
        text = "".join(p["text"] for p in parts)
        runs = kept(text)
        others = sorted(set(re.findall(f"{MARK}[0-9]+:[0-9]+", text)) - set(runs or []))
        return [{"_file": parts[0]["_file"], "whole": runs is not None, "others": others}]

    return run


_FILES = "_file string, whole boolean, others array<string>"
_FILES_SCHEMA = pa.schema([("_file", pa.string()), ("whole", pa.bool_()), ("others", pa.list_(pa.string()))])


def json_records(
    lines: DataFrame, inside_key: str | None = None, small: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Texts of the records of JSON files, and of the files that are not whole.

    ``lines`` is a text scan with :data:`SEPARATOR` between lines: ``value``, the scan-order columns
    and ``_size`` of the file.  ``small`` is a like scan of other files, each of which is one
    split: it starts in a known state, so these are read once only.  Records are the elements of a top-level array or one
    top-level object; with ``inside_key``, the elements of the array of that key in
    a top-level object.  Returns (scan order, text) of the records in whole files, and
    (scan order, raw) of broken files, a row for each split with its text: files that do not
    parse outside their records, that hold a scalar, or an array with scalars.

    A record that does not parse by itself is left to the reader of the texts.  Files must not be
    compressed to be split; a compressed one is read as one split.
    """
    lines = lines.select("_file", "_block", "_row", "_size", "value")
    nested = inside_key is not None

    def cut_nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, nested)

    states = chained(lines.mapInArrow(_summarise, _SUMMARY), _chain(nested), _STATES, _STATES_SCHEMA)
    made = with_states(lines, states).mapInArrow(cut_nested, _CUT)
    if small is not None:
        small = small.select(*lines.columns)
        made = made.unionByName(small.mapInArrow(cut_nested, _CUT))
        lines = lines.unionByName(small)
    cut = materialise(made, "json-records")
    skeletons = cut.where(F.col("kind") == SKELETON).select("_file", "_block", "text")
    judged = materialise(per_file(skeletons, _judge(inside_key), _FILES, _FILES_SCHEMA), "json-files")
    parts = (
        cut.where(F.col("kind") == PART)
        .groupBy("_file", "began")
        .agg(F.array_sort(F.collect_list(F.struct("_block", "_row", "run", "text"))).alias("_parts"))
        .select(
            "_file",
            F.col("_parts")[0]["_block"].alias("_block"),
            F.col("_parts")[0]["_row"].alias("_row"),
            F.col("_parts")[0]["run"].alias("run"),
            F.array_join("_parts.text", "").alias("text"),
        )
    )
    records = cut.where(F.col("kind") == WHOLE).select(*SPLIT, "_row", "run", "text").unionByName(parts)
    good = judged.where("whole").select("_file", "others")
    records = records.join(good, "_file").where(~F.array_contains("others", F.col("run")))
    records = records.select(*SPLIT, "_row", "text")
    broken = judged.where("NOT whole").select("_file")
    if broken.isEmpty():
        return records, records.withColumnRenamed("text", "raw").limit(0)
    whole = lines.join(broken, "_file", "left_semi").join(states.select(*SPLIT, "open_end"), SPLIT, "left")
    ended = F.array_contains(F.array(*_ended(F.first("_size"))), F.sum(F.octet_length("value") + 1))
    raw = (
        whole.groupBy(*SPLIT)
        .agg(
            F.array_sort(F.collect_list(F.struct("_row", "value"))).alias("_pieces"),
            F.coalesce(F.first("open_end"), ~ended).alias("_open"),
        )
        .select(
            *SPLIT,
            F.col("_pieces")[0]["_row"].alias("_row"),
            F.concat(
                F.array_join("_pieces.value", SEPARATOR), F.when(F.col("_open"), "").otherwise(SEPARATOR)
            ).alias("raw"),
        )
    )
    return records, raw
