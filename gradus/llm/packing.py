"""Packing of examples into sequences by vector bin packing.

An example has three sizes: tokens, one segment, and tokens that bear loss.  A
sequence has a limit for each.  The open sequence takes, of all examples of the pool
that still fit, the one with the largest dot product of its sizes with the room that
is left, every dimension weighted by the mean demand of the pool.  When none fits, the example
of the largest dot product is cut to the room that is left (where cutting is allowed)
and its rest goes back to the pool.

The work is local to a partition: a task streams its rows through a pool of bounded
size and keeps one open pool, so nothing is shuffled and no group can grow hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm import tokens as flat

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The same vocabulary as ranks; gives the same identifiers faster.
RANKS = flat.TOKENIZER
END = 1
#: Examples of a pool.
POOL = 4096
#: Bytes of identifiers in an output batch.
OUT_BYTES = 4 << 20
_GONE = np.iinfo(np.int64).max

Example = tuple[object, np.ndarray, np.ndarray | None]
Placed = tuple[int, int, int, int]


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")


class Pool:
    """Examples that wait for a sequence, at most ``size`` of them."""

    def __init__(self, limits: Limits, size: int = POOL, cut: bool = True) -> None:
        self.limits, self.cut = limits, cut
        self.examples: list = [None] * size
        self.start = np.zeros(size, dtype=np.int64)
        #: tokens, segments and loss of what is left of each example
        self.sizes = np.full((3, size), _GONE, dtype=np.int64)
        self.free = list(range(size))
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], dtype=float)

    def __len__(self) -> int:
        return len(self.examples) - len(self.free)

    def add(self, example: Example, start: int) -> None:
        at = self.free.pop()
        self.examples[at], self.start[at] = example, start
        self._measure(at)

    def _measure(self, at: int) -> None:
        _, ids, loss = self.examples[at]
        left = len(ids) - int(self.start[at])
        bearing = left if loss is None else int(loss[self.start[at] :].sum())
        self.sizes[:, at] = left, 1, bearing

    def _take(self, at: int, length: int) -> tuple[Example, int, int]:
        """The next ``length`` tokens of an example; its rest stays."""
        example, start = self.examples[at], int(self.start[at])
        if length == self.sizes[0, at]:
            self.examples[at] = None
            self.sizes[:, at] = _GONE
            self.free.append(at)
        else:
            self.start[at] += length
            self._measure(at)
        return example, start, length

    def _prefix(self, at: int, room: np.ndarray) -> int:
        """How many of the next tokens of an example fit in ``room``."""
        most = int(min(self.sizes[0, at], room[0]))
        loss = self.examples[at][2]
        if loss is None:
            return int(min(most, room[2]))
        start = int(self.start[at])
        borne = np.cumsum(loss[start : start + most])
        return int(np.searchsorted(borne, room[2], side="right"))

    def sequence(self) -> list[tuple[Example, int, int]]:
        """Fill one sequence: (example, start, length) of its pieces in order."""
        room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss])
        alive = self.sizes[0] != _GONE
        scaled = np.where(alive, self.sizes * self.scale[:, None], 0.0)
        weight = scaled.sum(axis=1) / max(1, alive.sum())
        placed: list[tuple[Example, int, int]] = []
        while room[0] > 0 and room[1] > 0 and alive.any():
            product = (weight * room * self.scale) @ scaled
            fits = (self.sizes <= room[:, None]).all(axis=0)
            if fits.any():
                at = int(np.argmax(np.where(fits, product, -1.0)))
                length = int(self.sizes[0, at])
            elif self.cut or not placed:
                # Without cuts only an example that no sequence holds is cut.
                at = int(np.argmax(np.where(alive, product, -1.0)))
                length = self._prefix(at, room)
                if not length:
                    break
            else:
                break
            before = self.sizes[:, at].copy()
            placed.append(self._take(at, length))
            gone = self.examples[at] is None
            alive[at] = not gone
            after = np.zeros(3, dtype=np.int64) if gone else self.sizes[:, at]
            scaled[:, at] = after * self.scale
            room -= [length, 1, int(before[2] - after[2])]
        return placed


def powers_of_two(
    pieces: list[tuple[Example, int, int]], whole: int
) -> list[list[tuple[Example, int, int]]]:
    """Cut a sequence shorter than ``whole`` into sequences whose lengths are powers of two."""
    left = sum(length for _, _, length in pieces)
    if left == whole:
        return [pieces]
    out, pieces = [], pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            example, start, length = pieces.pop()
            if length > room:
                pieces.append((example, start + room, length - room))
                length = room
            out[-1].append((example, start, length))
            room -= length
    return out


def sequences(
    examples: Iterator[Example], limits: Limits, pool: int = POOL, cut: bool = True
) -> Iterator[list[tuple[Example, int, int]]]:
    """Sequences of (example, start, length) over a stream of examples.

    The pool is packed down to its half whenever it is full.  Where cutting is allowed,
    a sequence that stays short (by the number of segments, by loss, or as the last one)
    is cut into lengths that are powers of two, which need no padding.
    """
    waiting = Pool(limits, pool, cut)

    def packed() -> Iterator[list[tuple[Example, int, int]]]:
        found = waiting.sequence()
        if not found:
            raise RuntimeError("no example fits an empty sequence")
        yield from powers_of_two(found, limits.tokens) if cut else [found]

    for example in examples:
        _, ids, loss = example
        start = 0
        if cut and loss is None:
            # What fills sequences by itself needs no pool.
            whole = min(limits.tokens, limits.loss)
            while len(ids) - start >= whole == limits.tokens:
                yield [(example, start, whole)]
                start += whole
        if start < len(ids):
            waiting.add(example, start)
        if not waiting.free:
            while len(waiting) > pool // 2:
                yield from packed()
    while len(waiting):
        yield from packed()


_COLUMNS = "start long, length long, ids binary, n_tokens long, sequence_id long, offset long"


def _pack(
    rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Example]],
    limits: Limits, pool: int, cut: bool,
) -> DataFrame:
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def examples() -> Iterator[Example]:
            for batch in batches:
                kinds[:] = [batch.schema.field("id").type]
                yield from read(batch)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [kinds[0], *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            names = ["id", "start", "length", "ids", "n_tokens", "sequence_id", "offset"]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        # As in monotonically_increasing_id: unique over partitions.
        number = TaskContext.get().partitionId() << 33
        held, size = [], 0
        for pieces in sequences(examples(), limits, pool, cut):
            offset = 0
            for (key, ids, _), start, length in pieces:
                part = ids[start : start + length].astype("<u4").tobytes()
                held.append((key, start, length, part, len(ids), number, offset))
                offset += length
                size += len(part)
            number += 1
            if size >= OUT_BYTES:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return rows.mapInArrow(run, f"id {id_type}, {_COLUMNS}")


def pack_examples(
    examples: DataFrame,
    id_col: str = "id",
    ids_col: str = "ids",
    loss_col: str | None = None,
    limits: Limits = Limits(),
    pool: int = POOL,
    cut: bool = False,
) -> DataFrame:
    """Pack tokenised examples, as of instruction data, into sequences.

    ``ids_col`` is an array of identifiers and ``loss_col`` an array of booleans of the
    same length (null: every token bears loss).  Returns (id, start, length, ids,
    n_tokens, sequence_id, offset), a row per piece: ``start`` and ``length`` in the
    example, ``ids`` packed as little-endian 32-bit numbers, ``offset`` in the
    sequence.  Unless ``cut``, only an example that exceeds a limit by itself is cut.

    An example without identifiers, or with null in their place, gives no row.  Ties go
    to the example that took the lower place of the pool.  Repeated rows, null ids and
    other columns are no matter.  The order of rows within a partition decides, so
    read from a written table where a task may run twice.
    """
    loss = F.lit(None).cast("array<boolean>") if loss_col is None else F.col(loss_col)
    rows = examples.select(
        F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"), loss.alias("loss")
    )

    def read(batch: pa.RecordBatch) -> Iterator[Example]:
        for key, ids, bears in zip(*batch.columns):
            if ids.is_valid and len(ids.values):
                found = ids.values.to_numpy(zero_copy_only=False)
                mask = np.array(bears.as_py(), dtype=bool) if bears.is_valid else None
                if mask is not None and len(mask) != len(found):
                    raise ValueError("the loss mask and the identifiers differ in length")
                yield key.as_py(), found, mask

    return _pack(rows, read, limits, pool, cut)


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None) -> Callable[[str], list[int]]:
    """Identifiers of the tokenizer file at ``path``.

    ``ranks`` names the same vocabulary as ranks, which gives the same identifiers in a
    quarter of the time; a text that holds an added token is left to the file itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)

    def plain(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return plain
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    fast = flat.encoder(ranks, flat.PATTERN).encode_ordinary

    def encode(text: str) -> list[int]:
        return plain(text) if any(t in text for t in added) else fast(text)

    return encode


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    tokenizer: str = TOKENIZER,
    ranks: str | None = RANKS,
    end: int = END,
    pool: int = POOL,
    cut: bool = True,
) -> DataFrame:
    """Tokenise whole texts and pack them; rows as those of :func:`pack_examples`.

    A document is its identifiers and then ``end``; a null or empty text is ``end``
    alone.  All tokens bear loss.  Each identifier lies in exactly one piece, however
    long the text.  With ``cut`` only sequences whose length is a power of two are
    shorter than the limit.  Null ids, repeated rows, empty tables and other columns are
    no matter.  Both paths must be readable by every executor.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def read(batch: pa.RecordBatch) -> Iterator[Example]:
        encode = encoder(tokenizer, ranks)
        for key, text in zip(*batch.columns):
            ids = np.array([*encode(text.as_py() or ""), end], dtype=np.uint32)
            yield key.as_py(), ids, None

    return _pack(rows, read, limits, pool, cut)
