"""Ranked lexical search with Block-Max MaxScore.

The index is made where the texts are read: a task turns its documents into shards of a
bounded number of tokens, and every list of a shard into blocks of 128 postings.  A
block keeps, beside its packed postings, the pairs (occurrences, document length) that no
other posting of the block beats in both, so the exact maximum of its scores follows for
whatever totals the collection turns out to have.

A search reads the lists of the queries' terms, shard by shard.  Global bounds split the
lists of a query into essential ones, whose documents are scored, and the rest, in which a
candidate is first rejected by the maximum of the block it would stand in, and only
blocks with candidates left are unpacked.  The heaps of the shards are merged.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.storage import materialise

BLOCK = 128
#: A shard is closed at so many tokens or documents.
SHARD_TOKENS = 2_000_000
SHARD_DOCS = 1 << 15
#: Queries that are searched for at once.
QUERIES = 1024
#: ASCII characters that end a term become spaces, A-Z become a-z.
_TERMS = bytes(
    (c | 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)
)
_HEAD = np.dtype(
    [("first", "<u4"), ("last", "<u4"), ("at", "<u4"), ("front", "<u4")]
    + [("count", "<u2"), ("gap", "u1"), ("wide", "u1")]
)
_INDEX = "shard long, term string, df long, total long, head binary, front binary, data binary"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def _width(values: np.ndarray) -> np.ndarray:
    """Bytes each value takes: 1, 2 or 4."""
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4)).astype(np.uint8)


def _spread(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Write each value with its width at its place."""
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    for byte in range(4):
        rows = width > byte
        out[at[rows] + byte] = data[rows, byte]


def _sliced(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of ``data``, from 0 to each of ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


def pack_lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple:
    """Blocks of postings sorted by (term, doc): (heads, fronts, data) and the ends of each list in them."""
    size = len(term)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    place = np.arange(size) - np.repeat(starts, np.diff(np.r_[starts, size]))
    opens = np.flatnonzero(place % BLOCK == 0)
    count = np.diff(np.r_[opens, size])
    block = np.repeat(np.arange(len(opens)), count)
    gaps = np.diff(doc, prepend=0)
    gaps[opens] = 0
    gap, wide = (_width(np.maximum.reduceat(v, opens)) for v in (gaps, tf))
    # Each block is its gaps and then its occurrences.
    nbytes = count * (gap.astype(np.int64) + wide)
    block_at = np.cumsum(nbytes) - nbytes
    data = np.zeros(int(nbytes.sum()), dtype=np.uint8)
    within = np.arange(size) - opens[block]
    _spread(data, block_at[block] + within * gap[block], gaps, gap[block])
    _spread(data, (block_at + count * gap)[block] + within * wide[block], tf, wide[block])
    # In order of growing length, what has more occurrences than all before stays.
    order = np.lexsort((-tf, n, block))
    rising = tf[order] + block[order] * (int(tf.max()) + 1)
    best = np.maximum.accumulate(rising)
    kept = np.r_[True, best[1:] > best[:-1]]
    front = np.stack([tf[order][kept], n[order][kept]], axis=1).astype("<u4")
    front_ends = np.searchsorted(block[order][kept], np.arange(len(opens)), side="right")
    heads = np.zeros(len(opens), dtype=_HEAD)
    last_block = np.r_[np.flatnonzero(np.isin(opens, starts))[1:], len(opens)]
    first_block = np.r_[0, last_block[:-1]]
    list_of = np.repeat(np.arange(len(starts)), last_block - first_block)
    data_ends = np.r_[block_at, len(data)][last_block]
    front_lists = front_ends[last_block - 1]
    heads["first"], heads["last"] = doc[opens], doc[opens + count - 1]
    heads["at"] = block_at - np.r_[0, data_ends[:-1]][list_of]
    heads["front"] = front_ends - np.r_[0, front_lists[:-1]][list_of]
    heads["count"], heads["gap"], heads["wide"] = count, gap, wide
    return (heads, last_block), (front, front_lists), (data, data_ends)


class _Shard:
    """Documents of a shard while it is made."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.parts: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.tokens = 0

    def add(self, key: int | None, words: list[bytes]) -> None:
        found = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        self.parts.append(found << 32 | len(self.ids))
        self.ids.append(key)
        self.tokens += len(words)

    def full(self) -> bool:
        return self.tokens >= SHARD_TOKENS or len(self.ids) >= SHARD_DOCS

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(p) for p in self.parts], dtype="<i8")
        known = np.array([key is not None for key in self.ids])
        ids = np.array([key or 0 for key in self.ids], dtype="<i8")
        yield _rows(
            [number], pa.array([None], pa.string()), [int((lengths > 0).sum())], [int(lengths.sum())],
            *(pa.array([part.tobytes()], pa.binary()) for part in (lengths, known, ids)),
        )
        if not self.tokens:
            return
        keys, tf = np.unique(np.concatenate(self.parts), return_counts=True)
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        heads, fronts, data = pack_lists(term, doc, tf, lengths[doc])
        df = np.bincount(term, minlength=len(self.known))
        yield _rows(
            np.full(len(df), number),
            pa.array([w.decode("utf-8", "replace") for w in self.known], pa.string()),
            df,
            np.zeros(len(df), dtype=np.int64),
            _sliced(heads[0].view(np.uint8), heads[1] * _HEAD.itemsize),
            _sliced(fronts[0].view(np.uint8).ravel(), fronts[1] * 8),
            _sliced(*data),
        )


def _rows(shard, term, df, total, head, front, data) -> pa.RecordBatch:
    numbers = (pa.array(v, pa.int64()) for v in (shard, df, total))
    shard, df, total = numbers
    return pa.RecordBatch.from_arrays(
        [shard, term, df, total, head, front, data],
        names=["shard", "term", "df", "total", "head", "front", "data"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of whole texts: a row per shard and term, and one per shard for its documents.

    Nothing is shuffled: a task makes the shards of the rows it reads.  A null or blank text
    has no term and is never found; a null id stays null; a repeated row is a document of its own.
    Identifiers are 64-bit numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        shard = _Shard()
        for batch in batches:
            for key, text in zip(*batch.columns):
                shard.add(key.as_py(), terms_of(text.as_py()))
                if shard.full():
                    yield from shard.batches(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.batches(number)

    return materialise(rows.mapInArrow(make, _INDEX), "lexical")


class _List:
    """A list of a shard; its blocks are unpacked when they are asked for."""

    def __init__(self, head: bytes, front: bytes, data: bytes, docs: _Docs) -> None:
        self.head = np.frombuffer(head, dtype=_HEAD)
        self.data, self.docs = data, docs
        points = np.frombuffer(front, dtype="<u4").reshape(-1, 2).astype(np.int64)
        starts = np.r_[0, self.head["front"][:-1]].astype(np.int64)
        self.most = np.maximum.reduceat(_saturated(points[:, 0], docs.norm(points[:, 1])), starts)
        self.bound = int(self.most.max())
        self.last, self.first = self.head["last"].astype(np.int64), self.head["first"].astype(np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.all: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what each scores per weight."""
        if i not in self.open:
            first, _, at, _, count, gap, wide = self.head[i].item()
            gaps = np.frombuffer(self.data, f"<u{gap}", count, at)
            tf = np.frombuffer(self.data, f"<u{wide}", count, at + count * gap)
            found = np.cumsum(gaps, dtype=np.int64) + first
            self.open[i] = found, _saturated(tf.astype(np.int64), self.docs.m[found])
        return self.open[i]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            blocks = [self.block(i) for i in range(len(self.head))]
            self.all = blocks[0] if len(blocks) == 1 else tuple(map(np.concatenate, zip(*blocks)))
            self.open = {}
        return self.all


class _Docs:
    """Identifiers of the documents of a shard and the norms of their lengths."""

    def __init__(self, lengths: bytes, known: bytes, ids: bytes, n_docs: int, n_terms: int) -> None:
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.known = np.frombuffer(known, dtype=bool)
        self.n_docs, self.n_terms = n_docs, max(1, n_terms)
        self.m = self.norm(np.frombuffer(lengths, dtype="<i8"))

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 50 + (50 * n.astype(np.int64) * self.n_docs) // self.n_terms


def _saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term scores per weight: grows with its occurrences, falls with the length."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Heap:
    """The best ``k`` of one query so far: largest score, then known and smallest id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.null = np.empty(0, dtype=bool)

    @property
    def floor(self) -> int:
        """No document below this score can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (
            np.concatenate(pair) for pair in ((self.scores, scores), (self.ids, ids), (self.null, null))
        )
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def search_shard(
    docs: _Docs, lists: dict[str, _List], query: list[tuple[str, int]], heap: Heap, scores: np.ndarray
) -> None:
    """Add the documents of a shard that can enter the heap; ``scores`` is zero before and after."""
    held = [(w * lists[t].bound, w, lists[t]) for t, w in query if w and t in lists]
    held.sort(key=lambda x: -x[0])
    rest = np.cumsum([0, *(x[0] for x in held[::-1])])[::-1]
    floor = heap.floor
    if not held or rest[0] < floor:
        return
    # What no essential list holds cannot reach the floor.
    essential = int(np.count_nonzero(rest >= floor))
    for _, w, posted in held[:essential]:
        found, each = posted.whole()
        scores[found] += w * each
    candidates = np.flatnonzero(scores)
    totals = scores[candidates]
    scores[candidates] = 0
    for i in range(essential, len(held)):
        keep = totals + rest[i] >= floor
        candidates, totals = candidates[keep], totals[keep]
        if not len(candidates):
            return
        _, w, posted = held[i]
        block = np.searchsorted(posted.last, candidates)
        inside = block < len(posted.last)
        inside[inside] = posted.first[block[inside]] <= candidates[inside]
        most = np.where(inside, w * posted.most[np.where(inside, block, 0)], 0)
        alive = totals + most + rest[i + 1] >= floor
        candidates, totals, block, inside = (x[alive] for x in (candidates, totals, block, inside))
        asked = np.flatnonzero(inside)
        for at in np.unique(block[asked]):
            rows = asked[block[asked] == at]
            found, each = posted.block(int(at)) if posted.all is None else posted.whole()
            place = np.minimum(np.searchsorted(found, candidates[rows]), len(found) - 1)
            hit = found[place] == candidates[rows]
            totals[rows[hit]] += w * each[place[hit]]
    keep = totals >= floor
    if keep.any():
        candidates = candidates[keep]
        heap.add(totals[keep], docs.ids[candidates], ~docs.known[candidates])


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item."""
    rows = queries.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*batch.columns):
                words = [w.decode("utf-8", "replace") for w in set(terms_of(text.as_py()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(words), pa.int64()), pa.array(words, pa.string())],
                    names=["item", "term"],
                )

    return rows.where("item IS NOT NULL").mapInArrow(split, "item long, term string").distinct()


def _search_block(
    index: DataFrame, weighted: DataFrame, n_docs: int, n_terms: int, k: int
) -> DataFrame:
    """(item, id, score): the best of each task for one block of queries."""
    spark = index.sparkSession
    queries: dict[int, list[tuple[str, int]]] = defaultdict(list)
    for row in weighted.toLocalIterator():
        queries[row.item].append((row.term, row.weight))
    asked = spark.sparkContext.broadcast(dict(queries))
    terms = weighted.select(F.col("term").alias("_t")).distinct()
    lists = index.where("term IS NOT NULL").join(terms, F.col("term") == F.col("_t"), "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        lists.unionByName(index.where("term IS NULL"))
        .select("shard", "term", "head", "front", "data")
        .repartition(parts, "shard")
        .sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {item: Heap(k) for item in asked.value}
        docs: _Docs | None = None
        lists: dict[str, _List] = {}

        def search() -> None:
            if docs is not None and lists:
                scores = np.zeros(len(docs.ids), dtype=np.int64)
                for item, query in asked.value.items():
                    search_shard(docs, lists, query, heaps[item], scores)

        for batch in batches:
            for term, head, front, data in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if term is None:
                    # The first row of the next shard.
                    search()
                    docs, lists = _Docs(head, front, data, n_docs, n_terms), {}
                else:
                    lists[term] = _List(head, front, data, docs)
        search()
        for item, heap in heaps.items():
            if len(heap.ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(heap.ids), pa.int64()),
                        pa.array(heap.ids, pa.int64(), mask=heap.null),
                        pa.array(heap.scores, pa.int64()),
                    ],
                    names=["item", "id", "score"],
                )

    return rows.mapInArrow(run, "item long, id long, score long")


def search(
    index: DataFrame,
    queries: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    k: int = 50,
    at_once: int = QUERIES,
) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each query, of score above 0.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's norm m is
    50 + (50 n N) div L, and it scores the sum of weight * ((10^9 tf) div (1000 tf + 20 m)) over
    the distinct terms of the query, in 64-bit integers.  Equal scores rank by ascending id,
    null ids last.  Queries of one id are one query; a null id or a blank text finds nothing.
    The queries come to the driver in blocks of about ``at_once``; each block is searched in one pass.
    """
    totals = index.where("term IS NULL").agg(F.sum("df").alias("n"), F.sum("total").alias("l")).first()
    n_docs, n_terms = totals.n or 0, totals.l or 0
    asked = materialise(_query_terms(queries, id_col, text_col), "query-terms")
    of_query = asked.select("term").distinct()
    df = (
        index.where("term IS NOT NULL").select("term", "df")
        .join(of_query, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    )
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    blocks = math.ceil(asked.select("item").distinct().count() / at_once)
    weighted = materialise(
        asked.join(df, "term").select(
            "item", "term", weight.cast("long").alias("weight"),
            F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))).alias("block"),
        ),
        "query-weights",
    )
    best = None
    for block in range(max(1, blocks)):
        part = _search_block(index, weighted.where(F.col("block") == block), n_docs, n_terms, k)
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item", "rank", "id", "score")
    )
