"""Near copies among embeddings by randomly rotated binary codes.

A unit vector is rotated at random and each component replaced by its sign.  With the
stored correction factor f = <code, vector>, <code, query> / f estimates the inner
product with any query without bias, and its error stays, but for a vanishing chance,
within ``width`` standard deviations sqrt((1 - f^2) / f^2 / (d - 1)).  Only pairs
whose interval reaches the threshold are computed exactly.

The query is held in four bits a component, so an estimate is a few counts of set bits in
64-bit words.  Codes, factors and quantised queries are all that meets in buckets at first;
vectors are fetched for those rows only that have a pair whose interval reaches the threshold.

Pairs meet in buckets: the largest component (and its sign) of further rotations.
Vectors close in angle have the same largest component with high probability; the
number of tables makes the chance that a pair at the threshold never meets ``miss``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.components import connected_components
from gradus.llm.vectors import norms, rotation, takes_part
from gradus.storage import materialise

SEED = 20_240
#: Rows of a bucket that are compared in one task; more are dealt out in pairs of blocks.
BLOCK = 2048
#: Hashes of a key at most, and rows that should meet under one.
MOST_HASHES = 3
PER_BUCKET = 64
#: Bits a component of a query.
QUERY_BITS = 4
BUCKET = ["label", "dim", "table", "key"]
_FOUND = "a long, b long, n long, label long, dim int, table int, key long"


def hashes_for(rows: int, dim: int, per_bucket: int = PER_BUCKET) -> int:
    """Hashes per key for the largest set of vectors compared with each other."""
    hashes = 1
    while hashes < MOST_HASHES and (2 * dim) ** hashes * per_bucket < rows:
        hashes += 1
    return hashes


@functools.lru_cache(maxsize=64)
def agreement(dim: int, threshold: float, pairs: int = 40_000) -> float:
    """Chance that two vectors of cosine ``threshold`` agree in one hash.

    Simulated with a fixed seed and rounded down by three standard errors.
    """
    rng, agreed, cosine = np.random.default_rng([SEED, dim]), 0, min(max(threshold, -1.0), 1.0)
    for at in range(0, pairs, 4000):
        x, y = rng.standard_normal((2, min(4000, pairs - at), dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        if dim > 1:
            y -= (x * y).sum(axis=1)[:, None] * x
            y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1)[:, None]
        else:
            y = x
        rows, top, other = np.arange(len(x)), np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
        agreed += int(((top == other) & (x[rows, top] * y[rows, top] > 0)).sum())
    p = agreed / pairs
    return min(max(p - 3 * math.sqrt(p * (1 - p) / pairs), 1e-3), 0.999)


def tables_for(dim: int, hashes: int, threshold: float, miss: float) -> int:
    """Tables with which a pair at the threshold never meets with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - agreement(dim, threshold) ** hashes))


def bucket_keys(unit: np.ndarray, hashes: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables) keys: the largest components of ``hashes`` rotations each."""
    dim = unit.shape[1]
    keys = np.zeros((len(unit), tables), dtype=np.int64)
    for t in range(tables):
        for h in range(hashes):
            turned = unit @ rotation(dim, seed + 1 + t * hashes + h)
            top = np.abs(turned).argmax(axis=1)
            keys[:, t] = keys[:, t] * (2 * dim) + 2 * top + (turned[np.arange(len(unit)), top] > 0)
    return keys


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of the rotated vectors, and their correction factors."""
    turned = unit @ rotation(unit.shape[1], seed)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    return np.packbits(turned > 0, axis=1), factor


def quantise(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors in ``QUERY_BITS`` bits a component: packed planes, lowest value and step."""
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = [np.packbits(levels >> b & 1, axis=1) for b in range(QUERY_BITS)]
    return np.concatenate(planes, axis=1), low, step


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as 64-bit words, filled up with zeros."""
    fill = -rows.shape[1] % 8
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, fill)))).view(np.uint64)


class Codes:
    """Codes and quantised queries of the rows of one bucket."""

    def __init__(self, part: pd.DataFrame, dim: int) -> None:
        self.dim = dim
        self.ids = part["class"].to_numpy()
        nbytes = (dim + 7) // 8
        packed = np.frombuffer(b"".join(part["code"]), dtype=np.uint8).reshape(len(part), -1)
        self.code = _words(packed[:, :nbytes])
        self.planes = np.stack(
            [_words(packed[:, nbytes * (b + 1) : nbytes * (b + 2)]) for b in range(QUERY_BITS)], axis=1
        )
        self.factor, self.low, self.step = (part[c].to_numpy() for c in ("factor", "low", "step"))
        ones = np.bitwise_count(self.planes).sum(axis=2, dtype=np.int64) @ (1 << np.arange(QUERY_BITS))
        #: The sum of the components of the quantised query.
        self.total = self.low * dim + self.step * ones

    def take(self, rows) -> Codes:
        part = object.__new__(type(self))
        part.__dict__ = {k: v[rows] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return part


def upper_bounds(coded: Codes, query: Codes, width: float) -> np.ndarray:
    """Upper confidence bounds of the inner products, (query, coded), by counting bits."""
    counts = np.zeros((len(query.ids), len(coded.ids)))
    for b in range(QUERY_BITS):
        for w in range(coded.code.shape[1]):
            both = query.planes[:, b, w, None] & coded.code[None, :, w]
            counts += np.bitwise_count(both) * float(1 << b)
    ones = np.bitwise_count(coded.code).sum(axis=1, dtype=np.int64)
    product = 2 * (query.low[:, None] * ones[None, :] + query.step[:, None] * counts) - query.total[:, None]
    f = coded.factor[None, :]
    # The error of the code, and that of rounding each component to the nearest step.
    spread = np.maximum(1 - f**2, 0) / max(1, coded.dim - 1) + (query.step[:, None] ** 2) / 12
    return (product / math.sqrt(coded.dim) + width * np.sqrt(spread)) / f


def may_link(left: Codes, right: Codes, threshold: float, width: float) -> np.ndarray:
    """Pairs whose intervals, either way, reach the threshold."""
    near = upper_bounds(right, left, width) >= threshold
    rows, columns = np.nonzero(near)
    if len(rows) * 4 < near.size:
        # Few are left: the other way is looked at pair by pair.
        back = np.empty(len(rows), dtype=bool)
        for at in range(0, len(rows), 1 << 16):
            i, j = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            back[at : at + (1 << 16)] = _pairwise(left.take(i), right.take(j), width) >= threshold
        near[rows[~back], columns[~back]] = False
        return near
    return near & (upper_bounds(left, right, width).T >= threshold)


def _pairwise(coded: Codes, query: Codes, width: float) -> np.ndarray:
    """As :func:`upper_bounds`, row by row."""
    counts = np.zeros(len(coded.ids))
    for b in range(QUERY_BITS):
        counts += np.bitwise_count(query.planes[:, b] & coded.code).sum(axis=1, dtype=np.int64) * float(1 << b)
    ones = np.bitwise_count(coded.code).sum(axis=1, dtype=np.int64)
    product = 2 * (query.low * ones + query.step * counts) - query.total
    spread = np.maximum(1 - coded.factor**2, 0) / max(1, coded.dim - 1) + query.step**2 / 12
    return (product / math.sqrt(coded.dim) + width * np.sqrt(spread)) / coded.factor


class Rows(Codes):
    """As codes, with the vectors and their keys of all tables."""

    def __init__(self, part: pd.DataFrame, dim: int) -> None:
        super().__init__(part, dim)
        self.copies = part["copies"].to_numpy()
        self.keys = np.frombuffer(b"".join(part["keys"]), dtype=np.int64).reshape(len(part), -1)
        vectors = np.array(part["vector"].tolist(), dtype=np.float64)
        self.unit = vectors / norms(vectors)[:, None]


def candidates(left: Codes, right: Codes | None, table: int, threshold: float, width: float) -> pd.DataFrame:
    """Rows of a bucket that have a pair whose interval reaches the threshold, as (a)."""
    other = left if right is None else right
    here, there = np.zeros(len(left.ids), dtype=bool), np.zeros(len(other.ids), dtype=bool)
    for at in range(0, len(left.ids), 256):
        part = left.take(slice(at, at + 256))
        near = may_link(part, other, threshold, width)
        if right is None:
            near[np.arange(len(part.ids)), np.arange(at, at + len(part.ids))] = False
        here[at : at + 256] |= near.any(axis=1)
        there |= near.any(axis=0)
    found = np.concatenate([left.ids[here | there]] if right is None else [left.ids[here], right.ids[there]])
    nothing = pd.array([None] * len(found), dtype="Int64")
    return pd.DataFrame({"a": found.astype(np.int64), "b": nothing, "n": nothing})


def compare(left: Rows, right: Rows | None, table: int, threshold: float, width: float) -> pd.DataFrame:
    """Numbers of links per vector, and links that join the same classes as all do.

    A pair that also meets in an earlier table is left to that one.
    """
    other = left if right is None else right
    ids = left.ids if right is None else np.concatenate([left.ids, other.ids])
    shift = 0 if right is None else len(left.ids)
    counts = np.zeros(len(ids), dtype=np.int64)
    root = np.arange(len(ids))
    links: list[tuple[int, int]] = []
    for at in range(0, len(left.ids), 256):
        part = left.take(slice(at, at + 256))
        near = may_link(part, other, threshold, width)
        if right is None:
            near &= np.arange(len(other.ids))[None, :] > np.arange(at, at + len(part.ids))[:, None]
        rows, columns = np.nonzero(near)
        for start in range(0, len(rows), 1 << 16):
            i, j = rows[start : start + (1 << 16)], columns[start : start + (1 << 16)]
            # The exact decision, in double precision.
            keep = np.einsum("ij,ij->i", part.unit[i], other.unit[j]) >= threshold
            i, j = i[keep], j[keep]
            if table:
                keep = ~(part.keys[i, :table] == other.keys[j, :table]).any(axis=1)
                i, j = i[keep], j[keep]
            np.add.at(counts, at + i, other.copies[j])
            np.add.at(counts, shift + j, part.copies[i])
            own, theirs = at + i, shift + j
            while len(own := own[differ := root[own] != root[theirs]]):
                theirs = theirs[differ]
                a, b = int(own[0]), int(theirs[0])
                links.append((int(ids[a]), int(ids[b])))
                root[root == root[b]] = root[a]
    linked = np.flatnonzero(counts)
    return pd.DataFrame(
        {
            "a": np.r_[ids[linked], [a for a, _ in links]].astype(np.int64),
            "b": pd.array([None] * len(linked) + [b for _, b in links], dtype="Int64"),
            "n": pd.array([*counts[linked].tolist()] + [None] * len(links), dtype="Int64"),
        }
    )


def _with_bucket(frame: pd.DataFrame, bucket: tuple | None) -> pd.DataFrame:
    values = bucket or (None,) * 4
    for name, value in zip(BUCKET, values):
        frame[name] = pd.array([value] * len(frame), dtype="Int64")
    return frame


def _bucket_stream(make, work, threshold: float, width: float, block: int):
    """Partition function over rows sorted by bucket: ``work`` on the rows ``make`` holds.

    A bucket above ``block`` is only named.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket: tuple | None = None
        held: list[pd.DataFrame] = []
        large = False

        def close() -> Iterator[pd.DataFrame]:
            if large:
                one = pd.DataFrame({n: pd.array([None], dtype="Int64") for n in ("a", "b", "n")})
                yield _with_bucket(one, bucket)
            elif sum(map(len, held)) > 1:
                rows = make(pd.concat(held), bucket[1])
                found = work(rows, None, bucket[2], threshold, width)
                if len(found):
                    yield _with_bucket(found, bucket if work is candidates else None)

        for batch in batches:
            if not len(batch):
                continue
            places = batch[BUCKET].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1), True])
            several = np.diff(cuts) > 1
            several[[0, -1]] = True
            for at, to in zip(cuts[:-1][several], cuts[1:][several]):
                own = tuple(int(v) for v in places[at])
                if own != bucket:
                    yield from close()
                    bucket, held, large = own, [], False
                if not large:
                    held.append(batch.iloc[at:to])
                    if sum(map(len, held)) > block:
                        held, large = [], True
        yield from close()

    return run


def _large_buckets(
    keyed: DataFrame, large: DataFrame, make, work, threshold: float, width: float, block: int
) -> DataFrame:
    """The buckets above ``block``: every pair of their blocks is a task of its own."""
    rows = keyed.join(large, BUCKET, "left_semi")
    sizes = rows.groupBy(*BUCKET).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = (
        rows.join(sizes, BUCKET)
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("blocks", "other")
    )

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        dim, table = int(group["dim"].iat[0]), int(group["table"].iat[0])
        i, j = group["i"].iat[0], group["j"].iat[0]
        own = group["own"].to_numpy()
        left = group[own == i]
        right = None if i == j else group[own == j]
        if not len(left) or (right is not None and not len(right)):
            found = pd.DataFrame({n: pd.array([], dtype="Int64") for n in ("a", "b", "n")})
        else:
            others = None if right is None else make(right, dim)
            found = work(make(left, dim), others, table, threshold, width)
        return _with_bucket(found, tuple(int(group[c].iat[0]) for c in BUCKET) if work is candidates else None)

    return dealt.groupBy(*BUCKET, "i", "j").applyInPandas(pairs, _FOUND)


def _met(keyed: DataFrame, make, work, threshold: float, width: float, block: int) -> DataFrame:
    """What ``work`` finds in all buckets; those above ``block`` are dealt out in pairs of blocks."""
    found = materialise(
        keyed.repartition(*BUCKET)
        .sortWithinPartitions(*BUCKET)
        .mapInPandas(_bucket_stream(make, work, threshold, width, block), _FOUND),
        "vector-links",
    )
    large = found.where("a IS NULL").select(*BUCKET)
    found = found.where("a IS NOT NULL")
    if large.limit(1).count():
        more = _large_buckets(keyed, large, make, work, threshold, width, block)
        found = found.unionByName(materialise(more, "vector-links"))
    return found


_CODE = ["class", "code", "factor", "low", "step"]
_CODED = "class long, code binary, factor double, low double, step double"


def _keyed(classes: DataFrame, plan: dict[int, tuple[int, int]], seed: int) -> DataFrame:
    """The code of each distinct vector under its bucket of every table; ``plan`` has (hashes, tables) by length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                hashes, tables = plan[dim]
                for at in range(0, len(part), 1024):
                    piece = part.iloc[at : at + 1024]
                    wide, keys = _coded(piece, dim, hashes, tables, seed)
                    out = wide.loc[wide.index.repeat(tables)].reset_index(drop=True)
                    out["table"] = np.tile(np.arange(tables, dtype=np.int32), len(piece))
                    out["key"] = keys.ravel()
                    yield out[[*BUCKET, *_CODE]]

    schema = f"label long, dim int, table int, key long, {_CODED}"
    return classes.select("label", "dim", "class", "vector").mapInPandas(run, schema)


def _coded(piece: pd.DataFrame, dim: int, hashes: int, tables: int, seed: int) -> tuple[pd.DataFrame, np.ndarray]:
    vectors = np.array(piece["vector"].tolist(), dtype=np.float64)
    unit = vectors / norms(vectors)[:, None]
    codes, factors = encode(unit, seed)
    planes, low, step = quantise(unit @ rotation(dim, seed))
    packed = np.concatenate([codes, planes], axis=1)
    wide = piece[["label", "dim", "class"]].assign(
        code=[c.tobytes() for c in packed], factor=factors, low=low, step=step
    )
    return wide, bucket_keys(unit, hashes, tables, seed)


def _with_vectors(met: DataFrame, classes: DataFrame, plan: dict[int, tuple[int, int]], seed: int) -> DataFrame:
    """The rows of buckets that have candidates, with codes, keys and vectors."""
    rows = met.select("table", "key", F.col("a").alias("class")).distinct()
    held = rows.join(classes.select("label", "dim", "class", "copies", "vector"), "class")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                hashes, tables = plan[dim]
                for at in range(0, len(part), 1024):
                    piece = part.iloc[at : at + 1024].reset_index(drop=True)
                    wide, keys = _coded(piece, dim, hashes, tables, seed)
                    wide["keys"] = [k.tobytes() for k in keys]
                    yield pd.concat([wide, piece[["table", "key", "copies", "vector"]]], axis=1)[
                        [*BUCKET, *_CODE, "copies", "vector", "keys"]
                    ]

    schema = f"label long, dim int, table int, key long, {_CODED}, copies long, vector array<double>, keys binary"
    return held.select("label", "dim", "table", "key", "class", "copies", "vector").mapInPandas(run, schema)


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    miss: float = 1e-9,
    width: float = 6.0,
    seed: int = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every vector.

    Two vectors link when their labels are equal and not null, their lengths are
    equal, and their cosine in double precision is at least ``threshold``.  Vectors
    that are null, empty, zero or hold null or non-finite components, and vectors of
    null label, link with nothing: 0 links, their own class, kept.  Equal vectors are
    compared once and counted as often as they occur.  Repeated ids are vectors of
    their own; a null id takes no part in the choice of the smallest id.  An empty
    table gives an empty result.

    All links are exact.  A pair at the threshold is missed with a chance of about
    ``miss`` (never meets) plus that of an error of ``width`` standard deviations.
    """
    own = materialise(
        vectors.select(
            F.col(id_col).alias("id"),
            F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).cast("array<double>").alias("vector"),
            (takes_part(F.col(vector_col)) & F.col(label_col).isNotNull()).alias("ok"),
        ),
        "vectors",
    )
    classes = materialise(
        own.where("ok")
        .groupBy("label", "vector")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least"))
        .withColumn("dim", F.size("vector"))
        .withColumn("class", F.monotonically_increasing_id()),
        "vector-classes",
    )
    sizes = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("rows")).collect()
    if not sizes:
        found = None
    else:
        # One row per length of vectors.
        plan = {}
        for r in sizes:
            hashes = hashes_for(r.rows, r.dim)
            plan[r.dim] = hashes, tables_for(r.dim, hashes, threshold, miss)
        met = _met(_keyed(classes, plan, seed), Codes, candidates, threshold, width, block)
        found = _met(_with_vectors(met, classes, plan, seed), Rows, compare, threshold, width, block)
        links = found.where("b IS NOT NULL")
        counts = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    if found is None:
        return own.select(
            F.col("id").alias(id_col),
            F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    roots = connected_components(links, "a", "b")
    linked = (
        classes.join(counts, F.col("class") == F.col("a"), "left")
        .join(roots, F.col("class") == F.col("node"), "left")
        .select(
            "label", "vector", "least",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("root", "class").alias("root"),
        )
    )
    linked = materialise(linked, "vector-classes")
    smallest = materialise(linked.groupBy("root").agg(F.min("least").alias("component")), "roots")
    of_vector = materialise(
        linked.join(smallest, "root").select(
            F.col("label").alias("l"), F.col("vector").alias("v"), "n_links", "component"
        ),
        "vector-classes",
    )
    joined = own.join(
        of_vector, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left"
    )
    component = F.when(F.col("n_links").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
