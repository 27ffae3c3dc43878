"""Near-duplicate documents by SimHash, candidates by ring chains of segments.

Fingerprints of 64 bits link when at most ``budget`` bits differ.  The bits are cut
into ``budget + 1`` segments in a ring.  If two fingerprints link, some segment
starts a chain whose first l segments together differ in at most
``floor(l * budget / segments)`` bits, for every l: the first segment is equal, the
first two differ in one bit at most, the first three in two, and so on.  The first
three conditions are made equalities, in two cases:

* the second segment is equal too, so the third differs in two bits at most, and one of
  its thirds is equal;
* the second segment differs in one bit, so it is equal outside one of its quarters; the
  third differs in one bit at most, and one of its halves is equal.

That is eleven keys a segment.  The longer chains and the full distance are checked on the
rows that meet under a key.  Nothing is lost and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.components import connected_components
from gradus.storage import materialise

BITS = 64
SEED = 42
#: Fingerprints compared at once under one key; more are dealt out in pairs of blocks.
BLOCK = 2048
#: Bits of a key below its tag.
TAG_AT = 56


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text as a signed 64-bit number; 0 when there is no word."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths) + np.arange(len(found))
    n = max(1, len(found) - words + 1)
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hash_of(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=n
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, words: int = 4) -> Column:
    """Fingerprint column; whole texts, Arrow batches."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(text)


def segments(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of the ring."""
    n = budget + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _cut(segment: tuple[int, int], parts: int) -> list[tuple[int, int]]:
    at, width = segment
    cuts = [at + width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(values: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    at, width = part
    return (values >> np.uint64(at)) & np.uint64((1 << width) - 1)


@dataclass(frozen=True)
class Chain:
    """One kind of key: the bits that must be equal for two fingerprints to meet.

    ``masked`` is the quarter of the second segment that is left out, None if all of it is in
    the key.  ``own`` is the part of the third segment in the key; the ``earlier`` ones
    differ, else the pair meets under those.
    """

    tag: int
    first: tuple[int, int]
    second: tuple[int, int]
    masked: tuple[int, int] | None
    own: tuple[int, int]
    earlier: tuple[tuple[int, int], ...]


@cache
def chains(budget: int) -> dict[int, Chain]:
    """All kinds of keys by tag."""
    ring = segments(budget)
    found = []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % len(ring)]
        # A ring of two segments has no third.
        third = ring[(i + 2) % len(ring)] if len(ring) > 2 else None
        kinds = [(None, 3)] + [(quarter, 2) for quarter in _cut(second, 4)]
        for masked, parts in kinds:
            cut = _cut(third, parts) if third else [(0, 0)]
            found += [(first, second, masked, own, tuple(cut[:j])) for j, own in enumerate(cut)]
    return {tag: Chain(tag, *kind) for tag, kind in enumerate(found)}


def chain_keys(fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint: a column for each kind of key, and the tags of the columns.

    The tag stands above the bits of the key.  With a budget of 1 these are too many, and the
    highest are left out; they are compared when rows have met.
    """
    columns = []
    for tag, chain in chains(budget).items():
        after = _bits(fp, chain.second)
        if chain.masked:
            at, width = chain.masked
            after = after & ~np.uint64(((1 << width) - 1) << (at - chain.second[0]))
        value = (_bits(fp, chain.first) << np.uint64(chain.second[1])) | after
        value = (value << np.uint64(chain.own[1])) | _bits(fp, chain.own)
        columns.append((np.uint64(tag) << np.uint64(TAG_AT)) | (value & np.uint64((1 << TAG_AT) - 1)))
    return np.stack(columns, axis=1), np.array(list(chains(budget)))


def _linked(left: np.ndarray, right: np.ndarray, tag: int, budget: int) -> np.ndarray:
    """Pairs (rows of left, columns of right) that pass the ring chain and the distance.

    A pair that meets under several kinds of key from the same segment is taken under one: by
    the quarter that holds the differing bit, and the first equal part of the third segment.
    """
    ring, chain = segments(budget), chains(budget)[tag]
    first = ring.index(chain.first)
    differ = left[:, None] ^ right[None, :]
    alive = _bits(differ, chain.masked) != 0 if chain.masked else _bits(differ, chain.second) == 0
    for part in chain.earlier:
        alive &= _bits(differ, part) != 0
    rows, columns = np.nonzero(alive)
    rest = differ[rows, columns]
    spent = np.zeros(len(rows), dtype=np.int64)
    for length in range(1, len(ring) + 1):
        spent += np.bitwise_count(_bits(rest, ring[(first + length - 1) % len(ring)]))
        keep = spent <= length * budget // len(ring)
        rows, columns, rest, spent = rows[keep], columns[keep], rest[keep], spent[keep]
    return np.stack([rows, columns], axis=1)


def _forest(size: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: at most size - 1 of them say the same."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _links_under_key(
    key: int, left: np.ndarray, right: np.ndarray | None, budget: int
) -> list[tuple[int, int]]:
    """Links of one group, within ``left`` or between the two sides, as a forest."""
    other = left if right is None else right
    both = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    kept: list[tuple[int, int]] = []
    for at in range(0, len(left), 512):
        found = _linked(left[at : at + 512], other, int(key) >> TAG_AT & 255, budget)
        found[:, 0] += at
        if right is None:
            found = found[found[:, 0] < found[:, 1]]
        found[:, 1] += shift
        kept += _forest(len(both), found)
    return [(int(both[a]), int(both[b])) for a, b in _forest(len(both), np.array(kept).reshape(-1, 2))]


_LINKS = "a long, b long, key long"


def _groups(budget: int, block: int):
    """Partition function over rows sorted by key: links, or the rows of a large group.

    At most ``block`` fingerprints of one key are held; a larger group is passed on
    whole, in arrays, to be dealt out over many tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, large = None, np.empty(0, dtype=np.int64), False

        def close() -> list[tuple[int, int]]:
            return [] if large or len(held) < 2 else _links_under_key(key, held.view(np.uint64), None, budget)

        for batch in batches:
            if not len(batch):
                continue
            links: list[tuple[int, int]] = []
            passed: list[tuple[int, np.ndarray]] = []
            keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes = np.diff(cuts)
            # Alone under its key: nothing to compare, unless the batch cuts its group.
            several = sizes > 1
            several[[0, -1]] = True
            for at, n in zip(cuts[:-1][several].tolist(), sizes[several].tolist()):
                if keys[at] != key:
                    links += close()
                    key, held, large = keys[at], np.empty(0, dtype=np.int64), False
                own = fps[at : at + n]
                if not large and len(held) + n > block:
                    passed.append((key, held))
                    held, large = held[:0], True
                if large:
                    passed.append((key, own))
                else:
                    held = np.concatenate([held, own])
            if links:
                yield _links_frame(links)
            for at_key, rows in passed:
                yield pd.DataFrame({"a": rows, "b": _NONE.repeat(len(rows)), "key": at_key})
        if rest := close():
            yield _links_frame(rest)

    return run


_NONE = pd.array([None], dtype="Int64")


def _links_frame(links: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "key": _NONE.repeat(len(pairs))})


def _explode_keys(budget: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                keys, _ = chain_keys(part.view(np.uint64), budget)
                yield pd.DataFrame(
                    {"key": keys.view(np.int64).ravel(), "fp": np.repeat(part, keys.shape[1])}
                )

    return run


def _large_groups(rows: DataFrame, budget: int, block: int) -> DataFrame:
    """Links of the groups above ``block``: every pair of their blocks in a task of its own."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = (
        rows.join(sizes, "key")
        .withColumn("own", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            "key", "a", "own",
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        )
    )

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        i, j, key = group["i"].iat[0], group["j"].iat[0], int(group["key"].iat[0])
        fps = group["a"].to_numpy().view(np.uint64)
        own = group["own"].to_numpy()
        sides = (fps, None) if i == j else (fps[own == i], fps[own == j])
        found = _links_under_key(key, *sides, budget)
        return _links_frame(found)

    return dealt.groupBy("key", "i", "j").applyInPandas(pairs, _LINKS)


def simhash_links(fingerprints: DataFrame, budget: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct values of column ``fp`` that join all its classes.

    Not every linked pair is listed: under each key a spanning forest is, so copies
    in thousands give links in proportion to their number.
    """
    if not 1 <= budget <= 15:
        raise ValueError("budget must be 1 to 15 bits")
    keyed = fingerprints.select("fp").where("fp IS NOT NULL").distinct()
    keyed = keyed.mapInPandas(_explode_keys(budget), "key long, fp long")
    found = materialise(
        keyed.repartition("key")
        .sortWithinPartitions("key")
        .mapInPandas(_groups(budget, block), _LINKS),
        "simhash",
    )
    links = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL").select("a", "key")
    if large.limit(1).count():
        links = links.union(_large_groups(large, budget, block).select("a", "b"))
    return links


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    budget: int = 4,
    block: int = BLOCK,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, fingerprint, component_id, kept) for each row, and the columns of ``keep``.

    A null or blank text has fingerprint 0 and links as any other fingerprint.
    ``kept`` holds for one row of each class: that of the smallest id, and the first
    written of those if ids repeat.  A null id comes after all others; a class of such
    rows only has a null component.  Repeated rows stay, and an empty table gives an
    empty result.  Building the frame runs the passes up to the components; the
    fingerprints (and ``keep``) are written to the shared folder, so texts are read once.
    """
    own = materialise(
        docs.select(
            F.col(id_col).alias("_id"),
            *keep,
            fingerprint_column(F.col(text_col), words).alias("_fp"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "fingerprints",
    )
    classes = connected_components(
        simhash_links(own.select(F.col("_fp").alias("fp")), budget, block), "a", "b"
    )
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    least = own.groupBy("_fp").agg(F.min(first).alias("_least"))
    rooted = materialise(
        least.join(classes, F.col("_fp") == F.col("node"), "left").select(
            "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
        ),
        "rooted",
    )
    # Written, so that a root of many fingerprints can be split when it is joined.
    by_root = materialise(
        rooted.groupBy(F.col("_root").alias("_top")).agg(F.min("_least").alias("_first")), "roots"
    )
    of_fp = rooted.join(by_root, F.col("_root") == F.col("_top")).select(
        F.col("_fp").alias("_of"), F.col("_first.id").alias("_component"), F.col("_first.row").alias("_kept")
    )
    return own.join(materialise(of_fp, "classes"), F.col("_fp") == F.col("_of"), "left").select(
        F.col("_id").alias(id_col),
        *keep,
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
        (F.col("_row") == F.col("_kept")).alias("kept"),
    )
