"""Spelling variants: words one edit apart, found by Bloom filters of the vocabulary.

Every word generates its edits (deletions, and replacements by a later code point; the
other directions are the same pairs read backwards).  An edit is first probed against a
broadcast blocked Bloom filter of the words of its length; only what the filter passes is
written out and shuffled to an exact join with the vocabulary.  Hashes are
polynomials of the code points, so the hashes of all edits of a word come from its
prefix and suffix sums, in NumPy.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.storage import materialise

#: Letters of a word after lower-casing A-Z.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Words a task counts before it hands the counts over.
COUNTED = 400_000
#: Bits a word, bits set, and the bound of the whole filter (64 MiB) in blocks of 64 bits.
BITS_PER_WORD = 24
HASHES = 5
MOST_BLOCKS = 1 << 23
#: Words of up to this length have a shard each; longer lengths share as many.
LENGTHS = 64
LEAST_BLOCKS = 1 << 9
CHUNK = 1 << 12
#: Hashes computed at once.
AT_ONCE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _lower(text: str) -> str:
    """Only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 5,
    noise: int | None = None,
    letters: str = LETTERS,
) -> DataFrame:
    """(word, n): the maximal runs of ``letters`` in whole texts, A-Z lower-cased.

    ``noise`` plants slips: with h the crc32 of ``<id>:<run>``, a run whose h it divides
    loses code point h % length.  Words shorter than ``least_length`` are left out.  A null or
    blank text has none; a null id reads as an empty string; a repeated row counts
    again.  Counts are added up in the task (a bounded number of words) and then over all.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    run_of = re.compile(f"[{re.escape(letters)}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                names=["word", "n"],
            )

        for batch in batches:
            for key, text in zip(*batch.columns):
                if not text.is_valid:
                    continue
                found = Counter(run_of.findall(_lower(text.as_py())))
                if noise is None:
                    total.update(found)
                    continue
                prefix = f"{key.as_py() if key.is_valid else ''}:"
                for run, n in found.items():
                    h = zlib.crc32((prefix + run).encode())
                    if h % noise == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    total[run] += n
                if len(total) > COUNTED:
                    yield handed()
                    total.clear()
        if total:
            yield handed()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(-1, length)


def _powers(length: int) -> np.ndarray:
    powers = np.full(length, BASE, dtype=np.uint64)
    if length:
        powers[0] = 1
    return np.multiply.accumulate(powers)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shard_of(length):
    """The shard of words of a length (a number or an array of them)."""
    return np.where(length < LENGTHS, length, LENGTHS + length % LENGTHS)


def block_and_mask(h: np.ndarray, length: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of 64 bits of a hash and the bits it has there; ``blocks`` is a power of two."""
    mixed = _mix(h + np.uint64(length))
    mask = np.zeros(h.shape, dtype=np.uint64)
    for i in range(HASHES):
        mask |= np.uint64(1) << ((mixed >> np.uint64(6 * i)) & np.uint64(63))
    return (mixed >> np.uint64(6 * HASHES)) & np.uint64(blocks - 1), mask


def hashes(points: np.ndarray) -> np.ndarray:
    return (points.astype(np.uint64) * _powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    sizes = words.str.len().to_numpy()
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(sizes[order]) != 0, True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if sizes[order[a]]:
            yield int(sizes[order[a]]), order[a:b]


def shard_blocks(counts: dict[int, int]) -> dict[int, int]:
    """Blocks of each shard: a power of two, all together within the bound."""
    bits = BITS_PER_WORD
    while True:
        blocks = {
            s: max(LEAST_BLOCKS, 1 << max(0, (n * bits // 64 - 1)).bit_length()) for s, n in counts.items()
        }
        if sum(blocks.values()) <= MOST_BLOCKS or bits == 1:
            break
        bits //= 2
    while sum(blocks.values()) > MOST_BLOCKS:
        largest = max(blocks, key=lambda s: blocks[s])
        blocks[largest] //= 2
    return blocks


def build_filter(vocabulary: DataFrame) -> dict[int, np.ndarray]:
    """Blocked Bloom filter of each length shard of column ``word``.

    The filters are built by tasks, put together block by block, and come to the driver as
    64 MiB at most whatever the vocabulary; beyond that more edits pass and the exact join
    removes them.
    """
    words = vocabulary.select("word")
    length = F.char_length("word")
    shard = F.when(length < LENGTHS, length).otherwise(LENGTHS + length % LENGTHS)
    counts = {r.shard: r["count"] for r in words.groupBy(shard.alias("shard")).count().collect()}
    blocks = shard_blocks(counts)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, rows in _by_length(batch["word"]):
                own = int(shard_of(length))
                for at in range(0, len(rows), max(1, AT_ONCE // length)):
                    part = batch["word"].iloc[rows[at : at + max(1, AT_ONCE // length)]].tolist()
                    block, mask = block_and_mask(hashes(_points(part, length)), length, blocks[own])
                    yield pd.DataFrame(
                        {"shard": own, "block": block.astype(np.int64), "mask": mask.view(np.int64)}
                    )

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        chunk = np.zeros(CHUNK, dtype=np.int64)
        chunk[group["block"].to_numpy() % CHUNK] = group["mask"].to_numpy()
        return pd.DataFrame({"shard": [key[0]], "chunk": [key[1]], "bits": [chunk.tobytes()]})

    placed = words.mapInPandas(place, "shard int, block long, mask long")
    merged = placed.groupBy("shard", "block").agg(F.expr("bit_or(mask)").alias("mask"))
    chunks = (
        merged.withColumn("chunk", F.expr(f"block div {CHUNK}"))
        .groupBy("shard", "chunk")
        .applyInPandas(whole, "shard int, chunk long, bits binary")
    )
    filters = {s: np.zeros(n, dtype=np.uint64) for s, n in blocks.items()}
    for row in chunks.toLocalIterator():
        own = filters[row.shard]
        at = row.chunk * CHUNK
        own[at : at + CHUNK] = np.frombuffer(row.bits, dtype=np.uint64)[: len(own) - at]
    return filters


def _passes(filters: dict[int, np.ndarray], h: np.ndarray, length: int) -> np.ndarray:
    bits = filters.get(int(shard_of(length)))
    if bits is None:
        return np.zeros(h.shape, dtype=bool)
    block, mask = block_and_mask(h, length, len(bits))
    return bits[block] & mask == mask


def edits_that_pass(
    words: list[str], length: int, filters: dict[int, np.ndarray], letters: str, least_length: int
) -> Iterator[tuple[int, str]]:
    """(place of the word, edit) for all deletions and later replacements the filters pass."""
    alphabet = np.array(sorted(map(ord, letters)), dtype=np.uint64)
    powers = _powers(length)
    points = _points(words, length).astype(np.uint64)
    terms = points * powers
    h = terms.sum(axis=1, dtype=np.uint64)
    if length > least_length:
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        shorter = before + (h[:, None] - before - terms) * INVERSE
        passed = _passes(filters, shorter, length - 1)
        # In a run of equal letters each deletion gives the same word.
        passed[:, 1:] &= points[:, 1:] != points[:, :-1]
        for row, at in zip(*np.nonzero(passed)):
            yield int(row), words[row][:at] + words[row][at + 1 :]
    width = max(1, AT_ONCE // (len(alphabet) * max(1, len(words))))
    for first in range(0, length, width):
        own = points[:, first : first + width, None]
        changed = h[:, None, None] + (alphabet - own) * powers[first : first + width, None]
        passed = _passes(filters, changed, length) & (alphabet > own)
        for row, at, letter in zip(*np.nonzero(passed)):
            word, at = words[row], first + at
            yield int(row), word[:at] + chr(int(alphabet[letter])) + word[at + 1 :]


def near_words(vocabulary: DataFrame, letters: str = LETTERS, least_length: int = 5) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words exactly one edit apart.

    ``vocabulary`` is a written table (word, n) of distinct words of ``letters`` with at
    least ``least_length`` code points.
    """
    spark = vocabulary.sparkSession
    filters = spark.sparkContext.broadcast(build_filter(vocabulary))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, ns = batch["word"], batch["n"].to_numpy()
            for length, rows in _by_length(words):
                step = max(1, AT_ONCE // (length * len(letters)))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    own = words.iloc[part].tolist()
                    found = list(edits_that_pass(own, length, filters.value, letters, least_length))
                    if found:
                        place, edits = zip(*found)
                        place = np.array(place)
                        yield pd.DataFrame(
                            {"word": [own[i] for i in place], "n": ns[part[place]], "edit": edits}
                        )

    # The probing is what takes time, so the few files are dealt out first.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    passed = vocabulary.select("word", "n").repartition(parts, "word").mapInPandas(
        probe, "word string, n long, edit string"
    )
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = materialise(
        passed.join(known, F.col("edit") == F.col("other")).select("word", "n", "other", "other_n"),
        "near-words",
    )
    return pairs.unionByName(
        pairs.select(
            F.col("other").alias("word"), F.col("other_n").alias("n"),
            F.col("word").alias("other"), F.col("n").alias("other_n"),
        )
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form, by doubling the steps.

    Occurrences at least double along forms, so there is no ring and a chain has 62 steps
    at most: six or seven rounds.
    """
    steps = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        steps = materialise(
            steps.select("word", "root")
            .join(after, F.col("root") == F.col("at"), "left")
            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "forms",
        )
        if not steps.where("moved").limit(1).count():
            return steps.select("word", "root")


def group_variants(
    vocabulary: DataFrame, times: int = 2, letters: str = LETTERS, least_length: int = 5
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of a table (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one of the
    other.  ``form`` is the near word of most occurrences (ties: the smallest in
    code-point order) if those are at least ``times`` (2 or more) its own, else null.
    ``root`` is the last of the forms of forms, or the word itself.  Words are distinct,
    not null, of ``letters`` and at least ``least_length`` long; an empty table gives an
    empty result.  Very long words cost their length times the letters, in pieces.
    """
    if times < 2:
        raise ValueError("forms could make a ring")
    words = materialise(vocabulary.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(words, letters, least_length).groupBy("word").agg(
        F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n")
    )
    better = -F.col("best.n") >= F.lit(times) * F.col("n")
    near = materialise(
        near.select(
            "word", "n_near",
            F.when(better, F.col("best.word")).alias("form"),
            F.when(better, -F.col("best.n")).alias("form_n"),
        ),
        "near",
    )
    roots = _roots(near.where("form IS NOT NULL"))
    return (
        words.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
        )
    )


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 5,
    least_count: int = 3,
    times: int = 2,
    noise: int | None = None,
    letters: str = LETTERS,
) -> DataFrame:
    """Variants among the words of whole texts; see :func:`count_words` and :func:`group_variants`."""
    counted = count_words(docs, id_col, text_col, least_length, noise, letters)
    return group_variants(counted.where(F.col("n") >= least_count), times, letters, least_length)
