"""Finished keys of an output path, so that a batch costs its own size.

With every commit the finished keys of the batch are written once more, alone, and a
Bloom filter of their hashes beside them.  A later batch probes the filters, four to eight
bytes a key, and reads the keys of those commits only that may hold one of its own.  A new
key passes a filter of another with a chance of about 4e-7, so batches of new keys read none.
Filters come in chunks of a bounded size and are probed in rounds of a bounded total.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.sources.commits import commits, notes
from gradus.storage import materialise

KEYS_FOLDER, FILTERS_FOLDER = "_keys", "_filters"
#: Keys of a chunk, bits a key (rounded up to a power of two a chunk), bits set, and bytes of the
#: filters that are broadcast at once.
CHUNK_KEYS = 1 << 20
BITS_PER_KEY = 32
HASHES = 16
ROUND_BYTES = 64 << 20


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _bits(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of the bits of each hash in a filter of ``size`` bits, a power of two."""
    at, step = _mix(h.view(np.uint64)), _mix(~h.view(np.uint64)) | np.uint64(1)
    for _ in range(HASHES):
        yield (at & np.uint64(size - 1)).astype(np.int64)
        at = at + step


def _build(h: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, dtype=bool)
    for at in _bits(h, size):
        bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _any_passes(bits: np.ndarray, h: np.ndarray) -> bool:
    alive = np.ones(len(h), dtype=bool)
    for at in _bits(h, 8 * len(bits)):
        alive &= ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 1
    return bool(alive.any())


def write_keys(done: DataFrame, keys: Sequence[str], path: str, attempt: str) -> dict:
    """Write the finished keys of an attempt and their filter; returns the note for the commit."""
    spark, root = done.sparkSession, path.rstrip("/")
    place = f"{root}/{KEYS_FOLDER}/{attempt}"
    done.select(key_hash(keys).alias("h"), *keys).write.parquet(place)
    hashes = spark.read.parquet(place).select("h")
    n = hashes.count()
    chunks = max(1, -(-n // CHUNK_KEYS))
    size = 1 << max(6, (-(-n // chunks) * BITS_PER_KEY - 1).bit_length())

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [key[0]], "bits": [_build(group["h"].to_numpy(), size)]})

    if n:
        (
            hashes.groupBy(F.pmod("h", F.lit(chunks)).alias("chunk"))
            .applyInPandas(build, "chunk long, bits binary")
            .write.parquet(f"{root}/{FILTERS_FOLDER}/{attempt}")
        )
    return {"keys": n, "chunks": chunks, "bits": size}


def _rounds(noted: dict[str, dict]) -> Iterator[list[tuple[str, int]]]:
    """Chunks of filters, (attempt, chunk), in rounds of bounded size."""
    held, size = [], 0
    for attempt, note in noted.items():
        for chunk in range(note["chunks"]):
            held.append((attempt, chunk))
            size += note["bits"] // 8
            if size >= ROUND_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _filters(spark: SparkSession, path: str, wanted: list[tuple[str, int]]) -> dict:
    """The bits of the chunks of one round; an absent chunk has no key."""
    folders = [f"{path.rstrip('/')}/{FILTERS_FOLDER}/{a}" for a in dict.fromkeys(a for a, _ in wanted)]
    attempt = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    rows = spark.read.parquet(*folders).select(attempt.alias("attempt"), "chunk", "bits")
    rows = rows.where(F.col("chunk").isin(sorted({c for _, c in wanted})))
    asked, found = set(wanted), {}
    for r in rows.toLocalIterator():
        if (r.attempt, r.chunk) in asked:
            found[r.attempt, r.chunk] = np.frombuffer(r.bits, dtype=np.uint8)
    return found


def may_hold(hashes: DataFrame, path: str, noted: dict[str, dict]) -> set[str]:
    """Attempts whose keys may hold one of ``h``: all that do, few that do not."""
    spark = hashes.sparkSession
    found: set[str] = set()
    for wanted in _rounds(noted):
        filters = spark.sparkContext.broadcast(_filters(spark, path, wanted))
        chunks = {a: noted[a]["chunks"] for a, _ in wanted}

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            left = dict(filters.value)
            for batch in batches:
                h = batch["h"].to_numpy()
                hits = [
                    (a, c) for (a, c), bits in left.items()
                    if _any_passes(bits, h if chunks[a] == 1 else h[h % chunks[a] == c])
                ]
                # One hit is enough: the chunk need not be probed again.
                for key in hits:
                    del left[key]
                if hits:
                    yield pd.DataFrame({"attempt": [a for a, _ in hits]})

        found |= {r.attempt for r in hashes.mapInPandas(probe, "attempt string").distinct().collect()}
        filters.unpersist()
    return found


def finished_keys(
    batch: DataFrame, path: str, keys: Sequence[str], leave_out: tuple[str, int] | None = None
) -> tuple[DataFrame | None, int]:
    """Finished keys that may be of ``batch``, and how many keys had to be read for it.

    ``leave_out`` names the (stream, batch) that is being written again.  None when no commit
    holds a key of the batch.
    """
    spark = batch.sparkSession
    held = commits(spark, path)
    held.pop(leave_out, None)
    noted = notes(spark, path) if held else {}
    noted = {c.attempt: noted[c.attempt] for c in held.values() if noted[c.attempt].get("keys")}
    if not noted:
        return None, 0
    hashes = materialise(batch.select(key_hash(keys).alias("h")).distinct(), "batch-keys")
    hit = may_hold(hashes, path, noted)
    if not hit:
        return None, 0
    folders = [f"{path.rstrip('/')}/{KEYS_FOLDER}/{a}" for a in sorted(hit)]
    return spark.read.parquet(*folders).select(*keys), sum(noted[a]["keys"] for a in hit)
