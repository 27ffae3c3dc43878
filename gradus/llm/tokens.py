"""Token counts of flat token files by scanning for the end-of-document identifier.

A flat file is nothing but identifiers of one width; it has no index.  It is cut into
blocks anywhere, each block is searched for separators by itself, and the documents
that blocks cut are put together by a prefix scan: how many separators the blocks
before hold, and where the last of them stands.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm import files
from gradus.storage import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The first identifier the vocabulary leaves free.
END = 50_256
#: Blocks whose totals are added up in one group of the prefix scan.
FAN_IN = 1024


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _dtype(width: int) -> np.dtype:
    if width not in (2, 4):
        raise ValueError("an identifier takes 2 or 4 bytes")
    return np.dtype(f"<u{width}")


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    pattern: str = PATTERN,
    end: int = END,
    width: int = 2,
    rotate: int = 1 << 30,
) -> DataFrame:
    """Tokenise whole texts into flat files; returns (file, ordinal, id).

    Every document is its identifiers and then ``end``; a null or empty text is
    ``end`` alone.  ``ordinal`` counts the documents of a file from 0.  The returned
    table is written to the shared folder, so it names the files that belong to it.
    ``tokenizer`` is a path that every executor can read.
    """
    kind = _dtype(width)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern).encode_ordinary
        out, uri, written, ordinal, number = None, "", 0, 0, 0
        try:
            for batch in batches:
                names, ordinals = [], []
                for value in batch.column(1):
                    if out is not None and written >= rotate:
                        out.close()
                        out = None
                    if out is None:
                        uri = f"{folder}/" + files.attempt_name("tokens", f"-{number}.bin")
                        out, written, ordinal, number = files.create(uri), 0, 0, number + 1
                    data = np.array([*encode(value.as_py() or ""), end], dtype=kind).tobytes()
                    out.write(data)
                    names.append(uri)
                    ordinals.append(ordinal)
                    written += len(data)
                    ordinal += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)],
                    names=["file", "ordinal", "id"],
                )
        finally:
            if out is not None:
                out.close()

    return materialise(
        rows.mapInArrow(write, f"file string, ordinal long, id {id_type}"), "token-files"
    )


def _blocks(paths: DataFrame, width: int, block_bytes: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = [files.size(n) for n in names]
            for name, n in zip(names, sizes):
                if n % width:
                    raise ValueError(f"{name} ends inside an identifier")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64())], names=["file", "bytes"]
            )

    sized = paths.select("file").distinct().mapInArrow(measure, "file string, bytes long")
    last = F.greatest(F.ceil(F.col("bytes") / block_bytes) - 1, F.lit(0))
    return sized.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))


def scan_blocks(paths: DataFrame, end: int, width: int, block_bytes: int) -> DataFrame:
    """(file, block, tokens, ends): the places in the file of the separators of each block."""
    kind = _dtype(width)
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("tokens", pa.int64())]
        + [("ends", pa.list_(pa.int64()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(files.read_range(name, block * block_bytes, block_bytes), kind)
                ends = np.flatnonzero(data == end) + block * (block_bytes // width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]),
                        pa.array([block], pa.int64()),
                        pa.array([len(data)], pa.int64()),
                        pa.ListArray.from_arrays([0, len(ends)], pa.array(ends, pa.int64())),
                    ],
                    schema=schema,
                )

    blocks = _blocks(paths, width, block_bytes).repartition("file", "block")
    return blocks.mapInArrow(scan, "file string, block long, tokens long, ends array<long>")


def count_tokens(
    paths: DataFrame, end: int = END, width: int = 2, block_bytes: int = 4 << 20
) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the flat files of column ``file``.

    Documents of no tokens count.  Identifiers after the last separator of a file are
    a document too; nothing after it is none.  An empty file holds no document, and
    no file gives an empty result.  A file that ends inside an identifier is an error.
    """
    if block_bytes % width:
        raise ValueError("a block holds whole identifiers")
    found = materialise(scan_blocks(paths, end, width, block_bytes), "separators")
    light = found.select(
        "file",
        "block",
        F.floor(F.col("block") / FAN_IN).alias("stretch"),
        "tokens",
        F.size("ends").cast("long").alias("n"),
        F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"),
    )
    earlier = (Window.unboundedPreceding, -1)
    over_stretches = Window.partitionBy("file").orderBy("stretch").rowsBetween(*earlier)
    in_stretch = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(*earlier)
    stretches = light.groupBy("file", "stretch").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = stretches.select(
        "file",
        "stretch",
        F.coalesce(F.sum("n").over(over_stretches), F.lit(0)).alias("n_before"),
        F.coalesce(F.max("last").over(over_stretches), F.lit(-1)).alias("last_before"),
    )
    starts = (
        light.select(
            "file",
            "block",
            "stretch",
            F.coalesce(F.sum("n").over(in_stretch), F.lit(0)).alias("n_own"),
            F.max("last").over(in_stretch).alias("last_own"),
        )
        .join(before, ["file", "stretch"])
        .select(
            "file",
            "block",
            (F.col("n_before") + F.col("n_own")).alias("first"),
            F.greatest("last_before", F.coalesce("last_own", F.lit(-1))).alias("previous"),
        )
    )
    ended = found.join(starts, ["file", "block"]).select(
        "file",
        F.explode(
            F.transform(
                "ends",
                lambda at, i: F.struct(
                    (F.col("first") + i).alias("ordinal"),
                    (at - F.when(i == 0, F.col("previous")).otherwise(F.get("ends", i - 1)) - 1).alias("n_tokens"),
                ),
            )
        ).alias("doc"),
    ).select("file", "doc.ordinal", "doc.n_tokens")
    open_ended = (
        light.groupBy("file")
        .agg(F.sum("n").alias("ordinal"), F.sum("tokens").alias("all"), F.max("last").alias("last"))
        .select("file", "ordinal", (F.col("all") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"))
        .where("n_tokens > 0")
    )
    return ended.unionByName(open_ended)
