"""WARC archives with an index: written once, read by coalesced byte ranges.

Every record is a gzip member of its own, and the writer's result is the index:
file, offset, length, URL and digest of each record.  A reader selects from the
index, sorts by place, joins neighbours into one range and cuts the bytes again at
the places the index gives.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm import files
from gradus.storage import materialise, run_path

_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = "<urn:gradus:page:{}>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "file string, offset long, length long, page_id long, url string, digest string, "
    "record_type string, refers_to long"
)
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
)


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base 32 without padding."""
    digest = F.sha1(data)
    fives = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*fives), _HEX, _BASE32)


def _line(text: str) -> str:
    """A header value on one line; the percent sign and control characters are written as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in text)


def _unline(text: str) -> str:
    head, *rest = text.split("%")
    return head + "".join(chr(int(part[:2], 16)) + part[2:] for part in rest)


def _record(row: dict, date: str, level: int) -> bytes:
    page, refers = row["page_id"], row["refers_to"]
    payload = row["payload"] if row["record_type"] == "response" else b""
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(row['payload'])}\r\n\r\n".encode()
        + payload
    )
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {date}"]
    head.append("WARC-Record-ID: " + _RECORD.format("" if page is None else page))
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + _line(row["url"]))
    if refers is not None:
        head += ["WARC-Refers-To: " + _RECORD.format(refers), "WARC-Profile: " + _PROFILE]
    head += [
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, level, mtime=0)


def _parse(member: bytes) -> dict:
    """One record from its gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: (
        int(v) if (v := fields.get(name, "").rpartition(":")[2].rstrip(">")) else None
    )
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": None if url is None else _unline(url),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None,
    }


def _writer(folder: str, date: str, level: int, rotate: int):
    schema = pa.schema(
        [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
        + [("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string())]
        + [("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at, number = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                    if out is not None and at >= rotate:
                        out.close()
                        out = None
                    if out is None:
                        uri = f"{folder}/" + files.attempt_name("pages", f"-{number}.warc.gz")
                        out, at, number = files.create(uri), 0, number + 1
                    member = _record(row, date, level)
                    out.write(member)
                    del row["payload"]
                    rows.append(row | {"file": uri, "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if out is not None:
                out.close()

    return write


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 1,
    rotate: int = 1 << 30,
) -> DataFrame:
    """Write one record per row below ``folder`` and return the index of them.

    Of the rows with equal payloads of at least ``min_revisit_bytes`` bytes, that of
    the largest id is the response and the others revisit it.  A null payload is
    empty; a null URL is left out.  Rows that share the largest id are all
    responses; a null id revisits, unless no row of its payload has an id.  Extra
    columns are not archived.  An empty table gives an empty index.

    Payloads are compared by SHA-1.  The index is written to the shared folder
    before it is returned, so archives and index always belong together.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", sha1_base32(F.col("payload")))
    shared = (
        own.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("shared"), "largest")
    )
    own = own.join(materialise(shared, "payloads"), F.col("digest") == F.col("shared"), "left")
    revisits = F.coalesce(~F.col("page_id").eqNullSafe(F.col("largest")), F.lit(False))
    revisits = revisits & F.col("largest").isNotNull()
    typed = own.select(
        "page_id", "url", "payload", "digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("largest")).alias("refers_to"),
    )
    index = typed.mapInArrow(_writer(folder, date, level, rotate), INDEX)
    return materialise(index, "warc-index")


def _reader(gap: int, run: int):
    names = ["page_id", "url", "record_type", "refers_to", "digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def fetch(uri: str, places: list[tuple[int, int]]) -> pa.RecordBatch:
        start, end = places[0][0], places[-1][0] + places[-1][1]
        data = files.read_range(uri, start, end - start)
        rows = [_parse(data[a - start : a - start + n]) for a, n in places]
        return pa.RecordBatch.from_pylist(rows, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, places = None, []
        for batch in batches:
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if places:
                    end = places[-1][0] + places[-1][1]
                    if file != uri or at - end > gap or at + n - places[0][0] > run:
                        yield fetch(uri, places)
                        places = []
                uri = file
                places.append((at, n))
        if places:
            yield fetch(uri, places)

    return read


def read_warc(selected: DataFrame, gap: int = 64 << 10, run: int = 4 << 20) -> DataFrame:
    """The records of the selected index rows, with their payloads.

    Rows are dealt out by stretches of a file and sorted by place; records less than
    ``gap`` bytes apart are read as one range of at most ``run`` bytes (a single
    longer record is a range of its own).  A revisit has a null payload; it is found
    in the record it refers to.
    """
    stretch = F.floor(F.col("offset") / (8 * run)).alias("_stretch")
    placed = (
        selected.select("file", "offset", "length", stretch)
        .repartition("file", "_stretch")
        .sortWithinPartitions("file", "offset")
    )
    return placed.mapInArrow(_reader(gap, run), RECORDS)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder of the session."""
    return run_path(spark, "warc")
