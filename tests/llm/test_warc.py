import base64
import gzip
import hashlib

import pytest

from gradus.llm.warc import archive_folder, read_warc, sha1_base32, write_warc
from tests.llm.helpers import LONG

PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("rotate", [1 << 30, 2000])
def test_round_trip(spark, rotate):
    rows = [
        (1, "http://a/%20\r\nx é", "<p>one"), (2, None, None), (3, "", ""), (9, "http://b", "<p>one"), (5, "c", "<p>one"),
        (6, "d", LONG), (7, "e", "\r\n\r\nWARC/1.1\r\n"), (8, "f", "日本"), (None, "g", "<p>one"), (None, "h", "alone"),
    ]
    rows += [(100 + i, "many", f"page {i} " * 40) for i in range(60)]
    index = write_warc(spark.createDataFrame(rows, PAGES), archive_folder(spark), rotate=rotate)
    read = {(r.page_id, r.url): r for r in read_warc(index, gap=10, run=4096).collect()}
    assert len(read) == len(rows) == index.count()
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(top.get(html or "", page), page)
    for page, url, html in rows:
        got, largest = read[page, url], top.get(html or "")
        response = largest is None or page == largest
        assert got.digest == digest(html)
        assert got.record_type == ("response" if response else "revisit")
        assert got.refers_to == (None if response else largest)
        assert got.payload == ((html or "").encode() if response else None)


def test_index_places_are_whole_members(spark):
    index = write_warc(spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], PAGES), archive_folder(spark))
    for row in index.collect():
        with open(row.file.removeprefix("file:"), "rb") as file:
            file.seek(row.offset)
            record = gzip.decompress(file.read(row.length)).decode()
        assert record.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and f"WARC-Target-URI: {row.url}" in record
        assert row.digest == digest({"u": "x", "v": "y"}[row.url])
    assert [r.page_id for r in read_warc(index.where("url = 'v'")).collect()] == [2]


def test_odd_tables(spark):
    assert write_warc(spark.createDataFrame([], PAGES), archive_folder(spark)).count() == 0
    rows = spark.createDataFrame([(1, "u", "x"), (1, "u", "x")], PAGES).selectExpr("*", "1 AS payload", "'q' AS digest")
    index = write_warc(rows, archive_folder(spark))
    assert {r.record_type for r in index.collect()} == {"response"}
    small = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], PAGES)
    index = write_warc(small, archive_folder(spark), min_revisit_bytes=2)
    assert {r.record_type for r in index.collect()} == {"response"}


def test_digest_of_column(spark):
    texts = ["", "a", "日本", "x" * 1000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(sha1_base32(frame.t.cast("binary"))).collect()] == [digest(t) for t in texts]
