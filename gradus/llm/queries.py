"""The queries of the operators in this subpackage and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from checks.registry import QueryFn

from gradus.llm import lexical, pivots
from gradus.llm.binary_codes import near_duplicates
from gradus.llm.chat import format_conversations, read_back
from gradus.llm.mixing import PART, STEPS, mix_sources
from gradus.llm.packing import Limits, pack_documents
from gradus.llm.pieces import decode_documents, encode_documents
from gradus.llm.quality import score_documents
from gradus.llm.shards import shard_by_bytes
from gradus.llm.simhash import simhash_components
from gradus.llm.tokens import count_tokens, write_token_files
from gradus.llm.variants import spelling_variants
from gradus.llm.warc import archive_folder, read_warc, sha1_base32, write_warc
from gradus.storage import materialise, run_path

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies of all documents."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the square root of the size of their source."""
    mixed = materialise(mix_sources(table(spark, sf_dir, "documents"), power=0.5, seed=7), "mixed")
    # Taken from the rows as they were repeated and shuffled.
    text_sha256 = F.sha2("text", 256).alias("text_sha256")
    return mixed.select("doc_id", "source", "lang", "n_chars", text_sha256, "copy", "shuffle_key")


# The steps are summed from 0 upwards, as the operator does; a mean above PART would
# be drawn in parts.
ORACLES["op10_mixing"] = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source
),
rates AS (
  SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * w / (SELECT sum(w) FROM sizes) / n AS rate
  FROM sizes
),
parts AS (SELECT source, rate, ceil(rate / {PART})::INT AS parts FROM rates),
steps AS (
  SELECT source, parts, rate / parts AS mean, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM parts
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k < {STEPS}
),
below AS (
  SELECT source, parts, list(c ORDER BY k) FILTER (c < top) AS cs
  FROM (SELECT *, max(c) OVER (PARTITION BY source) AS top FROM steps) GROUP BY source, parts
),
drawn AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, sha256(d.text) AS text_sha256, list_sum(list_transform(range(1, b.parts + 1), lambda j:
    len(list_filter(b.cs, lambda c: c <= (
      ('0x' || substr(md5('7|poisson|' || d.doc_id || '|' || j), 1, 15))::BIGINT >> 7) / 9007199254740992.0::DOUBLE)))) AS n
  FROM documents d JOIN below b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, lang, n_chars, text_sha256, copy::INT AS copy,
  ('0x' || substr(md5('7|order|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT doc_id, source, lang, n_chars, text_sha256, unnest(range(1, n::BIGINT + 1)) AS copy FROM drawn WHERE n > 0)
"""

def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, read back by the index; revisits through what they refer to."""
    index = write_warc(table(spark, sf_dir, "pages"), archive_folder(spark))
    read = materialise(
        read_warc(index).select(
            "page_id",
            "record_type",
            "refers_to",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            sha1_base32(F.col("payload")).alias("payload_digest"),
        ),
        "warc-read",
    )
    whole = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read.where("record_type = 'response'").select(*whole)
    targets = responses.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("target")).agg(
        F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("digest")
    )
    revisits = (
        read.where("record_type = 'revisit'")
        .join(targets, F.col("refers_to") == F.col("target"), "left")
        .select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    )
    return responses.unionByName(revisits)


# SHA-1 in base 32: five hexadecimal digits at a time are four digits of base 32.
ORACLES["op7_warc"] = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages
),
coded AS (
  SELECT page_id, payload_bytes,
    list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform([32768, 1024, 32, 1], lambda d:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 5 * i::INT + 1, 5))::INT // d % 32)::INT + 1, 1)),
      lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest
  FROM hashed
),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM coded)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM largest
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that imitates control strings, formatted and read back."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    spoof = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], messages.schema)
    return read_back(format_conversations(messages.unionByName(spoof)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, counted in the flat files they were written to."""
    docs = table(spark, sf_dir, "documents")
    written = write_token_files(docs, run_path(spark, "tokens"))
    counted = count_tokens(written.select("file"))
    return written.join(counted, ["file", "ordinal"], "left").select(
        F.col("id").alias("doc_id"), "n_tokens"
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings of one label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every 50th embedding, among all."""
    index, shards = pivots.build_index(table(spark, sf_dir, "embeddings"))
    return pivots.search(index, shards, index.where("id % 50 = 0"), k=5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labels that are not held out."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: sizes and digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_documents(docs)
    decoded = decode_documents(
        encoded.select(
            "doc_id",
            "pieces",
            F.size("pieces").cast("long").alias("n_pieces"),
            F.xxhash64("pieces").alias("pieces_xxh64"),
        )
    )
    return decoded.select(
        "doc_id", "n_pieces", "pieces_xxh64", F.sha2("text", 256).alias("decoded_sha256")
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    limits = Limits(tokens=2048, segments=128, loss=2048)
    packed = pack_documents(table(spark, sf_dir, "documents"), limits=limits)
    return packed.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"), noise=97)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every item of the benchmark."""
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    found = lexical.search(index, table(spark, sf_dir, "benchmark"), k=50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


ORACLES["op13_search"] = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM documents
),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, totals GROUP BY term
),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM benchmark
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""


for query in (
    op1_shards,
    op2_token_counts,
    op3_embedding_dedup,
    op4_nearest,
    op5_simhash,
    op6_quality,
    op7_warc,
    op8_sentencepiece,
    op9_chat,
    op10_mixing,
    op11_packing,
    op12_variants,
    op13_search,
):
    QUERIES[query.__name__] = query
QUERIES["pipeline"] = corpus_pipeline.run
