"""From documents to training tokens: four stages, each written before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.mixing import mix_sources
from gradus.llm.pieces import encode_documents
from gradus.llm.quality import keep_good
from gradus.llm.simhash import simhash_components
from gradus.shipping import ship
from gradus.storage import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A null or blank text has statistics of its own (all zero counts) and is judged by them;
    whole texts are read, however long.  Rows are judged one by one, so repeated rows
    and null ids stay or go like any other.  Without a label nothing is rejected; an empty
    table gives an empty one.  Columns beside those of documents are left out, whatever
    their names.
    """
    ship(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: fingerprints of four-word shingles within 4 bits.

    The document of the smallest id stays; of repeated ids the first row written, and a
    null id only where its class has no other.  Null and blank texts share fingerprint 0 and
    are one class.  Whole texts are read, however long; an empty table gives an empty one;
    columns beside those of documents are left out, whatever their names.
    """
    ship(spark)
    return simhash_components(docs, words=4, budget=4, keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to weights by the square root of the size of their source.

    Null sources are one source.  Repeated rows of one id are drawn alike, and so are null
    ids; texts may be null, blank or long and go through whole.  An empty table gives an
    empty one; columns beside those of documents are left out, whatever their names.
    """
    return mix_sources(docs, power=0.5, seed=7).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of every document in place of its text, and their number.

    A null or empty text has none.  Whole texts are encoded, however long; equal scores
    go to the longest last piece.  Repeated rows and null ids stay as they are; an empty
    table gives an empty one; a column named as a new one is replaced, others are kept.
    """
    ship(spark)
    return encode_documents(docs).withColumn("n_pieces", F.size("pieces"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: No SQL has the classifier, the fingerprints or the segmentation; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
