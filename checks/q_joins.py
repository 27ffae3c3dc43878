"""Repair upsert, file pairing, positional zip, resume anti join, union."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.registry import query
from gradus.operators import joins as J
from gradus.sources import versions as T
from gradus.storage import run_path

SHIFT = 1_000_000_000_000  # second copies and unmatched keys lie beyond every given id


def upsert_target(spark, sf_dir):
    """Every item twice, the copy later in order."""
    first = V.items(spark, sf_dir).select(
        "dataname", "id", "context", "answer", F.col("id").alias("ordinal")
    )
    return first.unionByName(first.withColumn("ordinal", F.col("ordinal") + SHIFT))


def upsert_source(spark, sf_dir):
    """Repaired records of the labelled items, in two versions; one more set matches nothing."""
    labels = V.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    base = V.items(spark, sf_dir).select("dataname", "id", "context").join(labels, "id")

    n, nothing = F.col("n"), F.lit(None).cast("bigint")
    # Versions 1 and 2 repair an item, 3 has an unknown id and 4 none.
    return base.withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).select(
        "dataname",
        F.when(n <= 2, F.col("id")).when(n == 3, F.col("id") + SHIFT).otherwise(nothing).alias("id"),
        F.concat(F.lit("repaired "), n.cast("string"), F.lit(": "), "context").alias("context"),
        F.col("quality").cast("string").alias("answer"),
        (F.col("id") + n * SHIFT).alias("ordinal"),
    )


UPSERT_SQL = Q.sql(
    f"""SELECT i.dataname, i.id, i.id AS ordinal,
  CASE WHEN l.doc_id IS NULL THEN context ELSE 'repaired 2: ' || context END AS context,
  CASE WHEN l.doc_id IS NULL THEN answer ELSE quality::VARCHAR END AS answer
FROM items i LEFT JOIN labels l ON i.id = l.doc_id
UNION ALL SELECT dataname, id, id + {SHIFT}, context, answer FROM items""",
    "items",
)


@query("upsert_by_id", UPSERT_SQL)
def upsert_by_id(spark, sf_dir):
    return J.upsert(upsert_target(spark, sf_dir), upsert_source(spark, sf_dir))


@query("upsert_by_file", UPSERT_SQL)
def upsert_by_file(spark, sf_dir):
    """The same repair of a kept table: only files that hold a repaired record are rewritten."""
    path = run_path(spark, "items-table")
    T.create_table(upsert_target(spark, sf_dir), path)
    T.merge_table(spark, path, upsert_source(spark, sf_dir))
    return T.read_table(spark, path)


NAME_SQL = "source || '-' || lang"


@query(
    "pair_files_by_suffix",
    f"""SELECT DISTINCT {NAME_SQL} || '_Error.json' AS repair_file, {NAME_SQL} || '.json' AS target_file
FROM documents WHERE n_chars > 5000""",
)
def pair_files_by_suffix(spark, sf_dir):
    """A repair file per source and language; targets only where long texts are."""
    name = F.concat("source", F.lit("-"), "lang")
    documents = V.table(spark, sf_dir, "documents")
    repairs = documents.select(F.concat(name, F.lit("_Error.json")).alias("file_name"))
    targets = documents.filter(F.col("n_chars") > 5000).select(
        F.concat(name, F.lit(".json")).alias("file_name")
    )
    return J.pair_files(repairs, targets).select("repair_file", "target_file")


@query(
    "attach_scores_positional",
    Q.sql(
        """SELECT p.position, doc_id, label, predict, round(score_log, 6) AS score_log, round(score_norm, 6) AS score_norm
FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS position FROM yes_no) p
JOIN (SELECT *, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS position FROM scores
  WHERE id IN (SELECT doc_id FROM labels)) s USING (position)""",
        "yes_no",
        "scores",
    ),
)
def attach_scores_positional(spark, sf_dir):
    """The i-th prediction gets the i-th score of the labelled items."""
    labelled = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    scored = V.scores(spark, sf_dir).join(labelled, "id", "left_semi")
    joined = J.attach_scores(V.yes_no_predictions(spark, sf_dir), scored, ["doc_id"], ["id"])
    return joined.select(
        "position",
        "doc_id",
        "label",
        "predict",
        F.round("score_log", 6).alias("score_log"),
        F.round("score_norm", 6).alias("score_norm"),
    )


@query(
    "anti_join_done",
    Q.sql(
        "SELECT dataname, id, question FROM items WHERE id NOT IN (SELECT doc_id FROM labels)", "items"
    ),
)
def anti_join_done(spark, sf_dir):
    """Items without a label are still to be done."""
    items = V.items(spark, sf_dir).select("dataname", "id", "question")
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return J.anti_join_done(items, items.join(labels, "id", "left_semi"))


@query(
    "union_datasets",
    """SELECT 'documents' AS dataname, doc_id AS id, text AS context, lang, NULL::VARCHAR AS role FROM documents
UNION ALL SELECT 'conversations', conv_id, text, NULL, role FROM conversations
UNION ALL SELECT 'benchmark', item_id, text, NULL, NULL FROM benchmark""",
)
def union_datasets(spark, sf_dir):
    """Three tables with different fields as one."""

    def part(name, key, *more):
        return V.table(spark, sf_dir, name).select(
            F.lit(name).alias("dataname"), F.col(key).alias("id"), F.col("text").alias("context"), *more
        )

    return J.union_datasets(
        part("documents", "doc_id", "lang"),
        part("conversations", "conv_id", "role"),
        part("benchmark", "item_id"),
    )
