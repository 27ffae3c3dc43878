"""Histograms, selection and error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.registry import query
from gradus.functions import bins as B
from gradus.functions.labels import error_flag
from gradus.operators import binning as N
from gradus.operators import filters as L
from gradus.sources import sinks as K


def edge_list(edges) -> str:
    return "[" + ", ".join(f"{float(e)!r}::DOUBLE" for e in edges) + "]"


UNIFORM, CUSTOM = edge_list(B.UNIFORM_EDGES), edge_list(B.CUSTOM_EDGES)
FLOORED = "floor(score_norm * 100) / 100.0::DOUBLE"


def bin_sql(value: str, edges: str, n: int, right: bool = False) -> str:
    """0-based bin number by comparing with every edge; last or first edge closed."""
    if right:
        found = f"greatest(len(list_filter({edges}, lambda e: e < {value})) - 1, 0)"
    else:
        found = f"least(len(list_filter({edges}, lambda e: e <= {value})) - 1, {n - 1})"
    return f"CASE WHEN {value} >= {edges}[1] AND {value} <= {edges}[{n + 1}] THEN {found} END"


def frame_sql(edges: str, n: int) -> str:
    return (
        f"SELECT b AS bin, {edges}[b + 1] AS lower, {edges}[b + 2] AS upper, "
        f"b = {n - 1} AS closed_right FROM range({n}) t(b)"
    )


def histogram_sql(source: str, value: str, edges: str, n: int) -> str:
    return f"""SELECT f.bin, round(f.lower, 6) AS lower, round(f.upper, 6) AS upper, f.closed_right,
  coalesce(c.n, 0)::BIGINT AS "count"
FROM ({frame_sql(edges, n)}) f
LEFT JOIN (SELECT {bin_sql(value, edges, n)} AS bin, count(*) AS n FROM {source} GROUP BY 1) c ON f.bin = c.bin"""


def shown(df, *by):
    """Histogram rows as the comparison has them."""
    return df.select(
        *by,
        F.col("bin").cast("bigint").alias("bin"),
        F.round("lower", 6).alias("lower"),
        F.round("upper", 6).alias("upper"),
        "closed_right",
        F.col("count").cast("bigint").alias("count"),
    )


@query("histogram_uniform", Q.sql(histogram_sql("scores", "score_norm", UNIFORM, 20), "scores"))
def histogram_uniform(spark, sf_dir):
    return shown(N.histogram(L.filter_valid_score(V.scores(spark, sf_dir))))


BY_FILE_SQL = f"""SELECT d.dataname, f.bin, round(f.lower, 6) AS lower, round(f.upper, 6) AS upper,
  f.closed_right, coalesce(c.n, 0)::BIGINT AS "count"
FROM ({frame_sql(UNIFORM, 20)}) f
CROSS JOIN (SELECT DISTINCT dataname FROM scores) d
LEFT JOIN (SELECT dataname, {bin_sql('score_norm', UNIFORM, 20)} AS bin, count(*) AS n
  FROM scores GROUP BY 1, 2) c ON f.bin = c.bin AND d.dataname = c.dataname"""


@query("histogram_by_file", Q.sql(BY_FILE_SQL, "scores"))
def histogram_by_file(spark, sf_dir):
    return shown(N.histogram_by(V.scores(spark, sf_dir), ["dataname"]), "dataname")


@query(
    "merge_histograms",
    Q.sql(
        f"SELECT lower, upper, closed_right, sum(\"count\")::BIGINT AS \"count\" "
        f"FROM ({BY_FILE_SQL}) GROUP BY ALL",
        "scores",
    ),
)
def merge_histograms(spark, sf_dir):
    merged = N.merge_histograms(N.histogram_by(V.scores(spark, sf_dir), ["dataname"]))
    return merged.select(
        F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "closed_right", "count"
    )


@query(
    "histogram_from_midpoints",
    Q.sql(
        f"""SELECT f.bin, round(f.lower, 6) AS lower, round(f.upper, 6) AS upper, f.closed_right,
  coalesce(c.n, 0)::BIGINT AS "count"
FROM ({frame_sql(UNIFORM, 20)}) f
LEFT JOIN (SELECT {bin_sql('mid', UNIFORM, 20)} AS bin, sum(n) AS n
  FROM (SELECT (round(lower, 2) + round(upper, 2)) / 2 AS mid, "count" AS n FROM ({BY_FILE_SQL}))
  GROUP BY 1) c ON f.bin = c.bin""",
        "scores",
    ),
)
def histogram_from_midpoints(spark, sf_dir):
    merged = N.merge_histograms(N.histogram_by(V.scores(spark, sf_dir), ["dataname"]))
    return shown(N.histogram_from_midpoints(merged))


@query("bin_counts_custom", Q.sql(histogram_sql("scores", FLOORED, CUSTOM, 16), "scores"))
def bin_counts_custom(spark, sf_dir):
    return shown(N.bin_counts(V.scores(spark, sf_dir)))


def selected_sql(order: str, n: int, within: str) -> str:
    return f"""SELECT dataname, id, bin, rank, round(score_norm, 6) AS score_norm FROM (
  SELECT *, row_number() OVER (PARTITION BY {within} bin ORDER BY {order})::BIGINT AS rank
  FROM (SELECT * REPLACE (nullif(dataname, 'src3') AS dataname, id % 50 AS id), id AS n,
    {bin_sql(FLOORED, CUSTOM, 16)} AS bin FROM scores)
  WHERE bin IS NOT NULL) WHERE rank <= {n}"""


def shown_selection(df):
    return df.select(
        "dataname",
        "id",
        F.col("bin").cast("bigint").alias("bin"),
        F.col("rank").cast("bigint").alias("rank"),
        F.round("score_norm", 6).alias("score_norm"),
    )


def clashing(scores):
    """Ids that come again and again, and one data set without a name; ``n`` tells all apart."""
    return scores.withColumn("n", F.col("id")).withColumns(
        {"id": F.col("id") % 50, "dataname": F.nullif("dataname", F.lit("src3"))}
    )


@query("select_per_bin", Q.sql(selected_sql("id, dataname NULLS FIRST, n", 3, "dataname,"), "scores"))
def select_per_bin(spark, sf_dir):
    """First three items of every bin of every data set, the nameless one too."""
    return shown_selection(
        N.select_per_bin(
            clashing(V.scores(spark, sf_dir)), n=3, within=["dataname"], row_key=["dataname", "id", "n"]
        )
    )


@query(
    "random_per_bin",
    Q.sql(
        selected_sql(
            "md5(concat_ws('|', '7', dataname, id, n))[:15], dataname NULLS FIRST, id, n", 40, ""
        ),
        "scores",
    ),
)
def random_per_bin(spark, sf_dir):
    """Forty hashed items of every bin over all data sets."""
    return shown_selection(
        N.select_per_bin(
            clashing(V.scores(spark, sf_dir)), n=40, seed=7, row_key=["dataname", "id", "n"]
        )
    )


@query("select_per_bin_80", Q.sql(selected_sql("id, dataname NULLS FIRST, n", 80, ""), "scores"))
def select_eighty_per_bin(spark, sf_dir):
    """The fixed number, first items of every bin over all data sets."""
    return shown_selection(
        N.select_per_bin(clashing(V.scores(spark, sf_dir)), row_key=["dataname", "id", "n"])
    )


@query(
    "random_per_bin_80",
    Q.sql(
        selected_sql("md5(concat_ws('|', '7', dataname, id, n))[:15], dataname NULLS FIRST, id, n", 80, "dataname,"),
        "scores",
    ),
)
def random_eighty_per_bin(spark, sf_dir):
    """The fixed number of hashed items of every bin of every data set."""
    scores = clashing(V.scores(spark, sf_dir))
    return shown_selection(
        N.select_per_bin(scores, seed=7, within=["dataname"], row_key=["dataname", "id", "n"])
    )


@query(
    "selection_report",
    Q.sql(
        f"""SELECT *, sum(requested) OVER ()::BIGINT AS expected_total,
  sum(selected) OVER ()::BIGINT AS actual_total
FROM (SELECT bin, lower, upper, "count" AS raw, 80::BIGINT AS requested,
  least("count", 80) AS selected FROM ({histogram_sql('scores', FLOORED, CUSTOM, 16)}))""",
        "scores",
    ),
)
def selection_report(spark, sf_dir):
    report = N.selection_report(V.scores(spark, sf_dir))
    return report.select(
        F.col("bin").cast("bigint").alias("bin"),
        F.round("lower", 6).alias("lower"),
        F.round("upper", 6).alias("upper"),
        *[
            F.col(c).cast("bigint").alias(c)
            for c in ("raw", "requested", "selected", "expected_total", "actual_total")
        ],
    )


@query(
    "error_flag",
    Q.sql(
        "SELECT doc_id, label, predict, coalesce(label <> predict, true) AS wrong FROM yes_no",
        "yes_no",
    ),
)
def error_flags(spark, sf_dir):
    return V.yes_no_predictions(spark, sf_dir).withColumn(
        "wrong", error_flag(F.col("label"), F.col("predict"))
    )


def error_rate_sql(value: str, edges, decimals: int) -> str:
    n = len(edges) - 1
    labels = "[" + ", ".join(
        Q.quote(f"{edges[i]:.{decimals}f}-{edges[i + 1]:.{decimals}f}") for i in range(n)
    ) + "]"
    return f"""SELECT f.b AS bin_index, {labels}[f.b + 1] AS bin, coalesce(c.total, 0)::BIGINT AS total,
  coalesce(c.errors, 0)::BIGINT AS errors, coalesce(c.total - c.errors, 0)::BIGINT AS correct,
  round(coalesce(c.errors / c.total, 0), 6)::DOUBLE AS error_rate
FROM range({n}) f(b) LEFT JOIN (
  SELECT {bin_sql(value, edge_list(edges), n, right=True)} AS b, count(*) AS total,
    sum(CASE WHEN coalesce(label <> predict, true) THEN 1 ELSE 0 END) AS errors
  FROM scored_predictions GROUP BY 1) c ON f.b = c.b"""


def shown_rates(df):
    return df.select(
        F.col("bin_index").cast("bigint").alias("bin_index"),
        "bin",
        *[F.col(c).cast("bigint").alias(c) for c in ("total", "errors", "correct")],
        F.round("error_rate", 6).alias("error_rate"),
    )


NORM_RATE_SQL = error_rate_sql("score_norm", B.UNIFORM_EDGES, 2)


@query("error_rate_norm", Q.sql(NORM_RATE_SQL, "scored_predictions"))
def error_rate_norm(spark, sf_dir):
    return shown_rates(N.error_rate(V.scored_predictions(spark, sf_dir)))


@query("error_rate_log", Q.sql(error_rate_sql("score_log", B.LOG_EDGES, 0), "scored_predictions"))
def error_rate_log(spark, sf_dir):
    return shown_rates(N.error_rate_log(V.scored_predictions(spark, sf_dir)))


@query(
    "band_distribution",
    Q.sql(
        """SELECT lower, upper, "count"::BIGINT AS "count",
  round("count" * 100.0::DOUBLE / (SELECT count(*) FROM scores), 6) AS percent
FROM (SELECT lower, upper, (SELECT count(*) FROM scores WHERE score_norm >= lower AND score_norm < upper) AS "count"
  FROM (VALUES (0e0, 2e-1), (2e-1, 5e-1), (5e-1, 1e0)) t(lower, upper))""",
        "scores",
    ),
)
def band_distribution(spark, sf_dir):
    return N.band_distribution(V.scores(spark, sf_dir)).select(
        "lower", "upper", "count", F.round("percent", 6).alias("percent")
    )


BUCKET_SQL = """CASE WHEN score_norm < 0 OR score_norm >= 1 THEN NULL WHEN score_norm < 0.3 THEN 0
  WHEN score_norm < 0.5 THEN 1 WHEN score_norm < 0.7 THEN 2 ELSE 3 END"""


@query(
    "bucket_membership",
    Q.sql(
        f"""SELECT dataname, id, bucket::BIGINT AS bucket
FROM (SELECT *, {BUCKET_SQL} AS bucket FROM scores) WHERE bucket <= 2""",
        "scores",
    ),
)
def bucket_membership(spark, sf_dir):
    """Items of the buckets up to stage 2."""
    return N.bucket_members(V.scores(spark, sf_dir), 2).select(
        "dataname", "id", F.col("bucket").cast("bigint").alias("bucket")
    )


@query(
    "difficulty_masks",
    Q.sql(
        "SELECT dataname, id, score_norm <= 0.3 AS easy, score_norm <= 0.6 AS medium, "
        "score_norm <= 1.0 AS hard FROM scores",
        "scores",
    ),
)
def difficulty_masks(spark, sf_dir):
    return N.difficulty_masks(V.scores(spark, sf_dir)).select(
        "dataname", "id", "easy", "medium", "hard"
    )


HISTOGRAM = histogram_sql("scores", "score_norm", UNIFORM, 20)


@query(
    "sink_histogram_text",
    Q.sql(
        f"""SELECT line FROM (
  SELECT printf('[%.2f - %.2f', lower, upper) || CASE WHEN closed_right THEN ']' ELSE ')' END
    || ': ' || "count" AS line FROM ({HISTOGRAM})
  UNION ALL SELECT {Q.quote(K.HISTOGRAM_HEADER)})""",
        "scores",
    ),
)
def sink_histogram_text(spark, sf_dir):
    """Written as text and read back."""
    from gradus.storage import run_path

    path = run_path(spark, "histogram-text")
    lines = K.histogram_lines(N.histogram(L.filter_valid_score(V.scores(spark, sf_dir))))
    K.write_lines(lines, "line_no", "value", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "sink_bin_stats_text",
    Q.sql(
        f"""SELECT '区间 ' || bin || ': 总数 = ' || total || ', 正确数 = ' || correct || ', 错误数 = ' || errors AS counts,
  '区间 ' || bin || ': 错误率 = ' || printf('%.2f', error_rate * 100) || '%' AS rate FROM ({NORM_RATE_SQL})""",
        "scored_predictions",
    ),
)
def sink_bin_stats_text(spark, sf_dir):
    from gradus.storage import run_path

    lines = K.bin_stats_lines(N.error_rate(V.scored_predictions(spark, sf_dir)))
    counts, rates = run_path(spark, "bin-counts"), run_path(spark, "bin-rates")
    K.write_lines(lines, "bin_index", "counts", counts)
    K.write_lines(lines, "bin_index", "rate", rates)
    bin_name = F.regexp_extract("value", r"^\S+ (\S+):", 1).alias("bin")
    read = {p: spark.read.text(p).select(bin_name, "value") for p in (counts, rates)}
    return (
        read[counts]
        .withColumnRenamed("value", "counts")
        .join(read[rates].withColumnRenamed("value", "rate"), "bin")
        .select("counts", "rate")
    )
