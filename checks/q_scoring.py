"""Scoring expressions and the normalised score."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.registry import query
from gradus.functions import brackets as B
from gradus.functions import score as S
from gradus.operators.scoring import normalise, score_items, score_stats, with_raw_score
from gradus.storage import materialise


@query(
    "nesting_depth",
    Q.sql(
        f"SELECT id, {Q.depth('context')}::BIGINT AS whole_depth, "
        f"list_sum(list_transform(logical_expressions, lambda e: {Q.depth('e')}))::BIGINT AS depth_sum, "
        f"list_max(list_transform(logical_expressions, lambda e: {Q.depth('e')}))::BIGINT AS depth_max "
        "FROM (SELECT id, " + Q.symbols("context") + " AS context, logical_expressions FROM extracted)",
        "extracted",
    ),
)
def nesting_depth(spark, sf_dir):
    depths = F.transform("logical_expressions", B.nesting_depth)
    return V.extracted(spark, sf_dir).select(
        "id",
        B.nesting_depth(V.symbols(F.col("context"))).cast("bigint").alias("whole_depth"),
        F.aggregate(depths, F.lit(0).cast("bigint"), lambda a, d: a + d).alias("depth_sum"),
        F.array_max(depths).cast("bigint").alias("depth_max"),
    )


@query(
    "avg_nesting_depth",
    Q.sql(
        f"SELECT id, round({Q.avg_depth('logical_expressions')}, 6) AS avg_depth FROM extracted",
        "extracted",
    ),
)
def avg_nesting_depth(spark, sf_dir):
    return V.extracted(spark, sf_dir).select(
        "id", F.round(B.average_depth(F.col("logical_expressions")), 6).alias("avg_depth")
    )


@query(
    "count_logic_ops",
    Q.sql(
        "SELECT id, list_sum(list_transform(logical_expressions, lambda e: "
        f"{Q.operators('e')}))::BIGINT AS n_ops FROM extracted",
        "extracted",
    ),
)
def count_logic_ops(spark, sf_dir):
    counts = F.transform("logical_expressions", B.count_operators)
    return V.extracted(spark, sf_dir).select(
        "id", F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_ops")
    )


@query(
    "context_score",
    Q.sql(
        f"SELECT id, round({Q.context_score('logical_expressions', 'predicates', 'constants')}, 4) "
        "AS context_score FROM extracted",
        "extracted",
    ),
)
def context_score(spark, sf_dir):
    value = S.context_score(F.col("logical_expressions"), F.col("predicates"), F.col("constants"))
    return V.extracted(spark, sf_dir).select("id", F.round(value, 4).alias("context_score"))


@query(
    "preconditions_score",
    Q.sql(
        "SELECT id, (o_index - 1)::BIGINT AS option_index, "
        f"round({Q.preconditions_score('o.preconditions')}, 4) AS preconditions_score "
        "FROM (SELECT id, unnest(option_analysis) AS o, "
        "generate_subscripts(option_analysis, 1) AS o_index FROM analysed)",
        "analysed",
    ),
)
def preconditions_score(spark, sf_dir):
    options = V.scoring_input(spark, sf_dir).select(
        "id", F.posexplode("option_analysis").alias("option_index", "o")
    )
    return options.select(
        "id",
        F.col("option_index").cast("bigint").alias("option_index"),
        F.round(S.preconditions_score(F.col("o.preconditions")), 4).alias("preconditions_score"),
    )


@query(
    "deduction_score",
    Q.sql(
        "SELECT id, (o_index - 1)::BIGINT AS option_index, "
        f"round({Q.deduction_score('o.expressions')}, 4) AS deduction_score "
        "FROM (SELECT id, unnest(option_analysis) AS o, "
        "generate_subscripts(option_analysis, 1) AS o_index FROM analysed)",
        "analysed",
    ),
)
def deduction_score(spark, sf_dir):
    options = V.scoring_input(spark, sf_dir).select(
        "id", F.posexplode("option_analysis").alias("option_index", "o")
    )
    return options.select(
        "id",
        F.col("option_index").cast("bigint").alias("option_index"),
        F.round(S.deduction_score(F.col("o.deduction_steps")), 4).alias("deduction_score"),
    )


@query(
    "options_score",
    Q.sql(
        "SELECT id, round("
        + Q._total(
            f"list_transform(option_analysis, lambda o: {Q.preconditions_score('o.preconditions')}"
            f" + {Q.deduction_score('o.expressions')})"
        )
        + ", 4) AS options_score FROM analysed",
        "analysed",
    ),
)
def options_score(spark, sf_dir):
    return V.scoring_input(spark, sf_dir).select(
        "id", F.round(S.options_score(F.col("option_analysis")), 4).alias("options_score")
    )


@query("raw_log_score", Q.sql("SELECT id, round(score_log, 6) AS score_log FROM raw", "raw"))
def raw_log_score(spark, sf_dir):
    return with_raw_score(V.scoring_input(spark, sf_dir)).select(
        "id", F.round("score_log", 6).alias("score_log")
    )


@query(
    "layernorm_sigmoid",
    Q.sql(
        """SELECT raw.id, raw.dataname,
  round(1.0::DOUBLE / (1.0::DOUBLE + exp(-((score_log - m) / sqrt(v + 1e-5)))), 6) AS score_norm
FROM raw JOIN (SELECT dataname, avg(score_log) AS m, var_pop(score_log) AS v FROM raw GROUP BY dataname) s
  ON raw.dataname = s.dataname""",
        "raw",
    ),
)
def layernorm_sigmoid(spark, sf_dir):
    """Normalised per data set."""
    raw = materialise(
        with_raw_score(V.scoring_input(spark, sf_dir)).select("id", "dataname", "score_log"),
        "raw-scores",
    )
    return normalise(raw, group_cols=["dataname"]).select(
        "id", "dataname", F.round("score_norm", 6).alias("score_norm")
    )


@query(
    "score_stats",
    Q.sql(
        "SELECT round(avg(score_log), 6) AS mean, round(var_pop(score_log), 6) AS variance FROM raw",
        "raw",
    ),
)
def stats(spark, sf_dir):
    """The one-row dataset statistics that the normalisation freezes."""
    found = score_stats(with_raw_score(V.scoring_input(spark, sf_dir)))
    return found.select(*[F.round(c, 6).alias(c) for c in ("mean", "variance")])


# Scores cut to 16 binary digits are whole numbers k / 65536.  Their sum K is exact, so the mean is
# one division; the variance is (n Q - K^2) / (n^2 2^32), of which 57 to 61 binary digits are made
# in whole numbers, with any rest marked in the last one, and rounded by the cast.
@query(
    "score_stats_exact",
    Q.sql(
        """SELECT * FROM (SELECT dataname, n, k::DOUBLE / (65536.0::DOUBLE * n) AS mean,
  ((q // (n * n)::HUGEINT)::BIGINT | CASE WHEN q % (n * n)::HUGEINT <> 0 THEN 1 ELSE 0 END)::DOUBLE
    / 288230376151711744.0::DOUBLE AS variance
FROM (SELECT dataname, n, k, (n::HUGEINT * kk - k::HUGEINT * k) * 67108864::HUGEINT AS q
  FROM (SELECT dataname, count(*) AS n, sum(k)::BIGINT AS k, sum(k::HUGEINT * k)::HUGEINT AS kk
    FROM (SELECT dataname, floor(score_log * 65536)::BIGINT AS k FROM raw) GROUP BY dataname))),
  (VALUES (1), (13)) t(partitions)""",
        "raw",
    ),
)
def exact_stats(spark, sf_dir):
    """Unrounded statistics of each data set, from one partition and from thirteen."""
    raw = materialise(
        with_raw_score(V.scoring_input(spark, sf_dir)).select("id", "dataname", "score_log"),
        "raw-scores",
    )
    cut = raw.withColumn("score_log", F.floor(F.col("score_log") * 65536) / 65536.0)
    both = None
    for partitions in (1, 13):
        dealt = cut.coalesce(1) if partitions == 1 else cut.repartition(partitions, "id")
        counts = dealt.groupBy(F.col("dataname").alias("_d")).agg(F.count("*").alias("n"))
        found = score_stats(dealt, ["dataname"]).join(counts, F.col("dataname").eqNullSafe(F.col("_d")))
        found = found.select("dataname", "n", "mean", "variance", F.lit(partitions).alias("partitions"))
        both = found if both is None else both.unionByName(found)
    return both


@query(
    "score_items",
    Q.sql(
        "SELECT i.id, i.dataname, i.task_type, i.reasoning_type, i.context, i.question, i.answer, "
        "i.split, round(s.score_log, 6) AS score_log, round(s.score_norm, 6) AS score_norm "
        "FROM items i JOIN scores s ON i.id = s.id AND i.dataname = s.dataname",
        "scores",
    ),
)
def scored_items(spark, sf_dir):
    """Whole records with both scores."""
    keep = ["id", "dataname", "task_type", "reasoning_type", "context", "question", "answer", "split"]
    return score_items(V.scoring_input(spark, sf_dir), keep=keep).select(
        *keep,
        F.round("score_log", 6).alias("score_log"),
        F.round("score_norm", 6).alias("score_norm"),
    )
