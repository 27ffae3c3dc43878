"""Orders and sampling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.registry import query
from gradus.functions.bins import BUCKET_EDGES
from gradus.operators import ordering as O
from gradus.operators.binning import bucket
from gradus.operators.joins import split_train_eval
from gradus.plans import monitor as W
from gradus.plans import sampling as P
from gradus.plans import schedule as H

SEED = 11


def h60(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 15))::BIGINT"


def h120(*parts: str) -> str:
    digest = "md5(" + " || '|' || ".join(parts) + ")"
    high, low = (f"('0x' || substr({digest}, {at}, 15))::BIGINT::HUGEINT" for at in (1, 16))
    return f"({high} * 1152921504606846976::HUGEINT + {low})"


def numbered(order: str) -> str:
    return f"(row_number() OVER (ORDER BY {order}) - 1)::BIGINT"


@query(
    "order_by_score",
    Q.sql(
        f"SELECT dataname, id, {numbered('score_norm DESC, dataname, id')} AS position, "
        "round(score_norm, 6) AS score_norm FROM scores",
        "scores",
    ),
)
def order_by_score(spark, sf_dir):
    scored = V.scores(spark, sf_dir).withColumn("tie", F.struct("dataname", "id"))
    return O.order_by_score(scored, "score_norm", "tie", descending=True).select(
        "dataname", "id", "position", F.round("score_norm", 6).alias("score_norm")
    )


@query(
    "head_tail_check",
    Q.sql(
        """SELECT side, rank::BIGINT AS rank, round(score_norm, 6) AS score_norm, id FROM (
  SELECT 'first' AS side, row_number() OVER (ORDER BY score_norm, id) AS rank, score_norm, id FROM scores
  UNION ALL
  SELECT 'last', row_number() OVER (ORDER BY score_norm DESC, id DESC), score_norm, id FROM scores)
WHERE rank <= 3""",
        "scores",
    ),
)
def head_tail_check(spark, sf_dir):
    return O.head_tail(V.scores(spark, sf_dir), "score_norm", "id").select(
        "side",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("score_norm", 6).alias("score_norm"),
        "id",
    )


@query(
    "chunk_slices",
    Q.sql(
        f"""SELECT id, dataname, position, position // 10000 AS chunk, (position % 10000) // 128 AS batch
FROM (SELECT id, dataname, {numbered('dataname, id')} AS position FROM items)""",
        "items",
    ),
)
def chunk_slices(spark, sf_dir):
    numbers = O.with_position(V.items(spark, sf_dir).select("id", "dataname"), ["dataname", "id"])
    return O.chunk_slices(numbers)


@query(
    "plan_sequential",
    Q.sql(
        f"""SELECT e::BIGINT AS epoch, position, dataname, id
FROM (SELECT dataname, id, {numbered('dataname, id')} AS position FROM items), range(16) t(e)""",
        "items",
    ),
)
def plan_sequential(spark, sf_dir):
    return shown(P.plan_sequential(V.items(spark, sf_dir)))


def shown(plan):
    return plan.select(
        F.col("epoch").cast("bigint").alias("epoch"),
        F.col("position").cast("bigint").alias("position"),
        "dataname",
        "id",
    )


@query(
    "plan_sorted",
    Q.sql(
        f"""SELECT e::BIGINT AS epoch, position, dataname, id
FROM (SELECT dataname, id, {numbered('score_norm, dataname, id')} AS position FROM scores), range(3) t(e)""",
        "scores",
    ),
)
def plan_sorted(spark, sf_dir):
    return shown(P.sampling_plan(V.scores(spark, sf_dir), "sorted", epochs=3))


@query(
    "plan_shuffle",
    Q.sql(
        f"""SELECT e::BIGINT AS epoch, dataname, id, (row_number() OVER (PARTITION BY e
  ORDER BY {h60(f"'{SEED}'", 'e', 'dataname', 'id')}, dataname, id) - 1)::BIGINT AS position
FROM items, range(16) t(e)""",
        "items",
    ),
)
def plan_shuffle(spark, sf_dir):
    return shown(P.plan_shuffle(V.items(spark, sf_dir), seed=SEED))


def drawn_sql(epochs: str, stage: str) -> str:
    """Draws from the ``lined`` rows (stage, dataname, id, lo, total)."""
    return f"""SELECT d.epoch, d.position, l.dataname, l.id
FROM (SELECT e::BIGINT AS epoch, i::BIGINT AS position, {stage} AS stage,
    {h120(f"'{SEED}'", 'e', 'i')} % (SELECT max(total) FROM lined WHERE lined.stage = {stage}) AS u
  FROM ({epochs}) t(e), range((SELECT count(*) FROM scores)) r(i)) d
ASOF JOIN lined l ON d.stage = l.stage AND d.u >= l.lo"""


def lined_sql(weights: str) -> str:
    """Items on a line, one after the other, as long as their weights."""
    return f"""lined AS (SELECT stage, dataname, id,
    (sum(w) OVER (PARTITION BY stage ORDER BY dataname, id) - w)::BIGINT AS lo,
    sum(w) OVER (PARTITION BY stage)::BIGINT AS total
  FROM ({weights}))"""


@query(
    "plan_weighted",
    Q.sql(
        f"""SELECT 0::BIGINT AS epoch, {numbered('dataname, id')} AS position, dataname, id FROM scores
UNION ALL {drawn_sql('SELECT unnest(range(1, 16))', '0')}""",
        "scores",
        extra=lined_sql(
            "SELECT 0 AS stage, dataname, id, round((score_norm + 1e-6) * 1000000)::BIGINT AS w FROM scores"
        ),
    ),
)
def plan_weighted(spark, sf_dir):
    """First epoch in order, then fifteen epochs of weighted draws."""
    return shown(P.plan_weighted(V.scores(spark, sf_dir), seed=SEED))


STAGE_SQL = "CASE WHEN e < 3 THEN 0 WHEN e < 7 THEN 1 WHEN e < 11 THEN 2 ELSE 3 END"


@query(
    "plan_staged",
    Q.sql(
        drawn_sql("SELECT unnest(range(0, 16))", STAGE_SQL),
        "scores",
        extra=lined_sql(
            """SELECT stage, dataname, id, round(1000000 * CASE WHEN score_norm >= 0.7 THEN sw * 2.5e0
    WHEN score_norm >= 0.5 THEN sw * 1.5e0 ELSE 1e0 END)::BIGINT AS w
  FROM scores, (VALUES (0, 1e0), (1, 8e-1), (2, 6e-1), (3, 4e-1)) t(stage, sw)"""
        ),
    ),
)
def plan_staged(spark, sf_dir):
    return shown(P.plan_staged(V.scores(spark, sf_dir), seed=SEED))


@query(
    "stage_of_epoch",
    Q.sql(
        f"""SELECT e::BIGINT AS epoch, ({STAGE_SQL})::BIGINT AS stage,
  (SELECT count(*) FROM scores WHERE score_norm >= 0 AND score_norm <
    CASE {STAGE_SQL} WHEN 0 THEN 3e-1 WHEN 1 THEN 5e-1 WHEN 2 THEN 7e-1 ELSE 1e0 END)::BIGINT AS n_items
FROM range(16) t(e)""",
        "scores",
    ),
)
def stage_of_epoch(spark, sf_dir):
    """Stage of each epoch and the items in the buckets up to it."""
    n = len(BUCKET_EDGES) - 1
    sizes = V.scores(spark, sf_dir).agg(
        F.array(*[F.count(F.when(bucket(F.col("score_norm")) <= s, 1)) for s in range(n)]).alias("n")
    )
    stage = H.stage_of_epoch(F.col("epoch"))
    return (
        H.epoch_frame(spark)
        .withColumn("stage", stage)
        .select(
            F.col("epoch").cast("bigint").alias("epoch"),
            F.col("stage").cast("bigint").alias("stage"),
            F.element_at(sizes.select("n").scalar(), F.col("stage") + 1).alias("n_items"),
        )
    )


# Limit of each epoch by the recurrence: slow growth for 70 % of the run, then fast.
LIMITS_SQL = """limits(epoch, max_score) AS (
  SELECT 0, 0.3::DOUBLE
  UNION ALL
  SELECT epoch + 1, least(1.0::DOUBLE, max_score + (1 - max_score) *
    CASE WHEN epoch / 15.0::DOUBLE <= 0.7 THEN 0.15::DOUBLE * (1 - 0.5::DOUBLE * (epoch / 15.0::DOUBLE))
    ELSE 0.3::DOUBLE * (1 + 2 * (epoch / 15.0::DOUBLE - 0.7::DOUBLE)) END)
  FROM limits WHERE epoch < 15)"""


@query(
    "curriculum_schedule",
    Q.sql(
        """SELECT epoch::BIGINT AS epoch, round(max_score, 6) AS max_score,
  (SELECT count(*) FROM scores WHERE score_norm <= max_score)::BIGINT AS n_items FROM limits""",
        "scores",
        extra=LIMITS_SQL,
        recursive=True,
    ),
)
def curriculum_schedule(spark, sf_dir):
    """Score limit of each epoch and the items within it."""
    limits = H.Curriculum().limits()
    score = F.col("score_norm")
    sizes = V.scores(spark, sf_dir).agg(
        F.array(*[F.count(F.when(score <= x, 1)) for x in limits]).alias("n")
    )
    return H.curriculum_frame(spark).select(
        F.col("epoch").cast("bigint").alias("epoch"),
        F.round("max_score", 6).alias("max_score"),
        F.element_at(sizes.select("n").scalar(), F.col("epoch") + 1).alias("n_items"),
    )


ELIGIBLE_SQL = (
    LIMITS_SQL
    + """,
used_limits AS (
  SELECT epoch, CASE WHEN (SELECT count(*) FROM scores WHERE score_norm <= max_score)
      < 0.3 * (SELECT count(*) FROM scores)
    THEN (SELECT quantile_cont(score_norm, 0.3) FROM scores) ELSE max_score END AS used, max_score
  FROM limits),
eligible AS (
  SELECT epoch, dataname, id, score_norm, max_score FROM scores, used_limits WHERE score_norm <= used)"""
)


@query(
    "curriculum_eligible",
    Q.sql(
        "SELECT epoch::BIGINT AS epoch, dataname, id FROM eligible",
        "scores",
        extra=ELIGIBLE_SQL,
        recursive=True,
    ),
)
def curriculum_eligible(spark, sf_dir):
    return P.curriculum_eligible(V.scores(spark, sf_dir)).select(
        F.col("epoch").cast("bigint").alias("epoch"), "dataname", "id"
    )


EXTRA_SQL = f"""hard AS (
  SELECT dataname, id, {numbered('score_norm, dataname, id')} AS n FROM scores WHERE score_norm > 0.7),
extra AS (
  SELECT x.epoch::BIGINT AS epoch, x.size + x.j AS position, hard.dataname, hard.id
  FROM (SELECT epoch, size, j, {h60(f"'{SEED}'", "'hard'", 'epoch', 'j')} % (SELECT count(*) FROM hard) AS n
    FROM (SELECT epoch, count(*) AS size FROM eligible WHERE max_score < 0.8 GROUP BY epoch),
      LATERAL (SELECT unnest(range((size * 0.1::DOUBLE)::DOUBLE::BIGINT
        - CASE WHEN (size * 0.1::DOUBLE)::BIGINT > size * 0.1::DOUBLE THEN 1 ELSE 0 END)) AS j)) x
  JOIN hard ON hard.n = x.n)"""


@query(
    "curriculum_oversample",
    Q.sql(
        "SELECT epoch, position, dataname, id FROM extra",
        "scores",
        extra=ELIGIBLE_SQL + ",\n" + EXTRA_SQL,
        recursive=True,
    ),
)
def curriculum_oversample(spark, sf_dir):
    return shown(P.curriculum_oversample(V.scores(spark, sf_dir), seed=SEED))


CURRICULUM_SQL = f"""plan AS (
  SELECT epoch::BIGINT AS epoch, (row_number() OVER (PARTITION BY epoch
    ORDER BY {h60(f"'{SEED}'", 'epoch', 'dataname', 'id')}, dataname, id) - 1)::BIGINT AS position,
    dataname, id FROM eligible
  UNION ALL SELECT epoch, position, dataname, id FROM extra)"""


@query(
    "plan_curriculum",
    Q.sql(
        "SELECT epoch, position, dataname, id FROM plan",
        "scores",
        extra=",\n".join([ELIGIBLE_SQL, EXTRA_SQL, CURRICULUM_SQL]),
        recursive=True,
    ),
)
def plan_curriculum(spark, sf_dir):
    return shown(P.sampling_plan(V.scores(spark, sf_dir), "curriculum", seed=SEED))


@query(
    "plan_monitor",
    Q.sql(
        """SELECT epoch, round(avg(score_norm), 6) AS mean_score,
  sum(CASE WHEN score_norm > 0.7 THEN 1 ELSE 0 END)::BIGINT AS n_hard,
  round(sum(CASE WHEN score_norm > 0.7 THEN 1 ELSE 0 END) / count(*) * 100, 6) AS hard_percent,
  count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM scores) * 100, 6) AS coverage_percent
FROM plan JOIN scores USING (dataname, id) GROUP BY epoch""",
        "scores",
        extra=",\n".join([ELIGIBLE_SQL, EXTRA_SQL, CURRICULUM_SQL]),
        recursive=True,
    ),
)
def plan_monitor(spark, sf_dir):
    scored = V.scores(spark, sf_dir)
    plan = P.plan_curriculum(scored, seed=SEED, with_score=True)
    return W.plan_monitor(plan, scored.count()).select(
        F.col("epoch").cast("bigint").alias("epoch"),
        F.round("mean_score", 6).alias("mean_score"),
        "n_hard",
        F.round("hard_percent", 6).alias("hard_percent"),
        "n_rows",
        F.round("coverage_percent", 6).alias("coverage_percent"),
    )


@query(
    "batch_difficulty",
    Q.sql(
        """SELECT epoch, position // 16 AS batch, round(avg(score_norm), 6) AS mean_score,
  round(max(score_norm), 6) AS max_score, count(*) AS n_rows
FROM plan JOIN scores USING (dataname, id) GROUP BY ALL""",
        "scores",
        extra=",\n".join([ELIGIBLE_SQL, EXTRA_SQL, CURRICULUM_SQL]),
        recursive=True,
    ),
)
def batch_difficulty(spark, sf_dir):
    scored = V.scores(spark, sf_dir)
    plan = P.plan_curriculum(scored, seed=SEED, with_score=True)
    return W.batch_difficulty(plan).select(
        F.col("epoch").cast("bigint").alias("epoch"),
        "batch",
        F.round("mean_score", 6).alias("mean_score"),
        F.round("max_score", 6).alias("max_score"),
        "n_rows",
    )


@query(
    "split_train_eval",
    Q.sql(
        f"""SELECT dataname, id, CASE WHEN {h60(f"'{SEED}'", 'dataname', 'id')} / 1152921504606846976.0::DOUBLE < 0.1
  THEN 'eval' ELSE 'train' END AS role FROM items""",
        "items",
    ),
)
def split_train_eval_hash(spark, sf_dir):
    """Hold out a tenth by a hash of the key."""
    return split_train_eval(V.items(spark, sf_dir), seed=SEED).select("dataname", "id", "role")


@query(
    "split_train_eval_exact",
    Q.sql(
        f"""SELECT dataname, id, CASE WHEN row_number() OVER (
    ORDER BY {h60(f"'{SEED}'", 'dataname', 'id')}, dataname, id) <= (SELECT ceil(count(*) * 0.1) FROM items)
  THEN 'eval' ELSE 'train' END AS role FROM items""",
        "items",
    ),
)
def split_train_eval_exact(spark, sf_dir):
    """Hold out exactly a tenth, rounded up."""
    return split_train_eval(V.items(spark, sf_dir), seed=SEED, exact=True).select(
        "dataname", "id", "role"
    )


@query(
    "split_train_eval_none",
    Q.sql("SELECT dataname, id, 'train' AS role FROM items", "items"),
)
def split_train_eval_none(spark, sf_dir):
    """Everything is for training."""
    return split_train_eval(V.items(spark, sf_dir), mode=0).select("dataname", "id", "role")


@query(
    "split_train_eval_given",
    Q.sql(
        "SELECT dataname, id, CASE WHEN split = 'test' THEN 'eval' ELSE 'train' END AS role FROM items",
        "items",
    ),
)
def split_train_eval_given(spark, sf_dir):
    """The test items are the evaluation set."""
    items = V.items(spark, sf_dir)
    test = F.col("split") == "test"
    return split_train_eval(items.filter(~test), mode=2, eval_df=items.filter(test)).select(
        "dataname", "id", "role"
    )
