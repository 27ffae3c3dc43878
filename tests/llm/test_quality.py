import zlib

import numpy as np
from pyspark.sql import functions as F

from gradus.llm.quality import STATISTICS, _forward, fit, keep_good, score_documents, statistics
from tests.llm.helpers import ODD_TEXTS, docs

PROSE = "Some words in a plain line, number {i} of many that differ a little. And so it goes on for {j} more."


def corpus(n):
    texts, labels = [], []
    for i in range(n):
        if i % 6 == 0:
            texts.append(f"BUY!!! NOW$$$ {i}### " * (i % 9 + 3))
            labels.append(0)
        else:
            texts.append(" ".join(PROSE.format(i=i * 7 + k, j=k * i) for k in range(i % 5 + 1)))
            labels.append(1)
    return texts, labels


def test_scores_of_held_out_documents(spark):
    texts, quality = corpus(600)
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in score_documents(frame, labels).collect()}
    assert len(rows) == 600 and all(0 <= r.score <= 1 for r in rows.values())
    for i, q in enumerate(quality):
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert rows[i].predicted == (rows[i].score >= 0.3)
    held = [i for i in rows if rows[i].held_out]
    assert sum(rows[i].predicted == quality[i] for i in held) >= 0.97 * len(held)
    kept = keep_good(frame, labels)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in rows if rows[i].predicted}
    # Labels of held-out rows, language and source have no influence.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = score_documents(frame.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), turned)
    for r in other.collect():
        assert abs(r.score - rows[r.doc_id].score) < 1e-9


def test_model_is_the_shrunken_gaussian(spark):
    rng = np.random.default_rng(0)
    p = len(STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (80, p)), rng.normal(1, 2, (50, p))])
    y = np.r_[np.zeros(80, int), np.ones(50, int)]
    frame = spark.createDataFrame([(v.tolist(), int(q)) for v, q in zip(x, y)], "features array<double>, quality int")
    model = fit(frame, 0.1, 0.2)
    z = (x - x.mean(0)) / x.std(0)
    density = []
    for c in (0, 1):
        own = z[y == c]
        cov = 0.9 * np.cov(own.T, bias=True) + 0.1 * np.cov(z.T, bias=True)
        cov = 0.8 * cov + 0.2 * np.trace(cov) / p * np.eye(p)
        apart = z - own.mean(0)
        _, logdet = np.linalg.slogdet(cov)
        density.append(np.log(len(own) / len(z)) - 0.5 * logdet - 0.5 * (apart @ np.linalg.inv(cov) * apart).sum(1))
    assert np.allclose(model.log_odds(x), density[1] - density[0], atol=1e-5)


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (77, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, ODD_TEXTS).selectExpr("*", "1 AS features", "2 AS score", "3 AS quality")
    rows = score_documents(frame.unionByName(frame), labels).collect()
    assert len(rows) == 2 * len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert score_documents(docs(spark, []), labels).count() == 0
    assert {r.score for r in score_documents(frame, labels.limit(0)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(9)], labels.schema)
    assert {r.score for r in score_documents(frame, ones).collect()} == {1.0}
    assert all(np.isfinite(statistics(t)).all() for t in ODD_TEXTS)
    nulls = frame.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.held_out for r in score_documents(nulls, labels).collect()} == {False}


def test_same_bits_on_any_partitioning(spark):
    texts, quality = corpus(300)
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], "doc_id long, quality int, toxic int")
    found = []
    for n in (1, 3, 13):
        rows = score_documents(frame.repartition(n, F.xxhash64("text")), labels.repartition(n)).collect()
        found.append({r.doc_id: r.score.hex() for r in rows})
    assert len(found[0]) == 300 and found[0] == found[1] == found[2]


def test_forward_substitution():
    rng = np.random.default_rng(1)
    factor, columns = np.tril(rng.normal(0, 1, (9, 9))) + 3 * np.eye(9), rng.normal(0, 1, (9, 70))
    solved = _forward(factor, columns)
    assert np.allclose(factor @ solved, columns)
    alone = np.concatenate([_forward(factor, columns[:, [i]]) for i in range(70)], axis=1)
    assert (alone == solved).all()
