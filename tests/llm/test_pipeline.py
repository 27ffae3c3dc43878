"""The pipeline against plain versions of its stages, and the registered queries."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare
from gradus.llm.mixing import mix_sources
from gradus.llm.pieces import MODEL, load
from gradus.llm.queries import ORACLES, QUERIES
from gradus.llm.quality import score_documents
from gradus.llm.simhash import fingerprint
from tests.llm.helpers import Forest


def test_all_are_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert names == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql(name, spark, sf_dir, database):
    assert compare(QUERIES[name](spark, sf_dir), database, ORACLES[name]) is None


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in score_documents(docs, labels).collect() if r.predicted}
    texts = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    ids = sorted(texts)
    prints = np.array([fingerprint(texts[i].text) for i in ids], dtype=np.int64).view(np.uint64)
    forest = Forest(ids)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 4):
            forest.join(i, ids[b])
    once = [tuple(texts[i]) for i in ids if forest.root(i) == i]
    mixed = mix_sources(spark.createDataFrame(once, docs.schema), power=0.5, seed=7).collect()
    model = load(MODEL)
    expected = Counter((r.doc_id, tuple(model.encode(r.text).tolist())) for r in mixed)
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.pieces)) for r in found) == expected


def test_stages_take_odd_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (None, "a b c", "en", None, 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0)],
        docs.schema,
    )
    clash = odd.selectExpr("*", "1 AS fingerprint", "2 AS pieces", "3 AS copy", "4 AS features")
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd, odd.limit(0), clash):
            out = stage(spark, frame, sf_dir)
            out.write.mode("overwrite").parquet(str(tmp_path / name))
            if name != "pieces":
                assert out.columns == docs.columns
    # Nulls and copies: one row of each class stays.
    rows = corpus_pipeline.near_copies(spark, odd, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (True, 0)]
