"""Tables of vectors of several lengths."""

import numpy as np

from gradus.llm import pivots


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8 if i < 60 else 5).tolist()) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, shards = pivots.build_index(frame, shard_rows=25)
    assert index.count() == 100 and shards == 3 + 2
    found = pivots.search(index, shards, index).collect()
    assert len(found) == 500
    for own in (range(60), range(60, 100)):
        unit = np.array([rows[i][1] for i in own])
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        score = unit @ unit.T
        np.fill_diagonal(score, -2)
        for q, best in zip(own, np.argsort(-score, axis=1)[:, :5] + own[0]):
            mine = sorted((r["rank"], r.vec_id) for r in found if r.query_id == q)
            assert [v for _, v in mine] == best.tolist()
