import numpy as np
import pandas as pd
import pytest

from gradus.llm import pivots
from gradus.llm.binary_codes import Codes, _coded, encode, hashes_for, may_link, near_duplicates, upper_bounds
from gradus.llm.vectors import norms, rotation
from tests.llm.helpers import Forest

VECTORS = "vec_id long, embedding array<float>, label int"


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_copies(rng, centres, copies, dim, noise):
    base = unit(rng.standard_normal((centres, dim)))
    return np.concatenate([unit(base + noise * unit(rng.standard_normal(base.shape))) for _ in range(copies)])


def expected_links(ids, vectors, labels, threshold=0.98):
    n, forest = {i: 0 for i in ids}, Forest(ids)
    u = unit(np.array(vectors, dtype=np.float32).astype(np.float64))
    for i, a in enumerate(ids):
        for j in range(i):
            if labels[i] is not None and labels[i] == labels[j] and u[i] @ u[j] >= threshold:
                n[a] += 1
                n[ids[j]] += 1
                forest.join(a, ids[j])
    return {i: (n[i], forest.root(i), forest.root(i) == i) for i in ids}


@pytest.mark.parametrize("block", [2048, 7])
def test_links_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([near_copies(rng, 60, 4, 64, 0.13), near_copies(rng, 1, 60, 64, 0.14)])
    vectors = np.concatenate([vectors, vectors[:20], rng.standard_normal((100, 64))])
    labels = [None if i % 50 == 0 else i % 3 for i in range(len(vectors))]
    ids = [int(i) for i in rng.permutation(len(vectors)) + 5]
    rows = [(i, v.tolist(), label) for i, v, label in zip(ids, vectors, labels)]
    found = near_duplicates(spark.createDataFrame(rows, VECTORS), block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == expected_links(ids, vectors, labels)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x, y = unit(rng.standard_normal((4000, 64))), unit(rng.standard_normal((1, 64)))
    bits, factor = encode(x, 5)
    signs = (np.unpackbits(bits, axis=1).astype(float) * 2 - 1) / 8
    estimate = (signs @ (y @ rotation(64, 5)).T)[:, 0] / factor
    error = estimate - (x @ y.T)[:, 0]
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= 6 * np.sqrt((1 - factor**2) / factor**2 / 63)).all()


@pytest.mark.parametrize("dim", [64, 100, 7])
def test_counted_bits_bound_the_products(dim):
    rng = np.random.default_rng(3)
    x = np.concatenate([near_copies(rng, 40, 6, dim, 0.15), unit(rng.standard_normal((200, dim)))])
    frame = pd.DataFrame({"label": 0, "dim": dim, "class": np.arange(len(x)), "vector": list(x)})
    codes = Codes(_coded(frame, dim, 1, 2, 5)[0], dim)
    exact, bounds = x @ x.T, upper_bounds(codes, codes, 6.0)
    assert (bounds >= exact - 1e-9).all()
    near = may_link(codes, codes, 0.98, 6.0)
    assert near[exact >= 0.98].all()
    if dim > 50:
        # Without the margin the estimates lie around the products; most pairs need no vector.
        assert abs((upper_bounds(codes, codes, 0.0) - exact)[exact < 0.9].mean()) < 0.01
        assert near[exact < 0.5].mean() < 0.05


def test_hashes_grow_with_the_rows():
    assert hashes_for(100, 64) == 1 and hashes_for(10**6, 64) == 2 and hashes_for(10**8, 64) == 3


BAD = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]


def test_vectors_that_take_no_part(spark):
    rows = [(i, v, 1) for i, v in enumerate(BAD)]
    rows += [(10, [1.0, 0.0], 1), (11, [2.0, 0.0], 1), (12, [1.0, 0.0], None), (13, [1.0, 0.0, 0.0], 1), (11, [2.0, 0.0], 1)]
    rows += [(None, [3.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS ok", "2 AS n_links", "3 AS class")
    found = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in near_duplicates(frame).collect())
    alone = [(i or -1, 0, i, True) for i in range(6)] + [(12, 0, 12, True), (13, 0, 13, True)]
    linked = [(10, 3, 10, True), (11, 3, 10, False), (11, 3, 10, False), (-1, 3, 10, False)]
    assert found == sorted(alone + linked)
    index, shards = pivots.build_index(frame)
    near = pivots.search(index, shards, index).collect()
    assert {r.query_id for r in near} == {10, 11, 12} and {r.vec_id for r in near} == {10, 11, 12}
    assert [(r["rank"], r.vec_id) for r in near if r.query_id == 12] == [(1, 10), (2, 11), (3, 11)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert near_duplicates(empty).count() == 0
    index, shards = pivots.build_index(empty)
    assert pivots.search(index, shards, index).count() == 0


def test_extreme_lengths():
    assert np.allclose(norms(np.array([[3e200, 4e200], [3e-200, 4e-200]])) / [5e200, 5e-200], 1)


def test_recall_against_all_rows(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.standard_normal((2500, 64)), near_copies(rng, 100, 4, 64, 0.2)]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    index, shards = pivots.build_index(spark.createDataFrame(rows, VECTORS), shard_rows=1500)
    assert shards == 2 and index.count() == len(rows)
    found = pivots.search(index, shards, index.where("id % 50 = 0"), rerank=256).collect()
    u, hits, n = unit(vectors.astype(np.float64)), 0, 0
    for q in range(0, len(rows), 50):
        own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        score = u @ u[q]
        score[q] = -2
        best = sorted(range(len(rows)), key=lambda i: (-score[i], i))[:5]
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and q not in [i for _, i, _ in own]
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in own)
        assert [i for _, i, _ in own] == sorted((i for _, i, _ in own), key=lambda i: (-score[i], i))
        hits += len({i for _, i, _ in own} & set(best))
        n += 5
    assert hits >= 0.9 * n


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(40)] + [(i, [1.0, -1.0], 0) for i in range(40, 44)]
    index, shards = pivots.build_index(spark.createDataFrame(rows, VECTORS), shard_rows=10)
    found = pivots.search(index, shards, index.where("id IN (0, 43)"), rerank=6).collect()
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 0), key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 43), key=lambda r: r["rank"])] == [40, 41, 42, 0, 1]
