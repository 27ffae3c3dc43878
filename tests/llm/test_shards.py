import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm.shards import combined, differencing, exchanged, shard_by_bytes, summed
from tests.llm.helpers import ODD_TEXTS, docs


def sums(sizes, parts_of, parts):
    out = [0] * parts
    for size, part in zip(sizes, parts_of):
        out[part] += size
    return out


def test_differencing_known_case():
    # The classic example: 8, 7, 6, 5, 4 in two parts ends with a difference of 2.
    assert sorted(sums([8, 7, 6, 5, 4], differencing([8, 7, 6, 5, 4], 2), 2)) == [14, 16]
    assert differencing([], 3) == []
    assert sorted(differencing([5, 5, 5], 3)) == [0, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40), st.integers(1, 5))
def test_differencing_is_close_to_even(sizes, parts):
    found = sums(sizes, differencing(sizes, parts), parts)
    assert sum(found) == sum(sizes)
    assert max(found) - min(found) <= max(sizes, default=0)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 200), min_size=n, max_size=n), max_size=12)))
def test_combined_partitions_are_close_to_even(partials):
    partials = [sorted(p, reverse=True) for p in partials]
    moves = combined(partials)
    assert all(sorted(m) == list(range(len(m))) for m in moves)
    if partials:
        found = summed(partials, moves, len(partials[0]))
        assert found == sorted(found, reverse=True) and sum(found) == sum(map(sum, partials))
        assert max(found) - min(found) <= max(p[0] - p[-1] for p in partials)


def test_only_parts_of_equal_start_are_exchanged():
    moves = exchanged([[5, 1, 9, 2], [7, 1, 9, 2]], [3, 0, 3, 0])
    assert all({m[0], m[2]} == {0, 2} and {m[1], m[3]} == {1, 3} for m in moves)
    assert summed([[5, 1, 9, 2], [7, 1, 9, 2]], moves, 4) in ([14, 3, 16, 3], [16, 3, 14, 3])
    assert exchanged([], [0, 0]) == []


@pytest.mark.parametrize("start", [[0] * 16, [400_000] + [0] * 15, [i * 9_001 for i in range(16)]])
def test_a_start_is_evened_out(start):
    sizes = [(i * 7919) % 10_007 + 1 for i in range(4_096)]
    found = [a + b for a, b in zip(start, sums(sizes, differencing(sizes, 16, start), 16))]
    assert max(found) - min(found) <= 16


def test_differencing_beats_dealing_by_size():
    sizes = [(i * 7919) % 10_007 + 1 for i in range(500)]
    dealt = [0] * 16
    for size in sorted(sizes, reverse=True):
        dealt[dealt.index(min(dealt))] += size
    found = sums(sizes, differencing(sizes, 16), 16)
    assert max(found) - min(found) <= max(dealt) - min(dealt)


def check(rows, texts, shards):
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for shard in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    home = {}
    for r in rows:
        assert home.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
    return [sum(r.size for r in rows if r.shard == s) for s in range(shards)]


def test_groups_stay_together_and_bytes_are_even(spark):
    texts = ["copy"] * 300 + [f"text {i} " * (i % 37 + 1) for i in range(900)]
    loads = check(shard_by_bytes(docs(spark, texts)).collect(), texts, 16)
    assert max(loads) - min(loads) <= 3
    # Many blocks a task: every group is still differenced as itself.
    loads = check(shard_by_bytes(docs(spark, texts), shards=4, block=16).collect(), texts, 4)
    assert max(loads) - min(loads) <= 64
    # A group of half of all bytes leaves the other shards even.
    texts = ["x" * 99] * 1000 + [f"text {i} " * (i % 37 + 1) for i in range(600)]
    loads = check(shard_by_bytes(docs(spark, texts), block=100).collect(), texts, 16)
    assert max(loads) == 100_000 and sorted(loads)[-2] - min(loads) <= 128


def test_odd_rows(spark):
    texts = [*ODD_TEXTS, "same", "same"]
    check(shard_by_bytes(docs(spark, texts), shards=3).collect(), texts, 3)
    assert shard_by_bytes(docs(spark, [])).count() == 0
    clash = docs(spark, ["a", "b"]).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS size", "4 AS grp")
    assert shard_by_bytes(clash.unionByName(clash)).count() == 4
    nulls = docs(spark, ["a", "b"]).selectExpr("CAST(NULL AS long) AS doc_id", "text")
    assert {r.doc_id for r in shard_by_bytes(nulls).collect()} == {None}
    with pytest.raises(ValueError):
        differencing([1], 0)
