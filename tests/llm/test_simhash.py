import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm.components import connected_components
from gradus.llm.simhash import _linked, chain_keys, chains, fingerprint, simhash_components, simhash_links
from tests.llm.helpers import ODD_TEXTS, Forest, docs


def by_bits(text, n=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x1c ß日", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) & (2**64 - 1) == by_bits(text)


def test_fingerprint_of_odd_texts():
    assert [fingerprint(t) & (2**64 - 1) for t in ODD_TEXTS[:8]] == [by_bits(t) for t in ODD_TEXTS[:8]]
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=6, unique=True))
def test_a_linked_pair_meets_under_exactly_one_key_of_some_chain(value, bits):
    other = value
    for b in bits:
        other ^= 1 << b
    both = np.array([value, other], dtype=np.uint64)
    for budget in (1, 2, 4, 5, 15):
        keys, tags = chain_keys(both, budget)
        met = [
            tag
            for column, tag in enumerate(tags.tolist())
            if keys[0, column] == keys[1, column] and len(_linked(both[:1], both[1:], tag, budget))
        ]
        assert bool(met) == (len(bits) <= budget)
        starts = [chains(budget)[tag].first for tag in met]
        assert len(starts) == len(set(starts))


def test_three_segments_make_the_keys():
    """Keys of at least 28 bits for 4 bits of 64: chance meetings fall with every bit."""
    values = np.random.default_rng(5).integers(0, 2**63, 200_000).astype(np.uint64)
    keys, tags = chain_keys(values, 4)
    assert keys.shape[1] == len(set((keys[0] >> np.uint64(56)).tolist())) == 5 * 11
    ordered = np.sort(keys, axis=0)
    meetings = (ordered[1:] == ordered[:-1]).sum()
    # Under the first two segments alone each of 65 keys had 25 bits: 600 meetings a key.
    assert meetings < 55 * 200_000**2 / 2 / 2**28


def components(values, budget):
    forest = Forest(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if bin((a ^ values[j]) & (2**64 - 1)).count("1") <= budget:
                forest.join(i, j)
    return [forest.root(i) for i in range(len(values))]


@pytest.mark.parametrize("block, budget", [(2048, 4), (3, 4), (2048, 1), (3, 7)])
def test_links_join_the_classes_of_all_pairs(spark, block, budget):
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 40)]
    for v in values[:12]:
        for _ in range(9):
            w = v & (2**64 - 1)
            for b in rng.choice(64, rng.integers(1, budget + 1), replace=False):
                w ^= 1 << int(b)
            values.append(w - 2**64 if w >> 63 else w)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    forest = Forest(range(len(values)))
    place = {v: i for i, v in reversed(list(enumerate(values)))}
    for a, b in simhash_links(frame, budget, block).collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= budget
        forest.join(place[a], place[b])
    expected = components(values, budget)
    assert [forest.root(place[v]) for v in values] == [expected[place[v]] for v in values]


def test_components_of_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [*ODD_TEXTS, base, base + " end", base.upper(), "word1 word2", *["copy of it all"] * 50]
    rows = simhash_components(docs(spark, texts), keep=("lang",)).collect()
    values = [by_bits(t) for t in texts]
    expected = components(values, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{v:016x}", expected[i]) for i, v in enumerate(values)
    }
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(set(expected))


def test_odd_tables(spark):
    assert simhash_components(docs(spark, [])).count() == 0
    twice = docs(spark, ["one two", "three four"]).selectExpr("*", "0 AS fingerprint", "1 AS _fp", "2 AS key")
    rows = simhash_components(twice.unionByName(twice)).collect()
    assert len(rows) == 4 and sorted(r.doc_id for r in rows if r.kept) == [0, 1]
    nulls = docs(spark, ["a", "b"]).selectExpr("nullif(doc_id, 0) AS doc_id", "'x y' AS text")
    rows = simhash_components(nulls).collect()
    assert [(r.doc_id, r.component_id) for r in rows if r.kept] == [(1, 1)]
    with pytest.raises(ValueError):
        simhash_links(spark.createDataFrame([], "fp long"), budget=0)


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    edges = [*chain, (100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (201, 202), (300, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = dict(connected_components(frame, "a", "b").collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{i: 200 for i in (200, 201, 202, 300)}}
    assert connected_components(frame.limit(0), "a", "b").count() == 0
