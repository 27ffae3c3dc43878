import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm import lexical
from gradus.llm.lexical import build_index, pack_lists, search, terms_of
from tests.llm.helpers import ODD_TEXTS, docs

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_all_documents(texts, queries, k=50):
    """Scores of all documents, in whole numbers."""
    counts = [(key, Counter(plain_terms(t))) for key, t in texts]
    held = [(key, c, sum(c.values())) for key, c in counts if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for key, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(plain_terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, key is None, key or 0))
        for rank, (score, null, key) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else key, -score))
    return sorted(out, key=str)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aZ09 _-\t\x7fé日 {@", max_size=60))
def test_terms(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in terms_of(text)] == plain_terms(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_blocks_give_back_their_postings_and_their_maxima(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 2000))
    n_docs = int(rng.choice([300, 70_000, 10_000_000]))
    lengths = rng.integers(1, 5000, n_docs) if n_docs < 10**6 else np.full(n_docs, 7)
    pairs = np.unique(np.stack([rng.integers(0, 5, size), rng.integers(0, n_docs, size)]), axis=1)
    term, doc = pairs
    tf = rng.integers(1, int(rng.choice([3, 300, 70_000])), pairs.shape[1])
    (heads, head_ends), (fronts, front_ends), (data, data_ends) = pack_lists(term, doc, tf, lengths[doc])
    shard = lexical._Docs(lengths.astype("<i8").tobytes(), b"\1" * n_docs, b"\0" * 8 * n_docs, n_docs, int(lengths.sum()))
    for i, t in enumerate(np.unique(term)):
        a = [0, *head_ends][i], [0, *front_ends][i], [0, *data_ends][i]
        b = head_ends[i], front_ends[i], data_ends[i]
        one = lexical._List(heads[a[0] : b[0]].tobytes(), fronts[a[1] : b[1]].tobytes(), data[a[2] : b[2]].tobytes(), shard)
        own = term == t
        each = lexical._saturated(tf[own], shard.m[doc[own]])
        assert [len(one.block(j)[0]) for j in range(len(one.head))] == [len(x) for x in np.split(doc[own], range(128, own.sum(), 128))]
        assert one.most.tolist() == [int(x.max()) for x in np.split(each, range(128, own.sum(), 128))]
        found, scores = one.whole()
        assert found.tolist() == doc[own].tolist() and scores.tolist() == each.tolist()


@pytest.mark.parametrize("tokens", [lexical.SHARD_TOKENS, 3000])
def test_search_against_all_documents(spark, monkeypatch, tokens):
    monkeypatch.setattr(lexical, "SHARD_TOKENS", tokens)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    odds = 1 / np.arange(1, 401) ** 1.1
    texts = [" ".join(rng.choice(words, rng.integers(0, 150), p=odds / odds.sum())) for _ in range(1500)]
    texts += [texts[3]] * 60 + ODD_TEXTS
    queries = [(i, " ".join(rng.choice(words, rng.integers(1, 12), p=odds[::-1] / odds.sum()))) for i in range(20)]
    queries += [(i, " ".join(rng.choice(words, 40, p=odds / odds.sum()))) for i in range(20, 30)]
    queries += [(30, None), (31, ""), (32, "nowhere"), (33, texts[3]), (34, "日本 É W1 w1"), (None, "w1")]
    frame = docs(spark, texts).selectExpr("nullif(doc_id, 1505) AS doc_id", "text", "1 AS term", "2 AS id").repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    rows = search(build_index(frame), asked, at_once=12).collect()
    expected = by_all_documents([(None if i == 1505 else i, t) for i, t in enumerate(texts)], [q for q in queries if q[0] is not None])
    assert sorted((tuple(r) for r in rows), key=str) == expected


def test_odd_tables(spark):
    none = docs(spark, [])
    asked = spark.createDataFrame([(1, "a b"), (1, "b c"), (1, "b c")], "item_id long, text string")
    assert search(build_index(none), asked).count() == 0
    assert search(build_index(docs(spark, [None, ""])), asked).count() == 0
    rows = search(build_index(docs(spark, ["c", "x", "a b c"])), asked).collect()
    assert [tuple(r) for r in sorted(rows)] == by_all_documents([(0, "c"), (1, "x"), (2, "a b c")], [(1, "a b c")])
    assert search(build_index(docs(spark, ["a"])), asked.limit(0)).count() == 0
