import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm import variants
from gradus.llm.queries import QUERIES
from gradus.llm.variants import LETTERS, edits_that_pass, group_variants, shard_blocks, spelling_variants
from tests.llm.helpers import ODD_TEXTS, docs


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def by_all_pairs(counts, times=2):
    out = {}
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        form = min(others, key=lambda o: (-counts[o], o), default=None)
        if form is not None and counts[form] < times * n:
            form = None
        out[word] = (form, n, len(others), counts.get(form))
    def root(word):
        while out[word][0] is not None:
            word = out[word][0]
        return word
    return {(w, f, root(w), n, m, fn) for w, (f, n, m, fn) in out.items()}


def words_of(texts, noise=97):
    counts = Counter()
    for key, text in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{key}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def found(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=2, max_size=6), min_size=1, max_size=30, unique=True))
def test_edits_reach_every_near_word_once(words):
    everything = {s: np.full(1, 2**64 - 1, dtype=np.uint64) for s in range(2 * variants.LENGTHS)}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    pairs = []
    for length, own in by_length.items():
        for place, edit in edits_that_pass(own, length, everything, "abé", 2):
            assert near(own[place], edit)
            pairs.append((own[place], edit))
    assert len(pairs) == len(set(pairs))
    reached = {frozenset(p) for p in pairs if p[1] in words}
    assert reached == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_a_vocabulary(spark):
    rng = np.random.default_rng(5)
    words = {"aaaaa": 40, "aaaaaa": 9, "z" * 70: 30, "z" * 71: 7, "z" * 69 + "y": 7, "q" * 30_000: 5, "q" * 29_999 + "r": 2}
    for _ in range(300):
        base = "".join(rng.choice(list("abcdéÿ"), rng.integers(5, 9)))
        words[base] = int(rng.integers(3, 2000))
        for _ in range(3):
            at = int(rng.integers(0, len(base)))
            words[base[:at] + rng.choice(list("abéÀ")) + base[at:]] = int(rng.integers(3, 300))
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(group_variants(frame)) == by_all_pairs(words)
    chain = {"aaaaa" + "b" * i: 3 * 2 ** (9 - i) for i in range(10)}
    frame = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert {r.root for r in group_variants(frame).collect()} == {"aaaaa"}
    with pytest.raises(ValueError):
        group_variants(frame, times=1)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(variants, "MOST_BLOCKS", 4)
    monkeypatch.setattr(variants, "LEAST_BLOCKS", 1)
    words = {w + x: 3 + i for i, w in enumerate(["house", "mouse", "loose", "goose", "grouse"]) for x in ("", "s", "d")}
    assert sum(shard_blocks({s: 10**6 for s in (5, 6, 7)}).values()) <= 4
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(group_variants(frame)) == by_all_pairs(words)


def test_odd_documents(spark):
    texts = [*ODD_TEXTS, "Straße STRASSE straßen Éclair éclair ×÷×÷×"] * 3 + ["Straße"] * 4
    rows = docs(spark, texts).selectExpr("*", "1 AS word", "2 AS n", "3 AS id")
    # A null id reads as an empty string, and a repeated row counts again.
    nulls = rows.where("doc_id > 26").selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars", "word", "n", "id")
    expected = [*enumerate(texts), *(("", t) for t in texts[27:])]
    assert found(spelling_variants(rows.unionByName(nulls), noise=7)) == by_all_pairs(words_of(expected, 7))
    assert found(spelling_variants(rows.limit(0))) == set()


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts = words_of(texts)
    rows = QUERIES["op12_variants"](spark, sf_dir)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = found(rows)
    assert {(w, n) for w, _, _, n, _, _ in got} == set(counts.items())
    # All pairs of the words, by lengths.
    assert got == by_all_pairs(counts) and LETTERS
