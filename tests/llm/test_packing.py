import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradus.llm.packing import Limits, Pool, encoder, pack_documents, pack_examples, sequences
from gradus.llm.queries import QUERIES
from tests.llm.helpers import ODD_TEXTS, docs

TOKENIZER = P.path("byte_bpe_50k.json")


def by_dot_products(sizes, limits):
    """The heuristic as it is written down, for whole examples: lists of places."""
    left, out = dict(enumerate(sizes)), []
    most = (limits.tokens, limits.segments, limits.loss)
    while left:
        mean = [sum(v[d] / most[d] for v in left.values()) / len(left) for d in range(3)]
        room, chosen = list(most), []
        while True:
            fit = [i for i, v in left.items() if all(v[d] <= room[d] for d in range(3))]
            if not fit:
                break
            dot = {i: sum(mean[d] * left[i][d] / most[d] * room[d] / most[d] for d in range(3)) for i in fit}
            at = max(fit, key=lambda i: dot[i])
            chosen.append((at, dot[at]))
            room = [r - v for r, v in zip(room, left.pop(at))]
        out.append(chosen)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 40)), min_size=1, max_size=25), st.integers(2, 6))
def test_whole_examples_go_where_the_dot_product_says(raw, segments):
    limits = Limits(tokens=40, segments=segments, loss=30)
    raw = [(t, min(t, l, 30)) for t, l in raw]
    examples = [(i, np.arange(t), np.arange(t) < l) for i, (t, l) in enumerate(raw)]
    found = [[p[0][0] for p in s] for s in sequences(iter(examples), limits, pool=64, cut=False)]
    expected = by_dot_products([(t, 1, l) for t, l in raw], limits)
    # Equal products may go either way by a last digit; sizes may not.
    assert [[raw[i] for i in s] for s in found] == [[raw[i] for i, _ in s] for s in expected]


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.booleans(), min_size=1, max_size=90), max_size=40),
    st.integers(1, 5), st.integers(1, 32), st.integers(2, 9), st.booleans(), st.booleans(),
)
def test_every_limit_holds_and_every_token_lies_in_one_piece(masks, segments, loss, pool, cut, plain):
    limits = Limits(tokens=32, segments=segments, loss=loss)
    examples = [(i, np.arange(len(m)), None if plain else np.array(m)) for i, m in enumerate(masks)]
    covered = {i: [] for i in range(len(masks))}
    for pieces in sequences(iter(examples), limits, pool, cut):
        bears = sum(n if e[2] is None else int(e[2][s : s + n].sum()) for e, s, n in pieces)
        size = sum(n for _, _, n in pieces)
        assert 0 < size <= 32 and len(pieces) <= segments and bears <= loss
        assert not cut or size == 32 or size & (size - 1) == 0
        for (i, ids, mask), start, n in pieces:
            covered[i] += ids[start : start + n].tolist()
            alone = len(ids) <= 32 and (len(ids) if mask is None else mask.sum()) <= loss
            assert cut or not alone or n == len(ids)
    assert all(sorted(v) == list(range(len(masks[i]))) for i, v in covered.items())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="a1 \n\t'sé日<|endoftext|>　\x1c​", max_size=80))
def test_ranks_give_the_identifiers_of_the_file(text):
    whole = _whole().encode
    text = text.encode("utf-8", "ignore").decode()
    assert encoder(TOKENIZER, "/opt/tokenizers/byte_bpe_50k.tiktoken")(text) == whole(text, add_special_tokens=False).ids
    spoof = text + "<|endoftext|>" + text
    assert encoder(TOKENIZER, "/opt/tokenizers/byte_bpe_50k.tiktoken")(spoof) == whole(spoof, add_special_tokens=False).ids


def _whole(made=[]):
    if not made:
        made.append(Tokenizer.from_file(TOKENIZER))
    return made[0]


def check(rows, expected, tokens=2048, segments=128):
    """All identifiers once, in sequences without gaps; returns the padded share."""
    pieces, places = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        pieces.setdefault(r.id, []).append((r.start, ids, r.n_tokens))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == expected.keys()
    for key, ids in expected.items():
        found = sorted(pieces[key])
        assert [s for s, _, _ in found] == np.cumsum([0, *(len(p) for _, p, _ in found[:-1])]).tolist()
        assert sum((p for _, p, _ in found), []) == ids and {n for _, _, n in found} == {len(ids)}
    padded = 0
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == np.cumsum([0, *(n for _, n in found[:-1])]).tolist()
        size = sum(n for _, n in found)
        assert size <= tokens and len(found) <= segments
        padded += 0 if size & (size - 1) == 0 else tokens - size
    return padded / sum(map(len, expected.values()))


def test_documents(spark):
    rows = pack_documents(docs(spark, ODD_TEXTS).repartition(2)).collect()
    ids = {i: [*_whole().encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(ODD_TEXTS)}
    assert check(rows, ids) == 0
    assert pack_documents(docs(spark, [])).count() == 0
    clash = docs(spark, ["a b", None]).selectExpr("nullif(doc_id, 1) AS doc_id", "text", "1 AS id", "2 AS length", "3 AS ids")
    rows = pack_documents(clash.unionByName(clash)).collect()
    assert {(r.id, r.n_tokens) for r in rows} == {(0, 3), (None, 1)}
    assert sum(r.length for r in rows if r.id is None) == 2 and sum(r.length for r in rows) == 8


def test_examples(spark):
    schema = "id long, ids array<int>, loss array<boolean>, start int"
    made = [(i, list(range(n)), [j >= n // 2 for j in range(n)], 0) for i, n in enumerate([5, 900, 1500, 2048, 3000, 17] * 20)]
    frame = spark.createDataFrame([*made, (500, None, None, 0), (501, [], [], 0)], schema).coalesce(3)
    rows = pack_examples(frame, loss_col="loss", limits=Limits(2048, 8, 1024)).collect()
    check(rows, {i: ids for i, ids, _, _ in made}, segments=8)
    assert all(r.length == r.n_tokens for r in rows if r.n_tokens <= 2048)
    with pytest.raises(ValueError):
        Limits(tokens=0)
    assert len(Pool(Limits(), 4)) == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_packing"](spark, sf_dir).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for key, text in texts.items():
        ids = np.array([*_whole().encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for r in pieces[key]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in pieces[key]) == len(ids)
