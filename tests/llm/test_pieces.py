import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm.pieces import MODEL, SPACE, decode_documents, encode_documents, load
from tests.llm.helpers import ODD_TEXTS, docs


@pytest.fixture(scope="module")
def model():
    return load(MODEL)


@pytest.fixture(scope="module")
def scores():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    n = library.get_piece_size()
    usual = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
    return {library.id_to_piece(i): library.get_score(i) for i in usual}


def best_score(text, scores):
    """The best score of any segmentation, by trying every piece at every place."""
    unknown = min(scores.values()) - 10.0
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            if (piece := text[start:end]) in scores:
                best[end] = max(best[end], best[start] + scores[piece])
        if text[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def score_of(ids, model, scores):
    total, i = 0.0, 0
    byte_of = {b: n for n, b in enumerate(model.byte_ids)}
    while i < len(ids):
        if ids[i] in byte_of:
            lead = byte_of[ids[i]]
            i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            total += min(scores.values()) - 10.0
        else:
            total += scores[model.pieces[ids[i]]]
            i += 1
    return total


TEXTS = st.text(alphabet="the ainsterion\n,.éß日本🎉\x00▁  ", max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_segmentation_is_the_best_one(model, scores, text):
    ids = model.encode(text).tolist()
    marked = SPACE + text.replace(" ", SPACE)
    if text:
        assert score_of(ids, model, scores) == best_score(marked, scores)
        # Words by themselves give what the whole text gives.
        assert score_of(model.viterbi(marked), model, scores) == score_of(ids, model, scores)
    assert model.decode(ids) == text.replace(SPACE, " ")


def test_never_worse_than_the_library(model, scores):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ["the station in the north", "einheit und freiheit", "Éclair, naïve; übung 123"]:
        theirs = sum(scores[p] for p in library.encode(text, out_type=str))
        assert sum(scores[model.pieces[i]] for i in model.encode(text).tolist()) >= theirs
        assert library.decode(model.encode(text).tolist()) == text


def test_cache_is_bounded(model):
    from gradus.llm.pieces import PieceModel

    small = PieceModel(MODEL, cached=3)
    text = "one two three four five six one two"
    assert small.encode(text).tolist() == model.encode(text).tolist()
    assert len(small.cache) <= 3 and len(small.cache.before) <= 3


def test_documents_come_back(spark):
    frame = docs(spark, [*ODD_TEXTS, "  two  spaces ", "\n\nlines\n"]).selectExpr("*", "1 AS pieces", "'k' AS other")
    encoded = encode_documents(frame)
    assert encoded.columns == ["doc_id", "lang", "source", "n_chars", "other", "pieces"]
    assert encoded.where("other = 'k'").count() == frame.count()
    decoded = decode_documents(encoded.selectExpr("*", "'gone' AS text"))
    expected = {r.doc_id: r.text or "" for r in frame.collect()}
    assert {r.doc_id: r.text for r in decoded.collect()} == expected
    nulls = encoded.selectExpr("doc_id", "CAST(NULL AS array<int>) AS pieces")
    assert {r.text for r in decode_documents(nulls).collect()} == {""}
    assert encode_documents(docs(spark, [])).count() == 0
