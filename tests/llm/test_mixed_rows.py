"""The mixing query moves whole documents."""

from gradus.llm import queries


def test_texts_are_mixed_too(spark, sf_dir, monkeypatch):
    written = {}
    real = queries.materialise
    monkeypatch.setattr(queries, "materialise", lambda df, label: written.setdefault(label, real(df, label)))
    result = queries.op10_mixing(spark, sf_dir)
    docs = {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}
    mixed = written["mixed"].collect()
    assert len(mixed) == result.count() > 0
    assert all(r[c] == docs[r.doc_id][c] for r in mixed for c in ("text", "lang", "source", "n_chars"))
