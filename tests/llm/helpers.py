"""What the tests of this folder share."""

from __future__ import annotations


class Forest:
    """Classes of ids joined by links, each named by its smallest id."""

    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD_TEXTS = [None, "", " \n\t", LONG, LONG, "a b c d e", "A B C D E", "é ü\x00 日本 🎉", "x" * 50_000]
