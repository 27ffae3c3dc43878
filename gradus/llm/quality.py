"""Quality of documents by a regularised quadratic discriminant.

A document is described by a few transformed statistics of its whole text.  Each
class has a mean and a covariance, shrunk towards the pooled covariance and towards a
sphere; the score is the logistic function of the difference of the log densities
plus the log odds of the classes.  Means and covariances come from sums over all
labelled rows, so nothing is sampled; the Cholesky factors are computed once.  The sums are
whole numbers and a row is scored by itself, so models and scores have the same bits on
any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.storage import materialise

STATISTICS = (
    "log mean word length",
    "root share of upper case",
    "root share of symbols",
    "root share of digits",
    "root share of words like the one before",
    "root share of repeated words",
    "root share of repeated lines",
    "entropy of the bytes",
    "root share of words that end in a symbol",
)
#: Bytes that prose is made of, beside letters and digits: space, tab, line ends, ' , - .
_PLAIN = [9, 10, 13, 32, 39, 44, 45, 46]
_WORD_ENDS = frozenset(".,;:?!'\")-")
#: Statistics are learnt in whole multiples of 1 / UNIT; they are below 32, so a product has 62 bits at most.
UNIT = 2**26


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text; a null text is an empty one."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = text.split()
    k = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    upper, lower, wide = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[128:].sum())
    digits = int(seen[48:58].sum())
    symbols = len(data) - upper - lower - wide - digits - int(seen[_PLAIN].sum())
    share = seen[seen > 0] / n
    odd = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in _WORD_ENDS))
    return [
        math.log(max(1.0, (len(data) - len(words)) / k)),
        math.sqrt(upper / max(1.0, upper + lower + wide / 2)),
        math.sqrt(symbols / n),
        math.sqrt(digits / n),
        math.sqrt(sum(map(eq, words, words[1:])) / k),
        math.sqrt(1 - len(set(words)) / k) if words else 0.0,
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        float(-(share * np.log2(share)).sum()) if len(data) else 0.0,
        math.sqrt(odd / k),
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts], dtype="object")

    return of(text)


def _forward(factor: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Solve ``factor @ x = columns`` for a lower triangular factor.

    Component by component over all columns, so that a column's result does not depend on
    those beside it, as it may in a matrix product.
    """
    solved = np.empty_like(columns)
    for i, row in enumerate(factor):
        left = columns[i].copy()
        for j in range(i):
            left -= row[j] * solved[j]
        solved[i] = left / row[i]
    return solved


@dataclass(frozen=True)
class Discriminant:
    """A fitted model: per class the mean, the Cholesky factor and the log of its share."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float] | None, ...]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Log of the odds of class 1; certain when only one class was seen, even when none."""
        scaled = (rows - self.centre) / self.scale
        low, high = self.classes
        if low is None or high is None:
            sure = 0.0 if low is high else np.inf if low is None else -np.inf
            return np.full(len(rows), sure)
        density = []
        for mean, factor, prior in (low, high):
            apart = _forward(factor, (scaled - mean).T)
            density.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (apart**2).sum(axis=0))
        return density[1] - density[0]

    def score(self, rows: np.ndarray) -> np.ndarray:
        odds = self.log_odds(rows)
        less = np.exp(-np.abs(odds))
        return np.where(odds >= 0, 1.0, less) / (1 + less)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows kept out of training: a hash of the id as text, fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _total(value: Column) -> Column:
    """Sum of whole numbers below 2^63, of up to 10^10 rows."""
    return F.sum(value.cast("decimal(19,0)"))


def fit(labelled: DataFrame, pooled: float = 0.02, sphere: float = 0.02) -> Discriminant:
    """Fit on (``features``, ``quality``); rows whose label is neither 0 nor 1 say nothing.

    ``pooled`` and ``sphere`` are the shares of the pooled covariance and of the
    sphere of equal variance in each class covariance.  One aggregation of whole numbers,
    exact in any order; two rows come back.
    """
    p = len(STATISTICS)
    x = [F.rint(F.col("features")[i] * UNIT).cast("bigint") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = (
        labelled.where("quality IN (0, 1)")
        .groupBy("quality")
        .agg(
            F.count("*").alias("n"),
            F.array(*[_total(v) for v in x]).alias("sums"),
            F.array(*[_total(x[i] * x[j]) for i, j in pairs]).alias("products"),
        )
        .collect()
    )
    moments = {}
    for row in sums:
        square = np.zeros((p, p))
        for (i, j), value in zip(pairs, row.products):
            square[i, j] = square[j, i] = int(value) / UNIT**2
        moments[row.quality] = (row.n, np.array([int(v) / UNIT for v in row.sums]), square)
    if not moments:
        return Discriminant(np.zeros(p), np.ones(p), (None, None))
    # In the order of the labels, not of arrival.
    moments = dict(sorted(moments.items()))
    total = sum(n for n, _, _ in moments.values())
    centre = sum(s for _, s, _ in moments.values()) / total
    spread = sum(q for _, _, q in moments.values()) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    whole = spread / np.outer(scale, scale)
    classes: list = [None, None]
    for label, (n, s, q) in moments.items():
        mean = s / n
        own = (q / n - np.outer(mean, mean)) / np.outer(scale, scale)
        own = (1 - pooled) * own + pooled * whole
        level = max(np.trace(own) / p, 1e-6)
        own = (1 - sphere) * own + sphere * level * np.eye(p) + 1e-9 * np.eye(p)
        factor = np.linalg.cholesky((own + own.T) / 2)
        classes[label] = ((mean - centre) / scale, factor, math.log(n / total))
    return Discriminant(centre, scale, tuple(classes))


def score_column(model: Discriminant, features: Column) -> Column:
    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array(rows.tolist(), dtype=np.float64)))

    return of(features)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5
) -> tuple[Discriminant, DataFrame]:
    """The model, and the table (id, features) of all documents, written once.

    Learns from the labelled rows that are not held out.  A document without a label
    and a label without a document say nothing; a null label or id neither.
    """
    table = materialise(
        docs.select(F.col(id_col).alias("id"), statistics_column(F.col(text_col)).alias("features")),
        "features",
    )
    known = labels.select(F.col(id_col).alias("labelled"), "quality").where(
        ~held_out(F.col("labelled"), folds)
    )
    return fit(table.join(known, F.col("id") == F.col("labelled"))), table


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    folds: int = 5,
) -> DataFrame:
    """(id, held_out, score, predicted) for every document; empty and null texts too.

    Nothing but the text is an input of the score.  Repeated rows are scored one by
    one.  An empty table gives an empty result; without labels all scores are 0.5.
    """
    model, table = train(docs, labels, id_col, text_col, folds)
    return table.withColumn("score", score_column(model, F.col("features"))).select(
        F.col("id").alias(id_col),
        held_out(F.col("id"), folds).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    folds: int = 5,
) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged.

    The statistics are computed anew while filtering: that costs less than a join
    which would shuffle the texts.
    """
    model, _ = train(docs, labels, id_col, text_col, folds)
    return docs.where(score_column(model, statistics_column(F.col(text_col))) >= threshold)
