"""Approximate nearest neighbours by a permutation index.

A vector is represented by the pivots nearest to it, in order.  The rows are dealt
out over shards; in each shard, every pivot has a posting list of the rows that have
it among their nearest, with its place in their order.  A query walks the lists of
its own nearest pivots, adds up the differences of the places (the footrule; a pivot
a row does not list counts as the place after its last), and the rows of least
footrule are ranked again by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.vectors import norms, takes_part
from gradus.storage import materialise

_INDEX = "shard int, dim int, id long, vector binary, nearest binary"
_FOUND = "query_id long, vec_id long, score double"


def choose_pivots(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """Unit vectors of at most ``n`` distinct rows, those of smallest hash."""
    sample = (
        vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "vector").limit(4 * n).select("vector").collect()
    )
    if not sample:
        return np.empty((0, 0))
    chosen = np.array([r.vector for r in sample], dtype=np.float64)
    unit = chosen / norms(chosen)[:, None]
    _, first = np.unique(unit, axis=0, return_index=True)
    return unit[np.sort(first)[:n]]


def build_index(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = 256,
    prefix: int = 128,
    shard_rows: int = 8192,
    seed: int = 11,
) -> tuple[DataFrame, int]:
    """(index table, number of shards); every row that takes part is indexed.

    Vectors that are null, empty, zero or hold null or non-finite components take no
    part.  Each length has pivots and shards of its own.  The pivots are a sample of
    ``pivots`` rows of a length, whatever the input.
    """
    rows = materialise(
        vectors.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(vector_col).cast("array<double>").alias("vector"),
        ).where(F.col("id").isNotNull() & takes_part(F.col("vector"))),
        "indexed",
    )
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], _INDEX), 0
    chosen, places, shards = {}, [], 0
    for dim, count in lengths:
        chosen[dim] = choose_pivots(rows.where(F.size("vector") == dim), pivots, seed)
        own = -(-count // shard_rows)
        places.append((dim, shards, own))
        shards += own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, alike in batch.groupby("dim"):
                for at in range(0, len(alike), 2048):
                    part = alike.iloc[at : at + 2048]
                    own = np.array(part["vector"].tolist(), dtype=np.float64)
                    near = own @ chosen[dim].T / norms(own)[:, None]
                    listed = min(prefix, len(chosen[dim]))
                    order = np.argsort(-near, axis=1, kind="stable")[:, :listed].astype(np.uint16)
                    yield pd.DataFrame(
                        {
                            "shard": part["shard"].to_numpy(),
                            "dim": part["dim"].to_numpy(),
                            "id": part["id"].to_numpy(),
                            "vector": [v.tobytes() for v in own],
                            "nearest": [o.tobytes() for o in order],
                        }
                    )

    table = vectors.sparkSession.createDataFrame(places, "dim int, first int, own int")
    dealt = (
        rows.withColumn("dim", F.size("vector"))
        .join(F.broadcast(table), "dim")
        .withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("own"))).cast("int"))
    )
    return materialise(dealt.select("shard", "dim", "id", "vector").mapInPandas(run, _INDEX), "index"), shards


class Shard:
    """Posting lists of the rows of one shard."""

    def __init__(self, parts: list[pd.DataFrame]) -> None:
        rows = pd.concat(parts).sort_values("id", kind="stable")
        self.ids = rows["id"].to_numpy()
        self.vectors = np.frombuffer(b"".join(rows["vector"]), dtype=np.float64).reshape(len(rows), -1)
        self.lengths = norms(self.vectors)
        nearest = np.frombuffer(b"".join(rows["nearest"]), dtype=np.uint16).reshape(len(rows), -1)
        self.listed = nearest.shape[1]
        pivot, place = nearest.ravel(), np.tile(np.arange(self.listed, dtype=np.int32), len(rows))
        row = np.repeat(np.arange(len(rows), dtype=np.int32), self.listed)
        order = np.argsort(pivot, kind="stable")
        self.row, self.place = row[order], place[order]
        self.starts = np.searchsorted(pivot[order], np.arange(int(nearest.max()) + 2))

    def search(
        self, own_id: int, vector: np.ndarray, nearest: np.ndarray, walked: int, rerank: int, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        # Absent everywhere: the place after the last, for each walked list.
        walked = min(walked, len(nearest))
        footrule = np.full(len(self.ids), sum(abs(self.listed - i) for i in range(walked)), dtype=np.int32)
        for i, pivot in enumerate(nearest[:walked].tolist()):
            if pivot + 1 < len(self.starts):
                at, to = self.starts[pivot], self.starts[pivot + 1]
                footrule[self.row[at:to]] += np.abs(self.place[at:to] - i) - abs(self.listed - i)
        # Rows stand in the order of their ids, so ties go to the smaller id.
        best = np.argsort(footrule.astype(np.uint16 if self.listed * walked < 65536 else np.int32), kind="stable")
        best = best[: rerank + 1]
        best = best[self.ids[best] != own_id][: max(rerank, k)]
        length = norms(vector[None, :])[0]
        score = (self.vectors[best] * vector).sum(axis=1) / (self.lengths[best] * length)
        top = np.lexsort((self.ids[best], -score))[:k]
        return self.ids[best][top], score[top]


def search(
    index: DataFrame,
    shards: int,
    queries: DataFrame,
    k: int = 5,
    walked: int = 32,
    rerank: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query row.

    ``queries`` are rows of the index; they are compared with the rows of their length.  A row is never its own neighbour, nor is a row
    of the same id.  Every shard ranks ``rerank`` of its rows exactly, rows that share
    no pivot with the query last, so a query has all rows if there are fewer than
    ``k``.  Ties go to the smaller id.  Queries stream past each shard, whose rows are
    the only ones held.
    """
    targets = index.withColumn("side", F.lit(0))
    # Rows of one id ask once.
    asked = queries.groupBy("id").agg(F.min(F.struct("vector", "nearest", "dim")).alias("v"))
    asked = asked.select("id", "v.vector", "v.nearest", "v.dim", F.lit(1).alias("side"))
    own = index.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    asked = asked.join(own, "dim").withColumn("shard", F.explode("shards")).drop("shards")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, shard = None, [], None
        for batch in batches:
            for (number, side), part in batch.groupby(["shard", "side"], sort=True):
                if number != current:
                    current, held, shard = number, [], None
                if side == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                shard = shard or Shard(held)
                found = []
                for own_id, vector, nearest in zip(part["id"], part["vector"], part["nearest"]):
                    ids, scores = shard.search(
                        own_id, np.frombuffer(vector, np.float64), np.frombuffer(nearest, np.uint16), walked, rerank, k
                    )
                    found.append(pd.DataFrame({"query_id": own_id, "vec_id": ids, "score": scores}))
                yield pd.concat(found)

    both = targets.unionByName(asked.select(targets.columns))
    found = (
        both.repartition("shard")
        .sortWithinPartitions("shard", "side")
        .mapInPandas(run, _FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
