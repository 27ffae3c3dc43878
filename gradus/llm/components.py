"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.storage import materialise

MAX_ROUNDS = 60


def _hang(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(
        F.col("a").alias("_n"), F.least("a", "_m").alias("_m")
    )
    joined = both.join(materialise(least, "least"), F.col("a") == F.col("_n")).where("b > a")
    return _pairs(joined, F.col("b"), F.col("_m"))


def _gather(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the smallest one."""
    least = materialise(
        edges.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_n"), "least"
    )
    joined = edges.join(least, F.col("a") == F.col("_n"))
    return _pairs(joined, F.col("b"), F.col("_m")).union(
        least.select(F.col("_n").alias("a"), F.col("_m").alias("b"))
    ).distinct()


def _pairs(df: DataFrame, left: Column, right: Column) -> DataFrame:
    return (
        df.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where("a <> b")
        .distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(
        edges.select(F.col("b"), F.lit(0), F.lit(1))
    )
    bad = (
        ends.groupBy("n")
        .agg(F.sum("low").alias("low"), F.max("top").alias("top"))
        .where("low > 1 OR (low = 1 AND top = 1)")
    )
    return bad.limit(1).count() == 0


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link.

    Links may be repeated, in either direction, or join a node with itself; links
    with a null end say nothing.  An empty table gives an empty result.  Each round
    is written to the shared folder, so a lost executor costs one round at most;
    only the smallest neighbour of a node is aggregated, and those are written before
    they are joined, so that the edges of a hub can be split over tasks.
    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = materialise(_pairs(links, F.col(left), F.col(right)), "links")
    for _ in range(MAX_ROUNDS):
        if _is_star_forest(edges):
            break
        edges = materialise(_gather(materialise(_hang(edges), "links")), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct()
    )
