"""Connected components of an edge table by alternating large and small stars, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import join_unique, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, path: str) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours. A hub's edges are not one task's."""
    both = _mirrored(edges)
    least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), path)
    return join_unique(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them; after large stars a node has few."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame, folder: str, rounds: int = 64) -> DataFrame:
    """(u, v): each node u that is not the least of its component, with that least node v.

    edges has comparable u and v in any direction; loops and repeats are ignored. Every round is a written table,
    so a lost executor costs a round at most. A component of n nodes ends after O(log^2 n) rounds; should `rounds` ever
    not do, that is an error and no result.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/round0")
    before = _state(edges)
    for k in range(1, rounds + 1):
        if not before[0]:
            break
        edges = stored(_small_star(_large_star(edges, f"{folder}/least{k}")), f"{folder}/round{k}")
        after = _state(edges)
        if after == before:
            return edges
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges
