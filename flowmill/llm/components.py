"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut, join_split


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    return join_split(both.where("b > a"), low, "a", "n", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """n: at least the number of edges."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_split(down, low, "a", "n", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. Returns (node, root) for every node that has an edge to another one; root is the smallest
    node that links reach. Self-edges and repeated edges do not matter; null ends are dropped; no edges give no rows.

    Each round joins edges with the minimum of a node's neighbours, so a node with very many neighbours is only summed
    up before the shuffle, and its edges are joined where they lie, never gathered (join_split). The edges of each star are written to the shared folder."""
    a, b = edges.columns[:2]
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = cut(_small_star(cut(_large_star(now, state[0]), "edges"), state[0]), "edges")
        state, last = _state(now), state
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
