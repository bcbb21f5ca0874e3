"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import settle


def _settled(edges: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, with their number and the exclusive or of their hashes, taken while they are written."""
    seen = Observation()
    edges = edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h"))
    return settle(edges, name), (seen.get["n"], seen.get["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .where("a <> b")
        .distinct()
    )


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges of any orderable type -> (node, root) with the least node of each component as its root.

    Nodes without an edge don't appear. Self loops and repeated edges are allowed. Every round is a pair of joins and
    aggregations whose result is settled as a table; the number of rounds grows with the logarithm of the longest
    path. Only two numbers a round (edge count and hash sum) reach the driver. Null ends are dropped. An empty edge
    table gives an empty result.
    """
    now, mark = _settled(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), name)
    while mark[0]:
        before = mark
        now, mark = _settled(_small_star(_large_star(now)), name)
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
