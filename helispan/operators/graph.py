"""Components of graphs that do not fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helispan.session import finished, materialize


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table; the label is the least node.

    Alternates large-star and small-star steps until the edges are stars around the least node of
    their component; rounds grow with the logarithm of the longest path. Each round is cut by a
    written table, so a lost executor never replays earlier rounds; they are deleted when the labels
    are written. Null ends are ignored, and a self-loop makes an isolated node.
    """
    return finished(edges.sparkSession, lambda: _labels(edges, src, dst, max_rounds), "components")


def _labels(edges: DataFrame, src: str, dst: str, max_rounds: int) -> DataFrame:
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = materialize(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = pairs.where("u = v").select(F.col("u").alias("node"))
    e = pairs.where("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_mins(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        small = (
            large.join(_mins(large), "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        e = materialize(small, "edges")
        state = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = roots.unionByName(nodes).distinct().join(stars, "node", "left_anti")
    return stars.unionByName(alone.select("node", F.col("node").alias("component")))
