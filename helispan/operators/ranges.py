"""Joins of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, intervals: DataFrame, by: list[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Each point with each interval of its keys that holds it, both ends included.

    Intervals are written once for each bucket of ``width`` that they touch, so the join is one of
    equal keys and buckets and not one of inequalities. A null bound is open, which is only used for
    intervals of whole groups: those are joined on the keys alone.
    """
    rest = [c for c in intervals.columns if c not in by]
    bounded = intervals.where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = bounded.withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    held = points.withColumn("_bucket", bucket(at)).join(spread, [*by, "_bucket"]).where(F.col(at).between(F.col(lo), F.col(hi)))
    whole = points.join(intervals.where(F.col(lo).isNull() & F.col(hi).isNull()), by)
    columns = [*points.columns, *rest]
    return held.select(*columns).unionByName(whole.select(*columns))


def ends_inside(edges: DataFrame, intervals: DataFrame, by: list[str], a: str, b: str, lo: str, hi: str, name: str, width: int) -> DataFrame:
    """Edges between residues as edges between the intervals that hold both ends, without loops and repeats."""
    keyed = intervals.select(*by, lo, hi, name)
    one = containing(edges, keyed, by, a, lo, hi, width).withColumnRenamed(name, "src").drop(lo, hi)
    two = containing(one, keyed, by, b, lo, hi, width).withColumnRenamed(name, "dst")
    return two.where("src <> dst").select(*by, "src", "dst").distinct()


def overlapping(intervals: DataFrame, by: list[str], name: str, lo: str, hi: str, width: int) -> DataFrame:
    """Pairs of intervals of different names that share a place."""
    bucket = lambda c: F.floor(F.col(c) / width)
    d = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    a = d.select(*by, "_bucket", F.col(name).alias("a"), F.col(lo).alias("alo"), F.col(hi).alias("ahi"))
    b = d.select(*by, "_bucket", F.col(name).alias("b"), F.col(lo).alias("blo"), F.col(hi).alias("bhi"))
    return a.join(b, [*by, "_bucket"]).where("a < b and alo <= bhi and blo <= ahi").select(*by, "a", "b").distinct()


def next_after(intervals: DataFrame, by: list[str], group: str, lo: str, hi: str) -> DataFrame:
    """For each group of intervals, the group that begins soonest after its end (J18), and the gap.

    A gap of -2 still counts as after.
    """
    ends = intervals.groupBy(*by, group).agg(F.max(hi).alias("end"), F.min(lo).alias("start"))
    a = ends.select(*by, F.col(group).alias("src"), "end")
    b = ends.select(*by, F.col(group).alias("dst"), "start")
    d = a.join(b, by).withColumn("gap", F.col("start") - F.col("end")).where("src <> dst and gap >= -2")
    return d.groupBy(*by, "src").agg(F.min(F.struct("gap", "dst")).alias("_n")).select(*by, "src", "_n.dst", "_n.gap")
