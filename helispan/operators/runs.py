"""Runs, gaps and smoothing along ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], order: list[str], code: str) -> DataFrame:
    """Maximal runs of one code: by, run, code, first, last (of the first order column), length."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.lag(code).over(w).eqNullSafe(F.col(code)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = df.withColumn("_new", starts)
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "run", code).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))


def segments(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Intervals of consecutive integers: by, lo, hi, n (W8); repeated integers count once, and nulls are one interval.

    Rows are sorted once and none are kept beside them: an interval begins and ends where the integers before and after
    leave a gap, and its length follows from its ends.
    """
    w = Window.partitionBy(*by).orderBy(number)
    x, before, after = F.col(number), F.lag(number).over(w), F.lead(number).over(w)
    d = df.select(*by, number, ((F.row_number().over(w) == 1) | ~x.eqNullSafe(before)).alias("_new")).where("_new")
    # Of distinct integers; a null comes before all and is apart from them.
    first, last = F.coalesce(x - before > 1, F.lit(True)), F.coalesce(after - x > 1, F.lit(True))
    d = d.select(*by, number, first.alias("_first"), last.alias("_last")).where("_first or _last")
    d = d.select(*by, x.alias("lo"), F.when(F.col("_last"), x).otherwise(after).alias("hi"), "_first").where("_first")
    return d.select(*by, "lo", "hi", F.coalesce((F.col("hi") - F.col("lo")).cast("long") + 1, F.lit(1)).alias("n"))


def gaps(intervals: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """What lies between each interval and the next, where there is anything."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    d = intervals.select(*by, (F.col(hi) + 1).alias("gap_lo"), (F.lead(lo).over(w) - 1).alias("gap_hi"))
    return d.where("gap_lo <= gap_hi")


def adjacent(df: DataFrame, by: list[str], order: list[str], node: str) -> DataFrame:
    """Edges of rows that follow each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select(*by, F.lag(node).over(w).alias("src"), F.col(node).alias("dst")).where("src is not null")


def smoothed(df: DataFrame, by: list[str], order: str, value: str, half: int = 3) -> DataFrame:
    """Adds ``smooth``: a centred mean of 2 half + 1 rows, or the value itself near the ends."""
    w = Window.partitionBy(*by).orderBy(order)
    rank, count = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    mean = F.avg(value).over(w.rowsBetween(-half, half))
    return df.withColumn("smooth", F.when((rank > half) & (rank <= count - half), mean).otherwise(F.col(value).cast("double")))


def local_maxima(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows strictly above both neighbours."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    return d.where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def best(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The row of the highest value above 0, the first of equals."""
    d = df.where(F.col(value) > 0)
    top = F.max_by(F.struct(*df.columns), F.struct(F.col(value), -F.col(order).cast("long")))
    return d.groupBy(*by).agg(top.alias("_top")).select("_top.*")


def repaired_overlaps(segments_: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Segments in order with overlaps trimmed one after the other.

    Of two that overlap the longer gives up the residues, the earlier one if they are equal; each
    step sees the trims before it. No trim crosses a place that no segment spans, so a group is divided
    there first, and each island of overlapping segments, however many a group has, is folded alone.
    """
    w = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = segments_.withColumn("_new", F.when(F.col(lo) <= reach, 0).otherwise(1))
    island = island.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.sort_array(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"))))
    of = "array<struct<lo:bigint,hi:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        over = last["hi"] - x["lo"] + 1
        longer = (x["hi"] - x["lo"]) > (last["hi"] - last["lo"])
        trimmed = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), (last["hi"] - over).alias("hi"))))
        moved = F.struct((x["lo"] + over).alias("lo"), x["hi"].alias("hi"))
        return (
            F.when((F.size(acc) == 0), F.concat(acc, F.array(x)))
            .when(over <= 0, F.concat(acc, F.array(x)))
            .when(longer, F.concat(acc, F.array(moved)))
            .otherwise(F.concat(trimmed, F.array(x)))
        )

    sorted_ = island.groupBy(*by, "_island").agg(rows.cast(of).alias("_s"))
    empty = F.array().cast(of)
    return sorted_.select(*by, F.inline(F.aggregate("_s", empty, step)))


def enclosing(df: DataFrame, by: list[str], order: list[str], group: str) -> Column:
    """The group of the nearest grouped rows on both sides, if it is the same one."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(group, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(group, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.when(F.col(group).isNull() & (before == after), before)
