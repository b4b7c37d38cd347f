"""Running counts in a total order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helispan.session import materialize


def running(df: DataFrame, order: list[str], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name in ``sums``, the total of its column over the rows before this one (of the same ``by``).

    The order must be total. Rows are dealt by ranges of ``by`` and the order and written; each range's
    totals, one row for each range and key in it, give the later ranges their start.
    """
    own = [f"_v{i}" for i in range(len(sums))]
    dealt = df.select("*", *[c.alias(v) for v, c in zip(own, sums.values(), strict=True)]).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_part", *by).agg(*[F.sum(v).alias(v) for v in own])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *by, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}s") for v in own])
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(starts if by else F.broadcast(starts), ["_part", *by])
    return joined.select(*df.columns, *[(F.col(f"{v}s") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(n) for v, n in zip(own, sums, strict=True)])
