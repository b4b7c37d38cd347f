"""Representatives of clusters by an ordered list of preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def representatives(members: DataFrame, by: list[str], prefer: list[Column], columns: list[str]) -> DataFrame:
    """The preferred member of each cluster: the least by ``prefer``, whose last column must be unique.

    Numbers where more is better are given negated. This is one aggregation with partial results, so
    a cluster of any size moves a row for each task.
    """
    key = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(prefer)])
    return members.groupBy(*by).agg(F.min_by(F.struct(*columns), key).alias("_r"), F.count("*").alias("size")).select(*by, "_r.*", "size")


def listed(members: DataFrame, chosen: DataFrame, by: list[str], key: str) -> DataFrame:
    """``representative, others``: the other members' keys in order, joined by blanks.

    A cluster's members are one row here, as the list's format asks, so clusters have to fit in one; ``others`` gives them as rows.
    """
    named = chosen.select(*by, F.col(key).alias("representative"))
    rest = members.join(named, by).where(F.col(key) != F.col("representative"))
    others = F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string")), " ")
    lists = rest.groupBy(*by).agg(others.alias("others"))
    return named.join(lists, by, "left").withColumn("others", F.coalesce("others", F.lit("")))


def others(members: DataFrame, chosen: DataFrame, by: list[str], key: str) -> DataFrame:
    """``representative, key``: a row for each other member, for clusters of any size."""
    named = chosen.select(*by, F.col(key).alias("representative"))
    return members.join(named, by).where(F.col(key) != F.col("representative")).select(*by, "representative", key)


def duplicates(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """``key, kept, dropped``: the first row of each key and how many others it has."""
    return df.groupBy(*key).agg(F.min(order).alias("kept"), (F.count("*") - 1).alias("dropped"))
