"""Labels of the elements of a structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def type_strings(elements: DataFrame, by: list[str], order: str, letter: Column) -> DataFrame:
    """``by, types``: one letter for each element of a structure, in order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), letter.alias("l"))))
    return elements.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["l"]), "").alias("types"))


def sequential_labels(elements: DataFrame, by: list[str], order: str, barrel: Column) -> DataFrame:
    """Adds ``label``: places from 1 in order, ``*`` after those of barrel edges."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return elements.withColumn("label", F.concat(n.cast("string"), F.when(barrel, "*").otherwise("")))


def separate_labels(elements: DataFrame, by: list[str], order: str, strand: Column, barrel: Column, chain: str) -> DataFrame:
    """Adds ``label``: strands are 1, 2, ... and helices A, B, ....

    Barrel edges have ``*``; elements of structures of several chains have their chain in lower case.
    Letters after Z are the characters that follow it.
    """
    d = elements.withColumn("_strand", F.coalesce(strand, F.lit(False)))
    n = F.row_number().over(Window.partitionBy(*by, "_strand").orderBy(order))
    whole = Window.partitionBy(*by)
    several = F.min(chain).over(whole) != F.max(chain).over(whole)
    d = d.withColumn("_n", n).withColumn("_chain", F.when(several, F.lower(F.coalesce(chain, F.lit("")))).otherwise(""))
    own = F.when(F.col("_strand"), F.concat(F.col("_n").cast("string"), F.when(barrel, "*").otherwise(""))).otherwise(F.char(F.col("_n") + F.lit(64)))
    return d.withColumn("label", F.concat(own, "_chain")).drop("_strand", "_n", "_chain")
