"""Labels of elements on the test tables: orders as structures, their lines as elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helispan.operators import labels
from helispan.plans.bindings import bind, table


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # line numbers repeat
    columns = "l_orderkey", "l_linenumber", "l_linestatus", place.alias("place"), (F.col("l_returnflag") == "N").alias("strand"), (F.col("l_discount") > 0.08).alias("barrel")
    return table(spark, sf_dir, "lineitem").select(*columns)


@bind("type_strings", "SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'N' THEN 'E' ELSE 'H' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS types FROM lineitem GROUP BY 1")
def type_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.type_strings(_elements(spark, sf_dir), ["l_orderkey"], "place", F.when(F.col("strand"), "E").otherwise("H"))


@bind("sequential_labels", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) || CASE WHEN l_discount > 0.08 THEN '*' ELSE '' END AS label FROM lineitem""")  # fmt: skip
def sequential_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.sequential_labels(_elements(spark, sf_dir), ["l_orderkey"], "place", F.col("barrel")).select("l_orderkey", "l_linenumber", "label")


@bind("separate_labels", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_returnflag = 'N' THEN n || CASE WHEN l_discount > 0.08 THEN '*' ELSE '' END ELSE chr((64 + n)::INT) END || CASE WHEN lo <> hi THEN lower(l_linestatus) ELSE '' END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'N' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
             min(l_linestatus) OVER (PARTITION BY l_orderkey) AS lo, max(l_linestatus) OVER (PARTITION BY l_orderkey) AS hi FROM lineitem)""")  # fmt: skip
def separate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.separate_labels(_elements(spark, sf_dir), ["l_orderkey"], "place", F.col("strand"), F.col("barrel"), "l_linestatus")
    return d.select("l_orderkey", "l_linenumber", "label")
