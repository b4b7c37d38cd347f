"""Sheets, ends and overlaps on the test tables: customers as chains, orders as strands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helispan.operators import sheets
from helispan.plans.bindings import bind, table


def _strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", lo.alias("lo"), (lo + F.length("o_orderpriority")).alias("hi"), "o_orderkey")


_SQL = "WITH s AS (SELECT o_custkey, o_orderpriority, o_orderkey AS lo, o_orderkey + length(o_orderpriority) AS hi, o_orderkey FROM orders), z AS (SELECT o_custkey, o_orderpriority, sum(hi - lo + 1)::BIGINT AS size, count(*) AS strands FROM s GROUP BY 1, 2)"


@bind("sheet_sizes", _SQL + "SELECT * FROM z")
def sheet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.sheet_sizes(_strands(spark, sf_dir), ["o_custkey"], "o_orderpriority", "lo", "hi")


@bind("largest_sheet", _SQL + "SELECT o_custkey, o_orderpriority, size FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY size DESC, o_orderpriority) AS k FROM z) WHERE k = 1")
def largest_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.largest(sheet_sizes(spark, sf_dir), ["o_custkey"], "o_orderpriority", "size")


@bind("chain_ends", "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey + length(o_orderpriority)) AS last FROM orders GROUP BY 1")
def chain_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.chain_ends(_strands(spark, sf_dir), ["o_custkey"], "lo", "hi")


@bind("outermost_segments", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS nterm, arg_max(event_id, (ts, event_id)) AS cterm FROM events WHERE event_type <> 'error' GROUP BY 1")
def outermost_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return sheets.outermost(e, ["user_id"], "at", "event_id", F.col("event_type") != "error")


@bind("sequence_parts", """
SELECT o_orderkey, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM (
  SELECT *, (lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS DISTINCT FROM o_orderpriority)::INT AS new FROM orders)""")  # fmt: skip
def sequence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.neighbours_in_sequence(_strands(spark, sf_dir), ["o_custkey"], "o_orderkey", "o_orderpriority").select("o_orderkey", "part")


@bind("axis_overlaps", """
SELECT l_suppkey, l_partkey, l_quantity FROM (
  SELECT *, max(l_partkey + l_quantity + 1) OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT DISTINCT l_suppkey, l_partkey, l_quantity FROM lineitem)) WHERE reach > l_partkey""")  # fmt: skip
def axis_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").distinct()  # noqa: E741
    return sheets.axis_overlaps(l, ["l_suppkey"], "l_partkey", "l_quantity")


@bind("extreme_bonds", """
SELECT l_suppkey, l_returnflag, min((l_partkey, l_orderkey))[1] AS low, max((l_partkey, l_orderkey))[1] AS high FROM lineitem GROUP BY 1, 2""")  # fmt: skip
def extreme_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sheets.extreme_bonds(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_partkey", "l_orderkey")
    return d.select("l_suppkey", "l_returnflag", F.col("low.l_partkey").alias("low"), F.col("high.l_partkey").alias("high"))


@bind("opposite_sides", """
SELECT label, round(avg(abs(atan2(embedding[1]::DOUBLE, embedding[2]::DOUBLE))), 9) AS angle, avg(abs(atan2(embedding[1]::DOUBLE, embedding[2]::DOUBLE))) > pi() / 2 AS opposite FROM embeddings GROUP BY 1""")  # fmt: skip
def opposite_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.atan2(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("a"))
    return sheets.opposite_sides(e, ["label"], "a").withColumn("angle", F.round("angle", 9))
