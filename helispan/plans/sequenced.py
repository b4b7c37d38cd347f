"""Runs, gaps, fills, smoothing and containment on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helispan.operators import evaluate, ranges, runs
from helispan.plans.bindings import bind, table

_RUNS_SQL = """
WITH a AS (SELECT *, (lag(event_type) OVER w IS DISTINCT FROM event_type)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
runs AS (SELECT user_id, run::BIGINT AS run, event_type, min(ts) AS first, max(ts) AS last, count(*) AS length FROM b GROUP BY 1, 2, 3)
"""


@bind("sse_runs", _RUNS_SQL + "SELECT * FROM runs")
def sse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


_SEGMENTS_SQL = """
WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
b AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM a),
segs AS (SELECT l_suppkey, min(l_partkey) AS lo, max(l_partkey) AS hi, count(*) AS n FROM b GROUP BY l_suppkey, g)
"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.segments(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")


@bind("segments_from_nodes", _SEGMENTS_SQL + "SELECT * FROM segs")
def segments_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@bind("run_gap_loops", _SEGMENTS_SQL + """
SELECT l_suppkey, gap_lo, gap_hi FROM (SELECT l_suppkey, hi + 1 AS gap_lo, lead(lo) OVER (PARTITION BY l_suppkey ORDER BY lo) - 1 AS gap_hi FROM segs) WHERE gap_lo <= gap_hi""")  # fmt: skip
def run_gap_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gaps(_segments(spark, sf_dir), ["l_suppkey"], "lo", "hi")


@bind("sequence_edges", """
SELECT * FROM (SELECT user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_id AS dst FROM events) WHERE src IS NOT NULL""")  # fmt: skip
def sequence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.adjacent(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id")


@bind("fill_down_header", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations""")  # fmt: skip
def fill_down_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", evaluate.last_value_before(c, ["conv_id"], ["turn"], F.col("role") == "user", F.col("turn")).alias("user_turn"))


@bind("enclosing_group", """
SELECT event_id, CASE WHEN g IS NULL AND b = a THEN b END AS inside FROM (
  SELECT event_id, g, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
         first_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a
  FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS g FROM events))""")  # fmt: skip
def enclosing_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("g", F.when(F.col("event_type").isin("view", "click"), F.col("event_type")))
    return e.select("event_id", runs.enclosing(e, ["user_id"], ["ts", "event_id"], "g").alias("inside"))


_DAYS_SQL = """
WITH d AS (SELECT l_returnflag, l_shipdate::DATE AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_returnflag) AS n, avg(v) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)),
s AS (SELECT l_returnflag, day, v, round(CASE WHEN k > 3 AND k <= n - 3 THEN m ELSE v END, 9) AS smooth FROM n),
t AS (SELECT l_returnflag, day, v, smooth, lag(smooth) OVER w AS a, lead(smooth) OVER w AS b FROM s WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)),
top AS (SELECT l_returnflag, day, v, smooth FROM t WHERE smooth > a AND smooth > b)
"""


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))
    return runs.smoothed(days, ["l_returnflag"], "day", "v").withColumn("smooth", F.round("smooth", 9))


@bind("smooth_local_max", _DAYS_SQL + "SELECT * FROM top")
def smooth_local_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.local_maxima(_smooth(spark, sf_dir), ["l_returnflag"], "day", "smooth")


@bind("best_local_max", _DAYS_SQL + """
SELECT l_returnflag, day, v, smooth FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY smooth DESC, day) AS k FROM top WHERE smooth > 0) WHERE k = 1""")  # fmt: skip
def best_local_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = runs.local_maxima(_smooth(spark, sf_dir), ["l_returnflag"], "day", "smooth").withColumn("at", F.datediff("day", F.lit("1970-01-01")))
    return runs.best(tops, ["l_returnflag"], "at", "smooth").drop("at")


@bind("interval_containment", """
WITH w AS (SELECT o_orderstatus, min(o_orderkey) AS name, min(day) AS lo, max(day) AS hi
           FROM (SELECT o_orderstatus, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders WHERE o_orderpriority LIKE '1%')
           GROUP BY o_orderstatus, floor(day / 45)),
p AS (SELECT o_orderstatus, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders)
SELECT p.o_orderkey, w.name FROM p JOIN w ON p.o_orderstatus = w.o_orderstatus AND p.day BETWEEN w.lo AND w.hi""")  # fmt: skip
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority", F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).alias("day"))
    spans = o.where("o_orderpriority like '1%'").groupBy("o_orderstatus", F.floor(F.col("day") / 45)).agg(F.min("o_orderkey").alias("name"), F.min("day").alias("lo"), F.max("day").alias("hi"))
    spans = spans.select("o_orderstatus", "name", "lo", "hi")
    return ranges.containing(o.drop("o_orderpriority"), spans, ["o_orderstatus"], "day", "lo", "hi", 45).select("o_orderkey", "name")


@bind("next_group_after", """
WITH e AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS start, min(c_custkey) + 5 AS stop FROM customer GROUP BY 1, 2),
p AS (SELECT a.c_nationkey, a.c_mktsegment AS src, b.c_mktsegment AS dst, b.start - a.stop AS gap FROM e a JOIN e b USING (c_nationkey) WHERE a.c_mktsegment <> b.c_mktsegment AND b.start - a.stop >= -2)
SELECT c_nationkey, src, dst, gap FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, src ORDER BY gap, dst) AS k FROM p) WHERE k = 1""")  # fmt: skip
def next_group_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("lo")).withColumn("hi", F.col("lo") + 5)
    return ranges.next_after(c, ["c_nationkey"], "c_mktsegment", "lo", "hi")


@bind("overlap_repair", """
WITH RECURSIVE s AS (SELECT DISTINCT l_suppkey, l_partkey AS lo, l_partkey + l_quantity::BIGINT AS hi FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY lo, hi) AS i, count(*) OVER (PARTITION BY l_suppkey) AS c FROM s),
r AS (SELECT l_suppkey, i, c, NULL::BIGINT AS old_lo, NULL::BIGINT AS old_hi, lo, hi FROM n WHERE i = 1
  UNION ALL SELECT n.l_suppkey, n.i, n.c, r.lo, CASE WHEN r.hi >= n.lo AND n.hi - n.lo <= r.hi - r.lo THEN n.lo - 1 ELSE r.hi END,
    CASE WHEN r.hi >= n.lo AND n.hi - n.lo > r.hi - r.lo THEN r.hi + 1 ELSE n.lo END, n.hi FROM r JOIN n ON n.l_suppkey = r.l_suppkey AND n.i = r.i + 1)
SELECT l_suppkey, old_lo AS lo, old_hi AS hi FROM r WHERE i > 1 UNION ALL SELECT l_suppkey, lo, hi FROM r WHERE i = c""")  # fmt: skip
def overlap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi"))
    return runs.repaired_overlaps(o.distinct(), ["l_suppkey"], "lo", "hi")
