"""Text outputs over the test tables, told by their lines or by digests of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helispan.operators import pairs
from helispan.plans.bindings import bind, table
from helispan.plans.coded import _CODED_SQL, coded
from helispan.plans.drawn import _SHEET, _sheet
from helispan.plans.graphs import _PAIRS_SQL, distance, edges, structures
from helispan.sinks import text

_SEGMENTS = _SHEET + ", g AS (SELECT l_orderkey, node AS seg, CASE WHEN node % 2 = 0 THEN 'strand' ELSE 'alpha' END AS kind, CASE WHEN node > 4 THEN 'B' ELSE 'A' END AS chain, node * 100 AS lo, node * 100 + hi AS hi FROM s)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as segments of two chains."""
    node = F.col("node")
    return _sheet(spark, sf_dir).select("l_orderkey", node.alias("seg"), F.when(node % 2 == 0, "strand").otherwise("alpha").alias("kind"), F.when(node > 4, "B").otherwise("A").alias("chain"), (node * 100).alias("lo"), (node * 100 + F.col("hi")).alias("hi"))


@bind("code_triangles", _CODED_SQL + """
, n AS (SELECT structure, row_number() OVER (PARTITION BY structure ORDER BY vec_id) - 1 AS seq, code FROM c),
p AS (SELECT x.structure, x.seq AS i, y.seq AS j, CASE WHEN x.seq = y.seq THEN x.code ELSE x.code[1] || y.code[2] END AS cell FROM n x JOIN n y ON x.structure = y.structure AND x.seq <= y.seq),
r AS (SELECT structure, j, string_agg(cell, ' ' ORDER BY i) AS t FROM p GROUP BY 1, 2), f AS (SELECT structure, count(*) AS n, string_agg(t, chr(10) ORDER BY j) AS body FROM r GROUP BY 1)
SELECT structure, md5(body) AS body, md5(upper(printf('%6s', 'd' || structure)) || printf(' %4d', n) || chr(10) || body) AS with_header FROM f""")  # fmt: skip
def code_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = coded(spark, sf_dir).select("structure", (F.row_number().over(Window.partitionBy("structure").orderBy("vec_id")) - 1).alias("seq"), "code")
    d = pairs.sides(n, ["structure"], "a_").join(pairs.sides(n, ["structure"], "b_"), "structure").where("a_seq <= b_seq")
    cell = F.when(F.col("a_seq") == F.col("b_seq"), F.col("a_code")).otherwise(F.concat(F.substring("a_code", 1, 1), F.substring("b_code", 2, 1)))
    texts = text.triangle_text(d, ["structure"], "a_seq", "b_seq", cell).withColumn("name", F.concat(F.lit("d"), F.col("structure").cast("string")))
    headed = text.with_header(texts, "name").select(F.trim(F.substring("line", 1, 6)).alias("name"), F.md5("line").alias("with_header"))
    return texts.withColumn("name", F.upper("name")).join(headed, "name").select("structure", F.md5("text").alias("body"), "with_header")


@bind("distance_triangles", _PAIRS_SQL + """, r AS (SELECT structure, dst, string_agg(printf('%6.3f', dist), ' ' ORDER BY src) AS t FROM d GROUP BY 1, 2)
SELECT structure, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY dst)) AS digest FROM r GROUP BY 1""")  # fmt: skip
def distance_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances without the diagonal."""
    d = pairs.triangular(structures(spark, sf_dir), ["structure"], "vec_id")
    d = d.withColumn("dist", distance(F.col("a_embedding"), F.col("b_embedding")))
    texts = text.triangle_text(d, ["structure"], "a_vec_id", "b_vec_id", text.number_cell(F.col("dist")))
    return texts.select("structure", "n", F.md5("text").alias("digest"))


@bind("graph_descriptions", _PAIRS_SQL + """SELECT structure, md5('graph {' || chr(10) || string_agg('  ' || src || ' -- ' || dst || ';', chr(10) ORDER BY '  ' || src || ' -- ' || dst || ';') || chr(10) || '}') AS digest FROM edges GROUP BY 1""")
def graph_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.dot_text(edges(spark, sf_dir), ["structure"]).select("structure", F.md5("text").alias("digest"))


@bind("edge_files", _PAIRS_SQL + "SELECT src || chr(9) || dst AS line FROM edges")
def edge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.edge_lines(edges(spark, sf_dir))


@bind("result_files", "SELECT o_orderkey || ' ' || o_custkey AS line FROM orders")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.result_lines(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


@bind("labelled_files", "SELECT printf('%20.8f  %d', o_totalprice, (o_orderkey % 2)::INT) AS line FROM orders")
def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.labelled_lines(table(spark, sf_dir, "orders").withColumn("label", F.col("o_orderkey") % 2), "o_totalprice", "label")


@bind("segment_files", _SEGMENTS + """SELECT l_orderkey, md5(count(*) || chr(10) || string_agg(CASE WHEN kind = 'strand' THEN 'E' ELSE 'H' END || ' ' || chain || ' ' || lo || ' ' || hi, chr(10) ORDER BY chain, lo, hi)) AS digest FROM g GROUP BY 1""")
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.segment_info(_segments(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", F.md5("text").alias("digest"))


@bind("viewer_scripts", _SEGMENTS + """, t AS (SELECT *, printf('%s_%d', kind, seg) AS name FROM g)
SELECT l_orderkey, md5(string_agg(printf('select %s, chain %s and resi %d-%d', name, chain, lo, hi) || chr(10) || printf('color %s, %s', CASE WHEN kind = 'strand' THEN 'yellow' ELSE 'red' END, name), chr(10) ORDER BY seg)) AS digest FROM t GROUP BY 1""")  # fmt: skip
def viewer_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.selection_script(_segments(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", F.md5("text").alias("digest"))


@bind("page_indexes", """WITH l AS (SELECT o_custkey, '<li><a href="' || o_orderkey || '">' || o_orderkey || '</a></li>' AS t FROM orders)
SELECT o_custkey, md5('<ul>' || chr(10) || string_agg(t, chr(10) ORDER BY t) || chr(10) || '</ul>') AS digest FROM l GROUP BY 1""")  # fmt: skip
def page_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("name"))
    return text.index_html(o, ["o_custkey"], "name").select("o_custkey", F.md5("text").alias("digest"))
