"""Neighbours, components and divisions of graphs on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helispan.operators import clusters, community, domains, pairs
from helispan.operators.graph import connected_components
from helispan.plans.bindings import bind, table
from helispan.session import materialize

#: A structure is sixteen vectors in a row; structures stay as small however many there are.
SIZE = 16
LIMIT = 1.3
_PAIRS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, vec_id // 16 AS structure, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d AS (SELECT a.structure, a.vec_id AS src, b.vec_id AS dst, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2))), 9) AS dist FROM v a JOIN v b ON a.structure = b.structure AND a.vec_id < b.vec_id),
edges AS (SELECT * FROM d WHERE dist < 1.3)
"""
_COMPONENTS_SQL = _PAIRS_SQL + """, both_ AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
reach AS (SELECT src AS node, src AS seen FROM both_ UNION SELECT r.node, b.dst FROM reach r JOIN both_ b ON r.seen = b.src),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
"""  # fmt: skip
_CHAIN_SQL = _PAIRS_SQL + """, nodes AS (SELECT structure, vec_id AS node, row_number() OVER (PARTITION BY structure ORDER BY vec_id) AS seq, vec_id % 4 AS grp FROM v)
"""  # fmt: skip


def distance(a, b):  # noqa: ANN001, ANN201
    return F.round(F.sqrt(pairs.squared_distance(a, b)), 9)


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / SIZE).alias("structure"), "vec_id", "embedding")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.within(structures(spark, sf_dir), ["structure"], "vec_id", distance, "embedding", LIMIT)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures(spark, sf_dir).select("structure", F.col("vec_id").alias("node"), (F.col("vec_id") % 4).alias("group"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("structure").orderBy("vec_id")
    return structures(spark, sf_dir).select("structure", F.col("vec_id").alias("node"), F.row_number().over(w).alias("seq"))


@bind("threshold_edges", _PAIRS_SQL + "SELECT structure, src, dst, dist FROM edges")
def threshold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@bind("nearest_neighbour", _PAIRS_SQL + """, s AS (SELECT structure, src AS vec_id, dst AS nearest, dist FROM d UNION ALL SELECT structure, dst, src, dist FROM d)
SELECT structure, vec_id, nearest, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nearest) AS k FROM s) WHERE k = 1""")  # fmt: skip
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.nearest(structures(spark, sf_dir), ["structure"], "vec_id", distance, "embedding")


@bind("nearest_between_sets", _PAIRS_SQL + """, s AS (SELECT structure, CASE WHEN src % 2 = 0 THEN src ELSE dst END AS src, CASE WHEN src % 2 = 0 THEN dst ELSE src END AS dst, dist FROM d WHERE src % 2 <> dst % 2)
SELECT structure, src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY dist, src, dst) AS k FROM s) WHERE k = 1""")  # fmt: skip
def nearest_between_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.nearest_between(structures(spark, sf_dir), ["structure"], "vec_id", F.col("vec_id") % 2 == 0, distance, "embedding")


@bind("near_set", _PAIRS_SQL + """, s AS (SELECT structure, src, dst, dist FROM edges UNION ALL SELECT structure, dst, src, dist FROM edges)
SELECT structure, dst AS vec_id, min(dist) AS dist FROM s WHERE src % 5 = 0 AND dst % 5 <> 0 GROUP BY structure, dst""")  # fmt: skip
def near_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.near_set(structures(spark, sf_dir), ["structure"], "vec_id", F.col("vec_id") % 5 == 0, distance, "embedding", LIMIT)


@bind("connected_components", _COMPONENTS_SQL + "SELECT node, component FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(edges(spark, sf_dir))


@bind("cycle_count", _COMPONENTS_SQL + """, n AS (SELECT component, count(*) AS n_nodes FROM comp GROUP BY 1),
e AS (SELECT component, count(*) AS n_edges FROM edges JOIN comp ON src = node GROUP BY 1)
SELECT component, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_edges, 0) - n_nodes + 1 AS n_cycles FROM n LEFT JOIN e USING (component)""")  # fmt: skip
def cycle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = materialize(edges(spark, sf_dir), "edges")
    return community.cycles(e, connected_components(e))


@bind("node_degree", _PAIRS_SQL + "SELECT structure, node, count(*) AS degree FROM (SELECT structure, src AS node FROM edges UNION ALL SELECT structure, dst FROM edges) GROUP BY 1, 2")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.degrees(edges(spark, sf_dir), ["structure"])


@bind("degree_modularity", _CHAIN_SQL + """, g AS (SELECT e.structure, a.grp AS g1, b.grp AS g2 FROM edges e JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst),
m AS (SELECT structure, count(*)::DOUBLE AS m FROM g GROUP BY 1),
i AS (SELECT structure, g1 AS grp, count(*) AS e FROM g WHERE g1 = g2 GROUP BY 1, 2),
k AS (SELECT structure, grp, count(*) AS d FROM (SELECT structure, g1 AS grp FROM g UNION ALL SELECT structure, g2 FROM g) GROUP BY 1, 2)
SELECT structure, round(sum(coalesce(e, 0) / m - (d / (2 * m)) ** 2), 9) AS modularity FROM k LEFT JOIN i USING (structure, grp) JOIN m USING (structure) GROUP BY structure""")  # fmt: skip
def degree_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.modularity(edges(spark, sf_dir), groups(spark, sf_dir), ["structure"]).withColumn("modularity", F.round("modularity", 9))


@bind("jackknife_modularity", _CHAIN_SQL + """, g AS (SELECT e.structure, (a.grp = b.grp)::INT AS inside FROM edges e JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst),
q AS (SELECT structure, inside, count(*) OVER (PARTITION BY structure)::DOUBLE AS m FROM g),
l AS (SELECT structure, m, -inside / m AS dq FROM q)
SELECT structure, round(sqrt((max(m) - 1) / max(m) * (sum(dq * dq) - sum(dq) * sum(dq) / max(m))), 9) AS stddev FROM l GROUP BY structure""")  # fmt: skip
def jackknife_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.jackknife(edges(spark, sf_dir), groups(spark, sf_dir), ["structure"]).withColumn("stddev", F.round("stddev", 9))


@bind("ratio_cut", _CHAIN_SQL + """, g AS (SELECT e.structure, a.grp AS g1, b.grp AS g2 FROM edges e JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.grp <> b.grp),
k AS (SELECT structure, grp, count(*) AS cut FROM (SELECT structure, g1 AS grp FROM g UNION ALL SELECT structure, g2 FROM g) GROUP BY 1, 2),
s AS (SELECT structure, grp, count(*) AS size FROM nodes GROUP BY 1, 2)
SELECT structure, round(sum(coalesce(cut, 0) / size::DOUBLE), 9) AS ratio_cut FROM s LEFT JOIN k USING (structure, grp) GROUP BY structure""")  # fmt: skip
def ratio_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.ratio_cut(edges(spark, sf_dir), groups(spark, sf_dir), ["structure"]).withColumn("ratio_cut", F.round("ratio_cut", 9))


@bind("prefix_cut_curve", _CHAIN_SQL + """, p AS (SELECT e.structure, least(a.seq, b.seq) AS lo, greatest(a.seq, b.seq) AS hi FROM edges e JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst),
m AS (SELECT structure, count(*)::DOUBLE AS m FROM p GROUP BY 1), s AS (SELECT structure, max(seq) AS n FROM nodes GROUP BY 1),
c AS (SELECT n.structure, n.seq, any_value(s.n) AS n, any_value(m.m) AS m, count_if(p.lo <= n.seq AND p.hi > n.seq) AS cut, count_if(p.lo <= n.seq) + count_if(p.hi <= n.seq) AS lft
      FROM nodes n JOIN m USING (structure) JOIN s USING (structure) JOIN p USING (structure) WHERE n.seq < s.n GROUP BY 1, 2)
SELECT structure, seq, cut, round((m - cut) / m - (lft / (2 * m)) ** 2 - ((2 * m - lft) / (2 * m)) ** 2, 9) AS modularity, round(cut / seq::DOUBLE + cut / (n - seq)::DOUBLE, 9) AS ratio_cut FROM c""")  # fmt: skip
def prefix_cut_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = community.prefix_cuts(chain(spark, sf_dir), edges(spark, sf_dir), ["structure"])
    return d.withColumns({"modularity": F.round("modularity", 9), "ratio_cut": F.round("ratio_cut", 9)})


@bind("chain_domains")
def chain_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated cutting has no plain SQL; tests compare with a small graph."""
    return community.chain_domains(chain(spark, sf_dir), edges(spark, sf_dir).select("structure", "src", "dst"), ["structure"])


@bind("ratio_cut_domains")
def ratio_cut_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated cutting has no plain SQL; tests compare with a small graph."""
    return community.ratio_cut_domains(chain(spark, sf_dir), edges(spark, sf_dir).select("structure", "src", "dst"), ["structure"])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures(spark, sf_dir).select("structure", F.col("vec_id").alias("node"))


@bind("greedy_communities", _PAIRS_SQL + """, g AS (SELECT structure, list({'a': src % 16, 'b': dst % 16}) AS e, count(*) AS m FROM edges GROUP BY 1),
s AS (SELECT DISTINCT v.structure, coalesce(g.e, []) AS e, coalesce(m, 0) AS m FROM v LEFT JOIN g ON g.structure = v.structure),
k AS (SELECT *, list_transform(range(0, 16), lambda n: len(list_filter(e, lambda x: x.a = n OR x.b = n))) AS deg FROM s),
r AS (SELECT structure, e, m, deg, range(0, 16) AS lab, 0 AS step FROM k
  UNION ALL SELECT structure, e, m, deg, list_transform(lab, lambda x: CASE WHEN x = best.b THEN best.a ELSE x END), step + 1 FROM (
    SELECT *, list_sort(list_transform(p, lambda q: {'w': -(2 * m * len(list_filter(e, lambda x: least(lab[x.a + 1], lab[x.b + 1]) = q.a AND greatest(lab[x.a + 1], lab[x.b + 1]) = q.b))
      - list_sum(list_transform(range(0, 16), lambda n: CASE WHEN lab[n + 1] = q.a THEN deg[n + 1] ELSE 0 END)) * list_sum(list_transform(range(0, 16), lambda n: CASE WHEN lab[n + 1] = q.b THEN deg[n + 1] ELSE 0 END))), 'a': q.a, 'b': q.b}))[1] AS best
    FROM (SELECT *, list_distinct(list_filter(list_transform(e, lambda x: {'a': least(lab[x.a + 1], lab[x.b + 1]), 'b': greatest(lab[x.a + 1], lab[x.b + 1])}), lambda q: q.a <> q.b)) AS p FROM r)) WHERE best.w < 0),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY structure ORDER BY step DESC) = 1)
SELECT v.structure, vec_id AS node, dense_rank() OVER (PARTITION BY v.structure ORDER BY lab[vec_id % 16 + 1]) - 1 AS domain FROM f JOIN v ON v.structure = f.structure""")  # fmt: skip
def greedy_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.greedy_communities(nodes(spark, sf_dir), edges(spark, sf_dir), ["structure"])


_SCALED = "list_transform(range(0, 256), lambda c: CASE WHEN {0}[c + 1] = 0 THEN 0 ELSE {0}[c + 1] / list_sum(list_transform(range(0, 16), lambda k: {0}[k * 16 + c % 16 + 1])) END)"


@bind("markov_clusters", _PAIRS_SQL + """, g AS (SELECT structure, list((src % 16) * 16 + dst % 16) || list((dst % 16) * 16 + src % 16) AS e FROM edges GROUP BY 1),
s AS (SELECT DISTINCT v.structure, coalesce(g.e, []) AS e FROM v LEFT JOIN g ON g.structure = v.structure),
a AS (SELECT structure, list_transform(range(0, 256), lambda c: CASE WHEN c // 16 = c % 16 OR list_contains(e, c) THEN 1.0::DOUBLE ELSE 0 END) AS w FROM s),
r AS (SELECT structure, list_transform(""" + _SCALED.format("w") + """, lambda x: round(x, 12)) AS m, true AS moving, 0 AS step FROM a
  UNION ALL SELECT structure, n, list_max(list_transform(range(1, 257), lambda c: CASE WHEN n[c] > 0 THEN abs(n[c] - m[c]) ELSE 0 END)) > 1e-9, step + 1 FROM (
    SELECT structure, m, step, list_transform(""" + _SCALED.format("u") + """, lambda x: round(x, 12)) AS n FROM (
      SELECT structure, m, step, list_transform(t, lambda x: CASE WHEN x < 1e-5 THEN 0 ELSE x END) AS u FROM (
        SELECT structure, m, step, """ + _SCALED.format("q") + """ AS t FROM (
          SELECT structure, m, step, list_transform(range(0, 256), lambda c: list_sum(list_transform(range(0, 16), lambda k: m[(c // 16) * 16 + k + 1] * m[k * 16 + c % 16 + 1])) ** 2) AS q FROM r WHERE moving))))),
f AS (SELECT structure, m FROM r QUALIFY row_number() OVER (PARTITION BY structure ORDER BY step DESC) = 1),
l AS (SELECT structure, m, range(0, 16) AS lab, 0 AS step FROM f
  UNION ALL SELECT structure, m, list_transform(range(0, 16), lambda i: list_min(list_transform(range(0, 16), lambda j: CASE WHEN i = j OR m[i * 16 + j + 1] > 0 OR m[j * 16 + i + 1] > 0 THEN lab[j + 1] ELSE 16 END))), step + 1 FROM l WHERE step < 15)
SELECT v.structure, vec_id AS node, dense_rank() OVER (PARTITION BY v.structure ORDER BY lab[vec_id % 16 + 1]) - 1 AS domain FROM l JOIN v ON v.structure = l.structure WHERE step = 15""")  # fmt: skip
def markov_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.markov_clusters(nodes(spark, sf_dir), edges(spark, sf_dir), ["structure"])


@bind("domain_overlap_counts", """
SELECT o_orderstatus, floor(o_orderkey / 7000)::BIGINT AS found, floor(o_custkey / 400)::BIGINT AS reference, count(*) AS shared FROM orders GROUP BY 1, 2, 3""")  # fmt: skip
def domain_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    found = o.select("o_orderstatus", "o_orderkey", F.floor(F.col("o_orderkey") / 7000).alias("domain"))
    reference = o.select("o_orderstatus", "o_orderkey", F.floor(F.col("o_custkey") / 400).alias("domain"))
    return domains.overlap_counts(found, reference, ["o_orderstatus"], "o_orderkey")


@bind("domain_overlap", """
WITH o AS (SELECT o_orderstatus, (o_orderkey % 2)::INT AS a, (o_custkey % 2)::INT AS b FROM orders)
SELECT o_orderstatus, count(DISTINCT a) AS n_found, count(DISTINCT b) AS n_reference,
       round(greatest(count_if(a = b), count_if(a <> b)) / count(*)::DOUBLE, 9) AS score FROM o GROUP BY 1""")  # fmt: skip
def domain_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    found = o.select("o_orderstatus", "o_orderkey", (F.col("o_orderkey") % 2).alias("domain"))
    reference = o.select("o_orderstatus", "o_orderkey", (F.col("o_custkey") % 2).alias("domain"))
    return domains.overlap_scores(found, reference, ["o_orderstatus"], "o_orderkey").withColumn("score", F.round("score", 9))
