"""Angle codes, scores, packed matrices, colours and matrix searches on the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helispan.functions import geometry, scalar
from helispan.operators import align, matching, pairs, ranks
from helispan.plans.bindings import bind, table
from helispan.session import materialize

#: A structure is sixteen vectors in a row; structures stay as small however many there are.
SIZE = 16
_ANGLE_SQL = "a AS (SELECT vec_id, vec_id // 16 AS structure, label, round(atan2(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 12) AS omega FROM embeddings)"
_CODE = """CASE WHEN omega > -pi()/4 AND omega <= pi()/4 THEN 'P' WHEN omega > pi()/4 AND omega <= 3*pi()/4 THEN 'R' WHEN omega > -3*pi()/4 AND omega <= -pi()/4 THEN 'L' ELSE 'O' END ||
CASE WHEN omega > 0 AND omega <= pi()/2 THEN 'D' WHEN omega > pi()/2 THEN 'T' WHEN omega <= -pi()/2 THEN 'S' ELSE 'E' END"""
_CODED_SQL = f"WITH {_ANGLE_SQL}, c AS (SELECT *, {_CODE} AS code FROM a)"
_PAIRS_SQL = _CODED_SQL + ", p AS (SELECT x.structure, x.vec_id AS i, y.vec_id AS j, x.omega AS o1, y.omega AS o2, x.code AS c1, y.code AS c2 FROM c x JOIN c y ON x.structure = y.structure AND x.vec_id < y.vec_id)"


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    omega = F.round(F.atan2(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")), 12)
    return e.select("vec_id", F.floor(F.col("vec_id") / SIZE).alias("structure"), "label", omega.alias("omega")).withColumn("code", scalar.angle_code(F.col("omega")))


@bind("angle_code", _CODED_SQL + "SELECT vec_id, code FROM c")
def angle_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("vec_id", "code")


def _coded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.triangular(coded(spark, sf_dir), ["structure"], "vec_id")


@bind("code_score_matrix", _PAIRS_SQL + """
SELECT structure, i, j, CASE WHEN c1 = c2 THEN 2 WHEN c1[1] = c2[1] OR c1[2] = c2[2] THEN 1 ELSE -2 END AS score FROM p""")  # fmt: skip
def code_score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded_pairs(spark, sf_dir).select("structure", F.col("a_vec_id").alias("i"), F.col("b_vec_id").alias("j"), scalar.score_codes(F.col("a_code"), F.col("b_code")).alias("score"))


@bind("angle_score", _PAIRS_SQL + """
SELECT structure, i, j, round(pi()/4 - least(abs(o1 - o2), 2*pi() - abs(o1 - o2)), 9) AS radians,
       round(45 - least(abs(degrees(o1) - degrees(o2)), 360 - abs(degrees(o1) - degrees(o2))), 6) AS degrees FROM p""")  # fmt: skip
def angle_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a_omega"), F.col("b_omega")
    return _coded_pairs(spark, sf_dir).select("structure", F.col("a_vec_id").alias("i"), F.col("b_vec_id").alias("j"), F.round(scalar.score_radians(a, b), 9).alias("radians"), F.round(scalar.score_degrees(a, b), 6).alias("degrees"))


@bind("paired_codes", _PAIRS_SQL + """
SELECT i, j, CASE WHEN i % 2 = j % 2 AND c1[1] = 'O' THEN 'HH' WHEN i % 2 = j % 2 AND c1[1] = 'P' THEN 'KK' ELSE c1 END AS code FROM p""")  # fmt: skip
def paired_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("a_vec_id") % 2 == F.col("b_vec_id") % 2
    return _coded_pairs(spark, sf_dir).select(F.col("a_vec_id").alias("i"), F.col("b_vec_id").alias("j"), scalar.paired_code(F.col("a_code"), F.lit(True), same).alias("code"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors numbered within their label, by ranges, as a label may hold any number of them."""
    return ranks.running(coded(spark, sf_dir), ["vec_id"], {"seq": F.lit(1)}, by=("label",))


@bind("packed_index", _CODED_SQL + """
, n AS (SELECT structure, vec_id, row_number() OVER (PARTITION BY structure ORDER BY vec_id) - 1 AS seq FROM c)
SELECT x.structure, x.vec_id AS i, y.vec_id AS j, (x.seq + y.seq * (y.seq + 1) // 2)::BIGINT AS r FROM n x JOIN n y ON x.structure = y.structure AND x.seq <= y.seq""")  # fmt: skip
def packed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("structure").orderBy("vec_id")
    n = coded(spark, sf_dir).select("structure", "vec_id", (F.row_number().over(w) - 1).alias("seq"))
    d = pairs.sides(n, ["structure"], "a_").join(pairs.sides(n, ["structure"], "b_"), "structure").where("a_seq <= b_seq")
    return d.select("structure", F.col("a_vec_id").alias("i"), F.col("b_vec_id").alias("j"), scalar.packed_index(F.col("a_seq"), F.col("b_seq")).alias("r"))


def packed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed matrix for each eight vectors of a label."""
    n = _numbered(spark, sf_dir).where("seq is not null").select((F.col("label") * 1000000 + F.floor(F.col("seq") / 8)).alias("target_id"), (F.col("seq") % 8).alias("seq"), "omega")
    return _packed(n)


def _packed(n: DataFrame) -> DataFrame:
    """Packed matrices: codes of the angles between two vectors, segment types on the diagonal."""
    d = pairs.sides(n, ["target_id"], "a_").join(pairs.sides(n, ["target_id"], "b_"), "target_id").where("a_seq <= b_seq")
    angle = F.col("a_omega") - F.col("b_omega")
    turned = angle - F.lit(2 * 3.141592653589793) * F.round(angle / F.lit(2 * 3.141592653589793))
    code = F.when(F.col("a_seq") == F.col("b_seq"), scalar.diagonal_code(F.when(F.col("a_omega") > 0, "strand").otherwise("alpha"))).otherwise(scalar.angle_code(turned))
    return pairs.pack(d.select("target_id", F.col("a_seq").alias("i"), F.col("b_seq").alias("j"), code.alias("code")), ["target_id"], "i", "j", "code")


@bind("packed_matrices", _CODED_SQL + """
, n AS (SELECT label, omega, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS q FROM c),
m AS (SELECT label * 1000000 + q // 8 AS target_id, q % 8 AS seq, omega FROM n),
d AS (SELECT x.target_id, x.seq AS i, y.seq AS j, x.omega AS o1, x.omega - y.omega - 2*pi() * round((x.omega - y.omega) / (2*pi())) AS omega FROM m x JOIN m y ON x.target_id = y.target_id AND x.seq <= y.seq)
SELECT target_id, string_agg(CASE WHEN i = j THEN CASE WHEN o1 > 0 THEN 'e ' ELSE 'xa' END ELSE """ + _CODE + """ END, ',' ORDER BY j, i) AS packed FROM d GROUP BY target_id""")  # fmt: skip
def packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_codes(spark, sf_dir).select("target_id", F.array_join("packed", ",").alias("packed"))


@bind("tableau_dp_search")
def tableau_dp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-level alignment has no plain SQL; tests compare with worked examples."""
    d = materialize(packed_codes(spark, sf_dir), "packed")
    return align.search(d, d.where("target_id % 100 = 0").select(F.col("target_id").alias("query_id"), "packed"))


@bind("qp_search")
def qp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """It has no SQL; tests hold it against all matchings of small matrices."""
    d = materialize(packed_codes(spark, sf_dir), "packed")
    asked = d.where("target_id % 100 = 0").select(F.col("target_id").alias("query_id"), "packed")
    return matching.search_relaxed(d, asked, listed=False).select("query_id", "target_id", "objective")


_SCORE = "CASE WHEN {0} = {1} THEN 2 WHEN {0}[1] = {1}[1] OR {0}[2] = {1}[2] THEN 1 ELSE -2 END"


@bind("exact_matching", _CODED_SQL.replace("WITH a", "WITH RECURSIVE a") + """,
n AS (SELECT vec_id // 5 AS block, vec_id % 5 AS seq, omega FROM c),
d AS (SELECT x.block, x.seq AS i, y.seq AS j, x.omega AS o1, least(x.seq, y.seq) = x.seq AS upper_,
      CASE WHEN x.seq <= y.seq THEN x.omega - y.omega ELSE y.omega - x.omega END AS angle FROM n x JOIN n y ON x.block = y.block),
m AS (SELECT block, i, j, o1, angle - 2*pi() * round(angle / (2*pi())) AS omega FROM d),
b AS (SELECT block, list(CASE WHEN i = j THEN CASE WHEN o1 > 0 THEN 'e ' ELSE 'xa' END ELSE """ + _CODE + """ END ORDER BY i, j) AS codes, count(DISTINCT i) AS n FROM m GROUP BY block),
r AS (SELECT q.block AS query_id, t.block AS target_id, q.codes AS a, t.codes AS b, q.n AS m, t.n AS n, 0::BIGINT AS k, []::BIGINT[] AS c, -1::BIGINT AS last, 0::BIGINT AS v
      FROM b q JOIN b t ON q.block % 100 = 0
  UNION ALL SELECT query_id, target_id, a, b, m, n, k + 1, list_append(c, l), CASE WHEN l < n THEN l ELSE last END, v + CASE WHEN l < n THEN """ + _SCORE.format("a[k * m + k + 1]", "b[l * n + l + 1]")
      + """ + 2 * coalesce(list_sum(list_transform(range(0, k), lambda i: CASE WHEN c[i + 1] < n THEN """ + _SCORE.format("a[i * m + k + 1]", "b[c[i + 1] * n + l + 1]") + """ ELSE 0 END)), 0) ELSE 0 END
      FROM r, (SELECT unnest(range(0, 6)) AS l) WHERE k < m AND (l = n OR (l < n AND l > last))),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, target_id ORDER BY v DESC, c) AS place FROM r WHERE k = m)
SELECT query_id, target_id, -v AS objective, array_to_string(list_filter(list_transform(range(0, m), lambda i: CASE WHEN c[i + 1] < n THEN i || ':' || c[i + 1] END), lambda x: x IS NOT NULL), ',') AS matches FROM f WHERE place = 1""")  # fmt: skip
def exact_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors in a row make a matrix; each whose number is divisible by 100 is matched with all."""
    n = coded(spark, sf_dir).select(F.floor(F.col("vec_id") / 5).alias("target_id"), (F.col("vec_id") % 5).alias("seq"), "omega")
    d = materialize(_packed(n), "packed")
    found = matching.search_exact(d, d.where("target_id % 100 = 0").select(F.col("target_id").alias("query_id"), "packed"))
    listed = F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["i"], x["j"])), ",")
    return found.select("query_id", "target_id", F.col("objective").cast("long").alias("objective"), listed.alias("matches"))


@bind("nw_align", """
WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
ab AS (SELECT user_id, k // 24 AS stretch, coalesce(list(event_type ORDER BY k) FILTER (k % 24 < 12), []) AS a, coalesce(list(event_type ORDER BY k) FILTER (k % 24 >= 12), []) AS b FROM e GROUP BY 1, 2),
r AS (SELECT user_id, stretch, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0.0::DOUBLE) AS h FROM ab
  UNION ALL SELECT user_id, stretch, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_max(list_transform(range(0, j + 1),
    lambda k: k + CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE greatest(h[k] + (a[i + 1] = b[k])::INT, h[k + 1] - 1) END)) - j) FROM r WHERE i < len(a))
SELECT user_id, stretch, h[len(b) + 1] AS score FROM r WHERE i = len(a)""")  # fmt: skip
def nw_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of 24 events of a user: its first twelve aligned with its last twelve."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w) - 1)
    half = lambda own: F.transform(F.sort_array(F.collect_list(F.when(own, F.struct("k", "event_type")))), lambda x: x["event_type"])
    d = e.groupBy("user_id", F.floor(F.col("k") / 24).alias("stretch")).agg(half(F.col("k") % 24 < 12).alias("a"), half(F.col("k") % 24 >= 12).alias("b"))
    return d.select("user_id", "stretch", align.align_score(F.col("a"), F.col("b")).alias("score"))


def _blocks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """All vectors of a label in blocks of ``size``: a matrix each."""
    return _numbered(spark, sf_dir).select((F.col("label") * 1000000 + F.floor(F.col("seq") / size)).alias("matrix"), (F.col("seq") % size).alias("seq"), "code")


_BLOCKS_SQL = _CODED_SQL + ", o AS (SELECT label, code, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS q FROM c), n AS (SELECT label * 1000000 + q // {0} AS matrix, q % {0} AS seq, code FROM o)"


@bind("ilp_objective", _BLOCKS_SQL.format(5) + """,
x AS (SELECT a.matrix, a.seq AS i, b.seq AS k, a.code AS code FROM n a JOIN n b ON a.matrix = b.matrix)
SELECT p.matrix, p.i, q.i AS j, p.k, q.k AS l, -(CASE WHEN p.code = q.code THEN 2 WHEN p.code[1] = q.code[1] OR p.code[2] = q.code[2] THEN 1 ELSE -2 END) AS coefficient,
       p.i * 125 + q.i * 25 + p.k * 5 + q.k AS variable FROM x p JOIN x q ON p.matrix = q.matrix""")  # fmt: skip
def ilp_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _blocks(spark, sf_dir, 5)
    x = pairs.sides(n, ["matrix"], "a_").join(pairs.sides(n, ["matrix"], "b_"), "matrix")
    a = x.select("matrix", F.col("a_seq").alias("i"), F.col("b_seq").alias("k"), F.col("a_code").alias("code"))
    b = x.select("matrix", F.col("a_seq").alias("j"), F.col("b_seq").alias("l"), F.col("a_code").alias("code2"))
    d = align.objective_terms(a, b, "matrix", scalar.score_codes(F.col("code"), F.col("code2")))
    return d.withColumn("variable", scalar.flat_index([5, 5, 5, 5], *[F.col(c) for c in "ijkl"]))


@bind("ilp_order_conflicts", _BLOCKS_SQL.format(6) + """,
m AS (SELECT a.matrix, a.seq AS i, b.seq AS j FROM n a JOIN n b ON a.matrix = b.matrix)
SELECT x.matrix, x.i, x.j, y.i AS k, y.j AS l FROM m x JOIN m y ON x.matrix = y.matrix AND x.i < y.i AND y.j < x.j""")  # fmt: skip
def ilp_order_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _blocks(spark, sf_dir, 6).select("matrix", "seq")
    m = pairs.sides(n, ["matrix"], "a_").join(pairs.sides(n, ["matrix"], "b_"), "matrix").select("matrix", F.col("a_seq").alias("i"), F.col("b_seq").alias("j"))
    return align.order_conflicts(m, "matrix")


_GRADIENT_SQL = """
WITH r AS (SELECT n_nationkey, 240.0::DOUBLE - (row_number() OVER (ORDER BY n_nationkey) - 1) * (240.0::DOUBLE / count(*) OVER ()) AS hue FROM nation),
f AS (SELECT n_nationkey, floor(hue / 60)::INT AS s, hue / 60 - floor(hue / 60) AS f FROM r),
c AS (SELECT n_nationkey,
  CASE s WHEN 0 THEN 1 WHEN 1 THEN 1 - f WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN f ELSE 1 END AS r,
  CASE s WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - f WHEN 4 THEN 0 ELSE 0 END AS g,
  CASE s WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN f WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 1 - f END AS b FROM f)
SELECT n_nationkey, printf('%02x%02x%02x', floor(r * 255 + 0.5)::INT, floor(g * 255 + 0.5)::INT, floor(b * 255 + 0.5)::INT) AS colour FROM c
"""


@bind("colour_gradient", _GRADIENT_SQL)
def colour_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    # A chain of segments is one group; the nations are 25 rows.
    w = Window.partitionBy(F.lit(0)).orderBy("n_nationkey")
    d = n.withColumn("rank", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return d.select("n_nationkey", scalar.gradient(F.col("rank"), F.col("n")).alias("colour"))


@bind("palette_colours", """
SELECT p_partkey, (['red', 'green', 'blue', 'grey'])[(p_size % 4 + 1)::INT] AS colour FROM part""")  # fmt: skip
def palette_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalar.palette(["red", "green", "blue", "grey"], F.col("p_size")).alias("colour"))


@bind("residue_order", r"""
SELECT p_partkey, nullif(regexp_extract(r, '^(-?\d+)(\D?)$', 1), '')::INT AS resnum, nullif(regexp_extract(r, '^(-?\d+)(\D?)$', 2), '') AS icode
FROM (SELECT p_partkey, p_size::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN 'A' WHEN p_partkey % 3 = 1 THEN 'B' ELSE '' END AS r FROM part)""")  # fmt: skip
def residue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 3 == 0, "A").when(F.col("p_partkey") % 3 == 1, "B").otherwise("")
    d = table(spark, sf_dir, "part").select("p_partkey", scalar.residue(F.concat(F.col("p_size").cast("string"), suffix)).alias("r"))
    return d.select("p_partkey", "r.resnum", "r.icode")


def _point(k: int) -> Column:
    e = F.col("embedding")
    return geometry.vec(e[k], e[k + 1], e[k + 2])


@bind("dihedral_angle", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT vec_id, e[4]-e[1] AS ax, e[5]-e[2] AS ay, e[6]-e[3] AS az, e[7]-e[4] AS bx, e[8]-e[5] AS b_y, e[9]-e[6] AS bz, e[10]-e[7] AS cx, e[11]-e[8] AS cy, e[12]-e[9] AS cz FROM e),
n AS (SELECT *, ay*bz-az*b_y AS n1x, az*bx-ax*bz AS n1y, ax*b_y-ay*bx AS n1z, b_y*cz-bz*cy AS n2x, bz*cx-bx*cz AS n2y, bx*cy-b_y*cx AS n2z FROM v)
SELECT vec_id, round(acos(greatest(-1, least(1, (n1x*n2x+n1y*n2y+n1z*n2z) / (sqrt(n1x*n1x+n1y*n1y+n1z*n1z) * sqrt(n2x*n2x+n2y*n2y+n2z*n2z)))))
       * CASE WHEN n1x*cx+n1y*cy+n1z*cz < 0 THEN -1 ELSE 1 END, 6) AS angle FROM n""")  # fmt: skip
def dihedral_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = geometry.dihedral(_point(0), _point(3), _point(6), _point(9))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(angle, 6).alias("angle"))


@bind("line_projection", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, ((e[7]-e[1])*(e[4]-e[1]) + (e[8]-e[2])*(e[5]-e[2]) + (e[9]-e[3])*(e[6]-e[3])) / ((e[4]-e[1])**2 + (e[5]-e[2])**2 + (e[6]-e[3])**2) AS u FROM e)
SELECT vec_id, round(e[1] + u*(e[4]-e[1]), 6) AS x, round(e[2] + u*(e[5]-e[2]), 6) AS y, round(e[3] + u*(e[6]-e[3]), 6) AS z FROM u""")  # fmt: skip
def line_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", geometry.project(_point(0), _point(3), _point(6)).alias("p"))
    return d.select("vec_id", *[F.round(F.col("p")[k], 6).alias(k) for k in "xyz"])
