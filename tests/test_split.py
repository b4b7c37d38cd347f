"""Files read in byte ranges against whole files; table functions against DataFrames."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helispan.functions import tables
from helispan.operators import align
from helispan.sources import text


@pytest.fixture()
def ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def _rows(df, drop=()):
    return sorted((tuple(r[c] for c in df.columns if c not in drop) for r in df.collect()), key=repr)


def test_ranges_equal_whole_files(spark, ranges, tmp_path):
    rng = random.Random(1)
    for f in range(2):
        lines, clusters = [], []
        for q in range(40):
            lines.append(f"# QUERYID = d{q:05d}_")
            lines += [f"d{rng.randint(0, 99):05d}_ {rng.choice(['-1.5', '2', 'nan', '********', '7.25'])}" for _ in range(rng.choice([0, 3, 300 if q % 7 == 0 else 20]))]
            clusters.append(f">Cluster {q}")
            clusters += [f"{k}\t{rng.randint(20, 900)}aa, >p{q}_{k} mol:{'protein' if (q + k) % 3 else 'na'}... {'*' if k == 0 else 'at 97%'}" for k in range(rng.choice([1, 4, 60]))]
        ends = "\r\n" if f else "\n"
        (tmp_path / f"r{f}.out").write_text(ends.join(lines) + ("" if f else ends), newline="")
        (tmp_path / f"c{f}.clstr").write_text(ends.join(clusters) + ends, newline="")
    for glob, parse in (("*.out", text.read_results), ("*.clstr", text.read_clusters), ("*.clstr", lambda d: text.protein_clusters(text.read_clusters(d)))):
        split, whole = text.split_lines(spark, str(tmp_path), glob), text.lines(spark, str(tmp_path), glob)
        assert split.select("path", "start").distinct().count() >= 6
        name = F.regexp_extract("path", "([^/]+)$", 1)
        assert _rows(split.select(name, "n", "line")) == _rows(whole.where("line <> '' or n < 0").select(name, "n", "line"))
        assert _rows(parse(split).withColumn("path", name)) == _rows(parse(whole).withColumn("path", name)) != []


def test_first_member_decides(spark):
    body = ">Cluster 0\n0\t9aa, >a mol:na... *\n1\t8aa, >b mol:protein... at 99%\n>Cluster 1\n0\t9aa, >c mol:protein... *\n1\t7aa, >d mol:na... at 98%"
    members = text.read_clusters(text.numbered(spark.createDataFrame([("f", body)], "path string, value string")))
    assert sorted(r.id for r in text.protein_clusters(members).collect()) == ["c", "d"]


def test_table_functions(spark):
    tables.register(spark)
    orders = spark.createDataFrame([(1, 2, 3), (2, 3, 2), (3, 1, 1)], "matrix int, m int, n int")
    orders.createOrReplaceTempView("orders_of_matrices")
    matches = orders.select("matrix", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), "n").select("matrix", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    for products in (True, False):
        got = spark.sql(f"SELECT matrix, c.* FROM orders_of_matrices, LATERAL match_constraints(m, n, {str(products).lower()}) c")
        assert _rows(got) == _rows(align.match_constraints(matches, "matrix", products).select(*got.columns))
    spark.createDataFrame([(1, list("GGAC"), list("GAC")), (2, [], list("A")), (3, None, None)], "k int, a array<string>, b array<string>").createOrReplaceTempView("sequences")
    got = {}
    for r in spark.sql("SELECT k, p.* FROM sequences, LATERAL alignment_path(a, b, -1) p ORDER BY k, step").collect():
        got.setdefault(r.k, []).append((r.i, r.j, r.score))
    value, path = align.align(np.array([[float(x == y) for y in "GAC"] for x in "GGAC"]), -1.0)
    assert got[1] == [(i, j, value) for i, j in path] and 3 not in got and [x[:2] for x in got[2]] == [(None, 0)]
