"""Clusters of graphs by greedy modularity and by Markov clustering.

The original called external programs; these are of the library's own and not bound to give the same clusters.
Edges are rows ``by, src, dst``, each undirected edge once and without loops; nodes are rows ``by, node``.
Clusters are numbered from 0 in the order of their least nodes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helispan.operators.graph import connected_components
from helispan.session import finished, materialize

#: Places to which the values of the Markov matrix are rounded each round, so that equal ones stay equal.
PLACES = 12


def agglomerate(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """The least node of each node's community: communities whose union raises the modularity most are merged, as long as it rises.

    With m edges, e of them between two communities of degrees c and d, a merge is worth (2 m e - c d) / (2 m m); the
    whole number above the line decides, then the least nodes. A heap holds what each pair was worth; entries that
    no longer hold are passed over.
    """
    label = {n: n for n in nodes}
    between: dict[int, dict[int, int]] = {n: {} for n in nodes}
    degree = dict.fromkeys(nodes, 0)
    for a, b in edges:
        between[a][b] = between[a].get(b, 0) + 1
        between[b][a] = between[b].get(a, 0) + 1
        degree[a] += 1
        degree[b] += 1
    twice = 2 * len(edges)

    def worth(a: int, b: int) -> int:
        return twice * between[a][b] - degree[a] * degree[b]

    heap = [(-worth(a, b), a, b) for a in between for b in between[a] if a < b]
    heapq.heapify(heap)
    members = {n: [n] for n in nodes}
    while heap and heap[0][0] < 0:
        value, a, b = heapq.heappop(heap)
        if a not in members or b not in members or b not in between[a] or worth(a, b) != -value:
            continue
        members[a] += members.pop(b)
        degree[a] += degree.pop(b)
        del between[a][b]
        for c, e in between.pop(b).items():
            if c != a:
                between[a][c] = between[a].get(c, 0) + e
                between[c][a] = between[a][c]
                del between[c][b]
        for c in between[a]:
            if worth(a, c) > 0:
                heapq.heappush(heap, (-worth(a, c), min(a, c), max(a, c)))
    for least, own in members.items():
        label.update(dict.fromkeys(own, least))
    return label


def _numbered(labels: DataFrame, by: list[str]) -> DataFrame:
    """``by, node, domain`` from ``by, node, label``: labels of a structure numbered in their order."""
    firsts = labels.select(*by, "label").distinct().withColumn("domain", F.row_number().over(Window.partitionBy(*by).orderBy("label")) - 1)
    return labels.join(firsts, [*by, "label"]).select(*by, "node", "domain")


def greedy_communities(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """``by, node, domain`` by greedy modularity, each structure in one task: for structures that fit there.

    A structure without edges is as many clusters as nodes; nodes are whole numbers, without nulls.
    """
    rows = nodes.select(*by, F.col("node").cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    rows = rows.unionByName(edges.select(*by, F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")))
    listed = rows.groupBy(*by).agg(F.collect_list(F.when(F.col("b").isNull(), F.col("a"))).alias("nodes"), F.collect_list(F.when(F.col("b").isNotNull(), F.struct("a", "b"))).alias("edges"))
    label = pa.list_(pa.struct([("node", pa.int64()), ("label", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, ends in zip(batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist(), strict=True):
                of = agglomerate(sorted(own), [(min(e["a"], e["b"]), max(e["a"], e["b"])) for e in ends])
                out.append([{"node": n, "label": x} for n, x in of.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(out, label)], names=[*by, "labels"])

    kinds = [f"{c} {nodes.schema[c].dataType.simpleString()}" for c in by]
    labels = listed.mapInArrow(found, ", ".join([*kinds, "labels array<struct<node:bigint,label:bigint>>"]))
    return _numbered(labels.select(*by, F.inline("labels")), by)


def mutual_communities(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """``by, node, domain`` by rounds of merges, for graphs of any size.

    In a round each community chooses the neighbour whose union raises the modularity most (the least node decides among
    equals), and those that choose each other merge; it ends when none rises. The pair that is best of all always chooses each
    other, so that each round merges and raises the modularity. Each round is written.
    """

    def build() -> DataFrame:
        total = edges.groupBy(*by).agg((2 * F.count("*")).alias("_twice"))
        labels = materialize(nodes.select(*by, "node", F.col("node").alias("label")), "labels")
        ends = edges.select(*by, F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select(*by, F.col("e.src").alias("a"), F.col("e.dst").alias("b"), F.lit(1).cast("long").alias("e"))
        ends = materialize(ends.groupBy(*by, "a", "b").agg(F.sum("e").alias("e")), "ends")
        while True:
            degree = ends.groupBy(*by, "a").agg(F.sum("e").alias("d"))
            d = ends.where("a <> b").join(degree, [*by, "a"]).join(degree.select(*by, F.col("a").alias("b"), F.col("d").alias("d2")), [*by, "b"]).join(total, by)
            worth = F.col("_twice") * F.col("e") - F.col("d") * F.col("d2")
            # Among equals the pair of the least nodes, which both ends see alike.
            key = F.struct(worth.alias("w"), (-F.least("a", "b")).alias("x"), (-F.greatest("a", "b")).alias("y"))
            best = d.where(worth > 0).groupBy(*by, "a").agg(F.max(F.struct(key.alias("k"), F.col("b").alias("b"))).alias("best")).select(*by, "a", "best.b")
            back = best.select(*by, F.col("a").alias("b"), F.col("b").alias("a"))
            merged = materialize(best.join(back, [*by, "a", "b"]).where("a > b").select(*by, F.col("a").alias("label"), F.col("b").alias("into")), "merged")
            if merged.isEmpty():
                break
            labels = materialize(labels.join(merged, [*by, "label"], "left").select(*by, "node", F.coalesce("into", "label").alias("label")), "labels")
            moved = ends.join(merged.select(*by, F.col("label").alias("a"), F.col("into").alias("_a")), [*by, "a"], "left").join(merged.select(*by, F.col("label").alias("b"), F.col("into").alias("_b")), [*by, "b"], "left")
            ends = materialize(moved.select(*by, F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "e").groupBy(*by, "a", "b").agg(F.sum("e").alias("e")), "ends")
        return _numbered(labels, by)

    return finished(nodes.sparkSession, build, "communities")


def markov_clusters(nodes: DataFrame, edges: DataFrame, by: list[str], inflation: float = 2.0, least: float = 1e-5, weight: str | None = None, most_rounds: int = 200) -> DataFrame:
    """``by, node, domain`` by Markov clustering (G10), on graphs of any size.

    The matrix begins with the weights of the edges (1 without ``weight``) and for each node a loop as heavy as its heaviest edge (1 if
    it has none), columns scaled to sum 1. A round squares it, raises values to the power ``inflation``, scales
    columns, leaves out values below ``least``, scales again and rounds to PLACES. The product is a join on the inner index and
    sums; a column keeps at most 1 / ``least`` values. Structures whose matrix no round changes are
    put aside. Nodes in one column or row of the end are in one cluster.
    """
    column = [*by, "_j"]

    def scaled(m: DataFrame) -> DataFrame:
        return m.withColumn("_v", F.col("_v") / F.sum("_v").over(Window.partitionBy(*column)))

    def build() -> DataFrame:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        given = edges.select(*by, F.explode(F.array(F.struct(F.col("src").alias("_i"), F.col("dst").alias("_j"), w.alias("_v")), F.struct(F.col("dst").alias("_i"), F.col("src").alias("_j"), w.alias("_v")))).alias("e")).select(*by, "e.*")
        heavy = given.groupBy(*column).agg(F.max("_v").alias("_v"))
        loops = nodes.select(*by, F.col("node").alias("_j")).join(heavy, column, "left").select(*by, F.col("_j").alias("_i"), "_j", F.coalesce("_v", F.lit(1.0)).alias("_v"))
        m = materialize(scaled(given.unionByName(loops).groupBy(*by, "_i", "_j").agg(F.sum("_v").alias("_v"))).withColumn("_v", F.round("_v", PLACES)), "markov")
        ended = []
        for _ in range(most_rounds):
            product = m.select(*by, "_i", F.col("_j").alias("_k"), F.col("_v").alias("_x")).join(m.select(*by, F.col("_i").alias("_k"), "_j", "_v"), [*by, "_k"])
            square = product.groupBy(*by, "_i", "_j").agg(F.sum(F.col("_x") * F.col("_v")).alias("_v"))
            raised = scaled(square.withColumn("_v", F.pow("_v", F.lit(inflation))))
            after = scaled(raised.where(F.col("_v") >= least)).withColumn("_v", F.round("_v", PLACES))
            after = materialize(after.join(m.withColumnRenamed("_v", "_old"), [*by, "_i", "_j"], "left"), "markov")
            # Columns sum to 1, so a matrix changes only where one of its values after is another.
            changed = after.where("_old is null or abs(_v - _old) > 1e-9").select(*by)
            if changed.isEmpty():
                ended.append(after.drop("_old"))
                break
            moving = changed.distinct()
            ended.append(after.drop("_old").join(moving, by, "left_anti"))
            m = after.drop("_old").join(moving, by, "left_semi")
        else:
            raise RuntimeError(f"matrices did not settle in {most_rounds} rounds")
        whole = materialize(reduce(DataFrame.unionByName, ended), "limits")
        # Nodes are told apart across structures by numbers of their own.
        numbered = materialize(nodes.select(*by, "node").distinct().withColumn("_n", F.monotonically_increasing_id()), "numbered")
        a, b = (numbered.select(*by, F.col("node").alias(c), F.col("_n").alias(name)) for c, name in (("_i", "src"), ("_j", "dst")))
        of = connected_components(whole.join(a, [*by, "_i"]).join(b, [*by, "_j"]).select("src", "dst"))
        placed = numbered.join(of.withColumnRenamed("node", "_n"), "_n").select(*by, "node", "component")
        firsts = placed.groupBy(*by, "component").agg(F.min("node").alias("label"))
        return _numbered(placed.join(firsts, [*by, "component"]).select(*by, "node", "label"), by)

    return finished(nodes.sparkSession, build, "clusters")
