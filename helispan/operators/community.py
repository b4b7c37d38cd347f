"""Measures of divisions of graphs (A8-A10, A19, G2, W7) and decomposition by them.

Edges are rows ``by, src, dst``, each undirected edge once and without loops.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helispan.operators import runs
from helispan.session import finished, materialize


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    """``by, node, degree``."""
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(*by, "node").agg(F.count("*").alias("degree"))


def cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Independent cycles of each component: edges - nodes + 1."""
    nodes = components.groupBy("component").agg(F.count("*").alias("n_nodes"))
    of = edges.join(components.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("n_edges"))
    return nodes.join(of, "component", "left").select("component", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), (F.coalesce("n_edges", F.lit(0)) - F.col("n_nodes") + 1).alias("n_cycles"))


def _grouped(edges: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    a = groups.select(*by, F.col("node").alias("src"), F.col("group").alias("g1"))
    b = groups.select(*by, F.col("node").alias("dst"), F.col("group").alias("g2"))
    return edges.join(a, [*by, "src"]).join(b, [*by, "dst"])


def modularity(edges: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``by, modularity``: the sum over groups of e/m - (d/2m)^2."""
    g = _grouped(edges, groups, by)
    inside = g.where("g1 = g2").groupBy(*by, F.col("g1").alias("group")).agg(F.count("*").alias("e"))
    ends = g.select(*by, F.explode(F.array("g1", "g2")).alias("group")).groupBy(*by, "group").agg(F.count("*").alias("d"))
    m = edges.groupBy(*by).agg(F.count("*").alias("m"))
    d = ends.join(inside, [*by, "group"], "left").join(m, by)
    each = F.coalesce("e", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))
    return d.groupBy(*by).agg(F.sum(each).alias("modularity"))


def jackknife(edges: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``by, stddev`` of the modularity when single edges are left out.

    Degrees and edge count stay those of the whole graph, so leaving out an edge inside a group
    lowers the modularity by 1/m and another edge by nothing: the sum over edges has a closed form.
    """
    g = _grouped(edges, groups, by)
    n = g.groupBy(*by).agg(F.count("*").cast("double").alias("m"), F.count_if(F.col("g1") == F.col("g2")).cast("double").alias("e"))
    m, e = F.col("m"), F.col("e")
    spread = (e * (m - e) / m) / (m * m)
    return n.select(*by, F.sqrt((m - 1) / m * spread).alias("stddev"))


def ratio_cut(edges: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``by, ratio_cut``: the sum over groups of cut edges by nodes (A10)."""
    g = _grouped(edges, groups, by).where("g1 <> g2")
    cut = g.select(*by, F.explode(F.array("g1", "g2")).alias("group")).groupBy(*by, "group").agg(F.count("*").alias("cut"))
    size = groups.groupBy(*by, "group").agg(F.count("*").alias("size"))
    d = size.join(cut, [*by, "group"], "left")
    return d.groupBy(*by).agg(F.sum(F.coalesce("cut", F.lit(0)) / F.col("size")).alias("ratio_cut"))


def prefix_cuts(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Modularity and ratio cut of every cut of a chain into a first part and the rest.

    ``nodes`` has by, node, seq (from 1). An edge lies across the cuts from its lower place to the
    one before its higher place, so running sums of its ends give all cuts at once.
    """
    seq = nodes.select(*by, "node", "seq")
    a, b = seq.select(*by, F.col("node").alias("src"), F.col("seq").alias("s1")), seq.select(*by, F.col("node").alias("dst"), F.col("seq").alias("s2"))
    placed = edges.join(a, [*by, "src"]).join(b, [*by, "dst"])
    low, high = F.least("s1", "s2"), F.greatest("s1", "s2")
    ends = placed.select(*by, F.explode(F.array(F.struct(low.alias("seq"), F.lit(1).alias("opens"), F.lit(0).alias("closes")), F.struct(high.alias("seq"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))).alias("x"))
    at = ends.select(*by, "x.*").groupBy(*by, "seq").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    d = seq.join(at, [*by, "seq"], "left").fillna(0, ["opens", "closes"])
    w = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    d = d.select(*by, "seq", F.sum("opens").over(w).alias("o"), F.sum("closes").over(w).alias("c"), F.sum("opens").over(all_).alias("m"), F.count("*").over(all_).alias("n"))
    m, cut = F.col("m"), F.col("o") - F.col("c")
    left, right = F.col("o") + F.col("c"), 2 * m - F.col("o") - F.col("c")
    q = (F.col("m") - cut) / m - F.pow(left / (2 * m), F.lit(2)) - F.pow(right / (2 * m), F.lit(2))
    return d.where("seq < n and m > 0").select(*by, "seq", cut.alias("cut"), q.alias("modularity"), (cut / F.col("seq") + cut / (F.col("n") - F.col("seq"))).alias("ratio_cut"))


def _top_of_modularity(curve: DataFrame, by: list[str], half: int) -> DataFrame:
    """``by, seq``: the cut at the best local maximum above 0 of the smoothed curve."""
    smooth = runs.smoothed(curve.select(*by, "seq", "modularity"), by, "seq", "modularity", half)
    return runs.best(runs.local_maxima(smooth, by, "seq", "smooth"), by, "seq", "smooth").select(*by, "seq")


def _least_ratio(curve: DataFrame, by: list[str], limit: float) -> DataFrame:
    """``by, seq``: the first cut of least ratio, if that is below the limit and not after the first node."""
    least = curve.groupBy(*by).agg(F.min(F.struct("ratio_cut", "seq")).alias("_b"))
    return least.select(*by, "_b.seq", "_b.ratio_cut").where((F.col("seq") > 1) & (F.col("ratio_cut") < limit)).select(*by, "seq")


def chain_domains(nodes: DataFrame, edges: DataFrame, by: list[str], half: int = 3) -> DataFrame:
    """``by, node, domain``: chains cut again and again at the best local maximum of their smoothed curve.

    Cuts need a maximum above 0.
    """
    return _divided(nodes, edges, by, partial(_top_of_modularity, half=half))


def ratio_cut_domains(nodes: DataFrame, edges: DataFrame, by: list[str], limit: float = 5.0) -> DataFrame:
    """``by, node, domain``: chains cut again and again where the ratio cut is least and below the limit."""
    return _divided(nodes, edges, by, partial(_least_ratio, limit=limit))


def _divided(nodes: DataFrame, edges: DataFrame, by: list[str], best: Callable[..., DataFrame]) -> DataFrame:
    """Domains of chains, cut where ``best`` says; all parts of all chains are cut at once, round by round.

    A part is named by its first place. Parts without a cut are put aside, so that a round reads and writes only those
    that the round before has cut; rounds' tables go when the result is written.
    """
    keys = [*by, "lo"]

    def build() -> DataFrame:
        start = nodes.groupBy(*by).agg(F.min("seq").alias("lo"))
        open_ = materialize(nodes.select(*by, "node", "seq").join(start, by).select(*by, "node", "seq", "lo"), "nodes")
        closed = []
        while True:
            a = open_.select(*by, F.col("node").alias("src"), F.col("lo").alias("lo"))
            b = open_.select(*by, F.col("node").alias("dst"), F.col("lo").alias("_lo2"))
            inner = edges.select(*by, "src", "dst").join(a, [*by, "src"]).join(b, [*by, "dst"]).where("lo = _lo2").select(*keys, "src", "dst")
            curve = prefix_cuts(open_.select(*keys, "node", (F.col("seq") - F.col("lo") + 1).alias("seq")), inner, keys)
            cuts = materialize(best(curve, keys).select(*keys, (F.col("lo") + F.col("seq")).alias("_at")), "cuts")
            closed.append(open_.join(cuts, keys, "left_anti").select(*by, "node", "lo"))
            if cuts.isEmpty():
                break
            cut = open_.join(cuts, keys)
            open_ = materialize(cut.select(*by, "node", "seq", F.when(F.col("seq") >= F.col("_at"), F.col("_at")).otherwise(F.col("lo")).alias("lo")), "nodes")
        number = F.dense_rank().over(Window.partitionBy(*by).orderBy("lo")) - 1
        return reduce(DataFrame.unionByName, closed).select(*by, "node", number.alias("domain"))

    return finished(nodes.sparkSession, build, "divided")
