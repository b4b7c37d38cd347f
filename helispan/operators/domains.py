"""Decompositions into domains: overlap scores, summaries, sweeps, segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Overlap above which an assignment counts as correct.
CORRECT = 0.75


def overlap_counts(found: DataFrame, reference: DataFrame, by: list[str], residue: str) -> DataFrame:
    """Residues that each found domain shares with each reference domain."""
    a = found.select(*by, residue, F.col("domain").alias("found"))
    b = reference.select(*by, residue, F.col("domain").alias("reference"))
    return a.join(b, [*by, residue]).groupBy(*by, "found", "reference").agg(F.count("*").alias("shared"))


def _best_assignment(weight: np.ndarray) -> float:
    """Largest sum of a one-to-one assignment of rows to columns, by shortest augmenting paths."""
    n = max(weight.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : weight.shape[0] + 1, 1 : weight.shape[1] + 1] = -weight
    u, v, row_of, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            slack = cost[row_of[j0]] - u[row_of[j0]] - v
            slack[0] = np.inf
            better = ~used & (slack < least)
            least[better], way[better] = slack[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, least)))
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0], j0 = row_of[way[j0]], way[j0]
    return float(sum(-cost[row_of[j], j] for j in range(1, n + 1)))


def overlap_scores(found: DataFrame, reference: DataFrame, by: list[str], residue: str) -> DataFrame:
    """``by, n_found, n_reference, score``: shared residues under the best pairing of domains, by all residues.

    Where the numbers of domains differ the score is 0. A structure's table of shared residues, domains
    by domains, is what one task holds.
    """
    count = lambda d, name: d.groupBy(*by).agg(F.count_distinct("domain").alias(name))
    span = found.select(*by, residue).unionByName(reference.select(*by, residue)).distinct().groupBy(*by).agg(F.count("*").alias("span"))
    numbers = count(found, "n_found").join(count(reference, "n_reference"), by).join(span, by)
    table = overlap_counts(found, reference, by, residue)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*by).schema)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = pdf.pivot_table(index="found", columns="reference", values="shared", aggfunc="sum", fill_value=0).to_numpy(float)
        return pdf[by].head(1).assign(matched=_best_assignment(weight))

    matched = table.groupBy(*by).applyInPandas(assign, f"{fields}, matched double")
    d = numbers.join(matched, by, "left")
    score = F.when(F.col("n_found") == F.col("n_reference"), F.coalesce("matched", F.lit(0.0)) / F.col("span")).otherwise(0.0)
    return d.select(*by, "n_found", "n_reference", score.alias("score"))


def summary(scored: DataFrame, group: str) -> DataFrame:
    """By number of reference domains and in total (null): rows, mean score, under-, over- and correctly cut."""
    under, over = F.col("n_found") < F.col("n_reference"), F.col("n_found") > F.col("n_reference")
    right = (F.col("n_found") == F.col("n_reference")) & (F.col("score") > CORRECT)
    return scored.rollup(group).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count_if(under).alias("undercut"), F.count_if(over).alias("overcut"), F.count_if(right).alias("correct"))


def sweep(df: DataFrame, thresholds: list[float], group: str, value: str, measure: Column, groups: list) -> DataFrame:
    """``threshold`` and, for each group, the measure over rows with a value of at least it.

    Thresholds are a short list, so each row is repeated for those it reaches and the groups become columns.
    """
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(value) >= t)
    return df.withColumn("threshold", F.explode(reached)).groupBy("threshold").pivot(group, groups).agg(measure)


def home_domains(parts: DataFrame, by: list[str], segment: str, domain: str, residues: str) -> DataFrame:
    """The domain that holds most residues of a segment that crosses a boundary, the first of equals."""
    each = parts.groupBy(*by, segment, domain).agg(F.sum(residues).alias("_n"))
    return each.groupBy(*by, segment).agg(F.min_by(domain, F.struct(-F.col("_n"), F.col(domain))).alias(domain))


def without(intervals: DataFrame, lo: str, hi: str, cut_lo: Column, cut_hi: Column) -> DataFrame:
    """Intervals less another, in one piece or two."""
    left = F.struct(F.col(lo).alias("lo"), F.least(F.col(hi), cut_lo - 1).alias("hi"))
    right = F.struct(F.greatest(F.col(lo), cut_hi + 1).alias("lo"), F.col(hi).alias("hi"))
    apart = (F.col(hi) < cut_lo) | (F.col(lo) > cut_hi)
    parts = F.when(apart, F.array(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi")))).otherwise(F.filter(F.array(left, right), lambda x: x["lo"] <= x["hi"]))
    rest = [c for c in intervals.columns if c not in (lo, hi)]
    return intervals.select(*rest, F.inline(parts)).withColumnsRenamed({"lo": lo, "hi": hi})


def domain_text(segments: DataFrame, by: list[str]) -> DataFrame:
    """``n domains: c:lo-c:hi;.../...`` of a structure's domain, chain, lo, hi rows."""
    piece = F.format_string("%s:%d-%s:%d", "chain", "lo", "chain", "hi")
    rows = segments.groupBy(*by, "domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chain", "lo", piece.alias("t")))), lambda x: x["t"]), ";").alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("domain", "t"))), lambda x: x["t"]), "/")
    return rows.groupBy(*by).agg(F.concat(F.count("*").cast("string"), F.lit(" domains: "), text).alias("line"))
