"""Evaluation of ranked results against a gold standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helispan.operators.ranks import running


def label_hits(hits: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Adds ``label``, 1 for hits in the gold standard."""
    known = gold.select(key).distinct().withColumn("_gold", F.lit(1))
    return hits.join(known, key, "left").withColumn("label", F.coalesce("_gold", F.lit(0))).drop("_gold")


def missing_hits(entities: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Entities without a hit."""
    return entities.select(key).distinct().join(hits, key, "left_anti")


def fill_bottom(hits: DataFrame, entities: DataFrame, key: str, score: str) -> DataFrame:
    """Hits, and every entity without one at the lowest score of all."""
    low = hits.agg(F.min(score).alias(score))
    rest = missing_hits(entities, hits, key).join(F.broadcast(low))
    return hits.select(key, score).withColumn("filled", F.lit(False)).unionByName(rest.withColumn("filled", F.lit(True)))


def scores(raw: Column, negate: bool = False, log: bool = False) -> Column:
    """A score of a result line (S10, S11): null unless a number; log10 of 0 is -1e308."""
    value = raw.try_cast("double")
    value = F.when(F.isnan(value), F.lit(None)).otherwise(value)
    if log:
        value = F.when(value == 0, F.lit(-1e308)).otherwise(F.log10(value))
    return -value if negate else value


def rank_curve(hits: DataFrame, key: str, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One point for each hit, from the worst on: the true and false positives from it up (W3), for each ``by``.

    Ties count one by one in the order of ``key``. Rates are null where there is no such hit at all.
    """
    before = running(hits.select(*by, key, score, F.col(label).cast("long").alias("label")), [score, key], {"gold": F.col("label"), "rest": 1 - F.col("label")}, by)
    totals = hits.groupBy(*by).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    d = before.join(totals, list(by)) if by else before.join(F.broadcast(totals))
    tp, fp = F.col("p") - F.col("gold"), F.col("q") - F.col("rest")
    return d.select(*by, key, score, "label", tp.alias("tp"), fp.alias("fp"), F.try_divide(tp, "p").alias("tpr"), F.try_divide(fp, "q").alias("fpr"))


def area(hits: DataFrame, key: str, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve by trapezoids, one row for each ``by``.

    Between two points either the rate of true or that of false positives steps, so the area is the
    mean rate of true positives over the hits that are none: no second pass over neighbours is needed.
    """
    curve = rank_curve(hits, key, score, label, by)
    n, p, q = F.count("*"), F.sum("label"), F.sum(1 - F.col("label"))
    # The last hit has no step after it.
    steps = F.sum(F.when((F.col("label") == 0) & (F.col("tp") + F.col("fp") > 1), F.col("tpr"))) / q
    return curve.groupBy(*by).agg(n.alias("n_hits"), p.alias("n_gold"), F.coalesce(steps, F.lit(0.0)).alias("auc"))


def top(hits: DataFrame, key: str, score: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The best ``k`` hits, of each ``by`` (T8); tasks drop what is not among their best before the shuffle."""
    if not by:
        return hits.orderBy(F.desc(score), key).limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    return hits.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def same_group(members: DataFrame, query: DataFrame, key: str, level: str) -> DataFrame:
    """Members that share a query's group at a level, the query aside."""
    of = query.select(F.col(key).alias("query"), F.col(level).alias("_level"))
    return members.join(of, F.col(level) == F.col("_level")).where(F.col(key) != F.col("query")).select("query", key)


def last_value_before(df: DataFrame, by: list[str], order: list[str], when: Column, value: Column) -> Column:
    """Fill-down: the latest ``value`` of a row where ``when`` holds, this one included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(when, value), ignorenulls=True).over(w)
