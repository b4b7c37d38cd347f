"""Sheets of strands and the sizes and ends of structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sheet_sizes(strands: DataFrame, by: list[str], sheet: str, lo: str, hi: str) -> DataFrame:
    """``by, sheet, size, strands``: residues and strands of each sheet (A3)."""
    return strands.groupBy(*by, sheet).agg(F.sum(F.col(hi) - F.col(lo) + 1).alias("size"), F.count("*").alias("strands"))


def largest(df: DataFrame, by: list[str], name: str, size: str) -> DataFrame:
    """The largest of each structure, the one of the least name among equals (A3, A4)."""
    best = F.min(F.struct((-F.col(size)).alias("s"), F.col(name).alias("n")))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.n").alias(name), (-F.col("_b.s")).alias(size))


def largest_part(sheets: DataFrame, helices: DataFrame, by: list[str], name: str, size: str) -> DataFrame:
    """Each structure's largest sheet, or its largest helix where it has no sheet (A5)."""
    a, b = largest(sheets, by, name, size), largest(helices, by, name, size)
    rest = b.join(a.select(*by), by, "left_anti")
    return a.withColumn("kind", F.lit("sheet")).unionByName(rest.withColumn("kind", F.lit("helix")))


def chain_ends(residues: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """First and last residue of each chain."""
    return residues.groupBy(*by).agg(F.min(lo).alias("first"), F.max(hi).alias("last"))


def outermost(df: DataFrame, by: list[str], order: str, name: str, visible: Column) -> DataFrame:
    """The first and the last visible segment of each chain."""
    d = df.where(visible)
    return d.groupBy(*by).agg(F.min_by(name, order).alias("nterm"), F.max_by(name, order).alias("cterm"))


def extreme_bonds(bonds: DataFrame, by: list[str], own: str, partner: str) -> DataFrame:
    """Least and greatest bonded residue towards each neighbour, with their partners."""
    pair = F.struct(own, partner)
    return bonds.groupBy(*by).agg(F.min(pair).alias("low"), F.max(pair).alias("high"))


def opposite_sides(angles: DataFrame, by: list[str], angle: str) -> DataFrame:
    """Mean absolute angle, and whether it is above a right angle; no angles mean the same side."""
    mean = F.avg(F.abs(F.col(angle)))
    return angles.groupBy(*by).agg(mean.alias("angle"), F.coalesce(mean > F.lit(3.141592653589793 / 2), F.lit(False)).alias("opposite"))


def nearer_top(at: Column, lo: Column, hi: Column, is_reversed: Column) -> Column:
    """Whether a residue is in the half of a segment that is drawn at the top."""
    late = at > (lo + hi) / 2
    return F.when(is_reversed, ~late).otherwise(late)


def orientation(code: Column, reference_sideways: Column, reference_reversed: Column) -> Column:
    """``sideways, reversed`` of an element from its code towards a reference.

    Crossing codes (L, R) turn an element sideways of its reference; all but the parallel ones (P, K)
    reverse it.
    """
    letter = F.substring(code, 1, 1)
    sideways = letter.isin("L", "R") != reference_sideways
    turned = ~letter.isin("P", "K") != reference_reversed
    return F.struct(sideways.alias("sideways"), turned.alias("reversed"))


def neighbours_in_sequence(strands: DataFrame, by: list[str], order: str, sheet: str) -> DataFrame:
    """Adds ``part``: runs of strands of one sheet that follow each other in the chain."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(sheet).over(w).eqNullSafe(F.col(sheet)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return strands.withColumn("_new", new).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def axis_overlaps(strands: DataFrame, by: list[str], offset: str, span: str) -> DataFrame:
    """Strands of one axis that begin before the end, and one place more, of an earlier one."""
    w = Window.partitionBy(*by).orderBy(offset, span)
    reach = F.max(F.col(offset) + F.col(span) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return strands.withColumn("_reach", reach).where(F.col("_reach") > F.col(offset)).drop("_reach")
