"""Axes of segments from their atoms, and matrices of the angles between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helispan.functions import geometry, scalar
from helispan.operators.pairs import sides


def fit_axis(points: np.ndarray, helix: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Centre and unit direction of a segment's axis, from its first to its last residue (A1, A2).

    A helix's axis runs through means of neighbouring atoms, (before + after) / 2 moved halfway to the
    atom between, a strand's through midpoints of consecutive atoms; it is the first singular direction
    about the centre. None for fewer than three atoms of a helix or two of a strand.
    """
    n = len(points)
    if n < (3 if helix else 2):
        return None
    if helix:
        middle = points[1:-1] + ((points[:-2] - points[1:-1]) + (points[2:] - points[1:-1])) / 2
        centre = middle.mean(axis=0)
    else:
        middle = (points[1:] + points[:-1]) / 2
        centre = points.mean(axis=0)
    if len(middle) >= 2:
        direction = np.linalg.svd(middle - centre)[2][0] if len(middle) > 2 else middle[-1] - middle[0]
    else:
        direction = points[-1] - points[0]
    if direction @ (points[-1] - points[0]) < 0:
        direction = -direction
    size = np.linalg.norm(direction)
    return (centre, direction / size) if size > geometry.EPS else None


def axes(atoms: DataFrame, by: list[str]) -> DataFrame:
    """``by, seg, kind, centre, direction`` of atoms with by, seg, kind (helix kinds or strand), ord, x, y, z.

    A segment's atoms, a few dozen, are what one group holds; null axes are kept.
    """
    keys = [*by, "seg", "kind"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in atoms.select(*keys).schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        found = fit_axis(pdf[["x", "y", "z"]].to_numpy(float), pdf.kind.iloc[0] != "strand")
        out = pdf[keys].head(1).copy()
        for k, name in enumerate(("cx", "cy", "cz", "dx", "dy", "dz")):
            out[name] = None if found is None else float(found[k // 3][k % 3])
        return out

    d = atoms.groupBy(*keys).applyInPandas(fit, f"{fields}, cx double, cy double, cz double, dx double, dy double, dz double")
    missing = F.col("cx").isNull()
    return d.select(*keys, F.when(~missing, geometry.vec(F.col("cx"), F.col("cy"), F.col("cz"))).alias("centre"), F.when(~missing, geometry.vec(F.col("dx"), F.col("dy"), F.col("dz"))).alias("direction"))


def matrices(fitted: DataFrame, by: list[str]) -> DataFrame:
    """``by, i, j, omega, code, dist`` for i <= j: angle, its code and centre distance; types on the diagonal.

    ``fitted`` has seg, the 0-based place of a segment, and may have ``sheet``; strands of one sheet get
    paired codes.
    """
    d = fitted if "sheet" in fitted.columns else fitted.withColumn("sheet", F.lit(None).cast("string"))
    pairs = sides(d, by, "a_").join(sides(d, by, "b_"), by).where("a_seg <= b_seg")
    own = F.col("a_seg") == F.col("b_seg")
    pairs = geometry.axis_angles(pairs, "a_centre", "a_direction", "b_centre", "b_direction", "_angle")
    strands = (F.col("a_kind") == "strand") & (F.col("b_kind") == "strand")
    pairs = pairs.withColumn("omega", F.when(own, scalar.diagonal_number(F.col("a_kind")).cast("double")).otherwise(F.col("_angle")))
    code = scalar.paired_code(F.coalesce(scalar.angle_code(F.col("omega")), F.lit("??")), strands, F.coalesce(F.col("a_sheet") == F.col("b_sheet"), F.lit(False)))
    dist = F.when(own, scalar.diagonal_number(F.col("a_kind")).cast("double")).otherwise(geometry.distance(F.col("a_centre"), F.col("b_centre")))
    return pairs.select(*by, F.col("a_seg").alias("i"), F.col("b_seg").alias("j"), "omega", F.when(own, scalar.diagonal_code(F.col("a_kind"))).otherwise(code).alias("code"), dist.alias("dist"))
