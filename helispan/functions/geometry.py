"""Vectors in space as structs ``x, y, z``: lines, projections, distances and angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths below this count as none.
EPS = 1e-8
#: Distances below this part of the points' own sizes are rounding.
ROUNDING = 1e-14
_AXES = ("x", "y", "z")


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def sub(a: Column, b: Column) -> Column:
    return vec(*[a[k] - b[k] for k in _AXES])


def along(a: Column, u: Column, d: Column) -> Column:
    """a + u d."""
    return vec(*[a[k] + u * d[k] for k in _AXES])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance (F17-F19); null where a point is missing."""
    return norm(sub(a, b))


def project(a: Column, b: Column, p: Column) -> Column:
    """The point of the line through a and b that is nearest to p (F14); null if a is b."""
    d = sub(b, a)
    return F.when(dot(d, d) > EPS * EPS, along(a, dot(sub(p, a), d) / dot(d, d), d))


def closest(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """``pa, pb, mua, mub``: where the lines p1 p2 and p3 p4 come closest (F13); null for parallel or empty lines."""
    return closest_axes(p1, sub(p2, p1), p3, sub(p4, p3))


def closest_axes(p: Column, a: Column, q: Column, b: Column, least: float = EPS) -> Column:
    """``pa, pb, mua, mub``: where the lines from p in direction a and from q in direction b come closest.

    Null for parallel or empty lines: ``least`` bounds squared lengths and their determinant as they are, which is the format's own rule for
    directions of about unit length. Directions of any length are given 0, so that only lines that are exactly parallel have none.
    """
    c = sub(p, q)
    aa, bb, ab = dot(a, a), dot(b, b), dot(a, b)
    det = aa * bb - ab * ab
    mua = (dot(c, b) * ab - dot(c, a) * bb) / det
    mub = (dot(c, b) + ab * mua) / bb
    found = F.struct(along(p, mua, a).alias("pa"), along(q, mub, b).alias("pb"), mua.alias("mua"), mub.alias("mub"))
    return F.when((aa > least) & (bb > least) & (F.abs(det) > least), found)


def dihedral(a: Column, b: Column, c: Column, d: Column, bounded: bool = True) -> Column:
    """Signed angle about b c between the planes a b c and b c d, in (-pi, pi].

    Null where three points are on a line, that is where a normal is nothing beside the lengths that it comes
    from, and where b and c are one point up to rounding. A short line from b to c is fine. Not ``bounded``, only normals of no length give null.
    """
    v1, v2, v3 = sub(b, a), sub(c, b), sub(d, c)
    n1, n2 = cross(v1, v2), cross(v2, v3)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(n1, n2) / (norm(n1) * norm(n2)))))
    plane = (norm(n1) > EPS * norm(v1) * norm(v2)) & (norm(n2) > EPS * norm(v2) * norm(v3)) & (norm(v2) > ROUNDING * (norm(b) + norm(c)))
    if not bounded:
        plane = (norm(n1) > 0) & (norm(n2) > 0)
    return F.when(plane, F.when(dot(n1, v3) < 0, -angle).otherwise(angle))


def axis_angles(df: DataFrame, centre1: str, direction1: str, centre2: str, direction2: str, name: str, least: float = EPS) -> DataFrame:
    """Adds the relative angle of two axes about the line between their closest points (F15); null for parallel axes.

    ``least`` is that of ``closest_axes``; 0 lifts the bounds of ``dihedral`` too. The points are columns of their own on the way: one
    expression for all would hold each many times over.
    """
    one = F.lit(1.0)
    c1, d1, c2, d2 = map(F.col, (centre1, direction1, centre2, direction2))
    d = df.withColumn("_near", closest_axes(c1, d1, c2, d2, least))
    d = d.withColumn("_p", along(F.col("_near.pa"), one, d1)).withColumn("_q", along(F.col("_near.pb"), one, d2))
    angle = F.when(F.col("_near").isNotNull(), dihedral(F.col("_p"), F.col("_near.pa"), F.col("_near.pb"), F.col("_q"), least > 0))
    return d.withColumn(name, angle).drop("_near", "_p", "_q")


def three_axes_angle(df: DataFrame, axes: list[tuple[str, str]], name: str, least: float = EPS) -> DataFrame:
    """Adds the signed angle between the planes of the first and second and of the second and third axis (F16).

    ``axes`` are pairs of columns of centres and directions. The planes hold the shortest lines from the
    second axis to the others; null where one of those is parallel to it. ``least`` is that of ``axis_angles``.
    """
    (c1, d1), (c2, d2), (c3, d3) = [(F.col(c), F.col(v)) for c, v in axes]
    d = df.withColumn("_ab", closest_axes(c1, d1, c2, d2, least)).withColumn("_cd", closest_axes(c2, d2, c3, d3, least))
    angle = F.when(F.col("_ab").isNotNull() & F.col("_cd").isNotNull(), dihedral(F.col("_ab.pa"), F.col("_ab.pb"), F.col("_cd.pa"), F.col("_cd.pb"), least > 0))
    return d.withColumn(name, angle).drop("_ab", "_cd")
