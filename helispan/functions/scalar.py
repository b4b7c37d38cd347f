"""Scalar kernels as column expressions: angle codes, scores, residue numbers, indices, colours.

Operator ids of the survey: F1-F12, F21-F24, F28, F29.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score of segments whose types differ.
MISMATCH = -99999.0
#: Diagonal codes by segment type, and their numbers in numeric matrices.
DIAGONAL = {"strand": "e ", "alpha": "xa", "310": "xg", "pi": "xi"}
DIAGONAL_NUMBER = {"strand": 0, "alpha": 1, "pi": 2, "310": 3}


def angle_code(omega: Column) -> Column:
    """Two-letter code of an angle in (-pi, pi] (F1); ``??`` outside, null for null or NaN."""
    q, h, t = math.pi / 4, math.pi / 2, 3 * math.pi / 4
    first = F.when((omega > -q) & (omega <= q), "P").when((omega > q) & (omega <= t), "R").when((omega > -t) & (omega <= -q), "L").otherwise("O")
    second = F.when((omega > 0) & (omega <= h), "D").when(omega > h, "T").when(omega <= -h, "S").otherwise("E")
    inside = (omega > -math.pi) & (omega <= math.pi)
    return F.when(F.isnan(omega), F.lit(None)).when(inside, F.concat(first, second)).when(omega.isNotNull(), "??")


def paired_code(code: Column, both_strands: Column, same_sheet: Column) -> Column:
    """Codes of strands of one sheet (F2): O becomes HH, P becomes KK; a bad code becomes PE."""
    fixed = F.when(code == "??", "PE").otherwise(code)
    return F.when(both_strands & same_sheet, F.when(fixed.startswith("O"), "HH").when(fixed.startswith("P"), "KK").otherwise(fixed)).otherwise(fixed)


def is_code(code: Column) -> Column:
    """Whether a string is a pair's code, not a diagonal's."""
    return code.rlike("^(?:[LRPO][EDST]|HH|KK)$")


def score_codes(a: Column, b: Column) -> Column:
    """2 for equal codes, 1 for one equal letter, else -2."""
    same = [F.substring(a, k, 1) == F.substring(b, k, 1) for k in (1, 2)]
    return F.when(same[0] & same[1], 2).when(same[0] | same[1], 1).otherwise(-2)


def score_codes_typed(a: Column, b: Column) -> Column:
    """As ``score_codes`` for pairs' codes; diagonals count 0 if equal and MISMATCH if not."""
    return F.when(is_code(a) & is_code(b), score_codes(a, b).cast("double")).when(a == b, 0.0).otherwise(MISMATCH)


def score_radians(a: Column, b: Column) -> Column:
    """pi/4 less the smaller angle between two."""
    d = F.abs(a - b)
    return F.lit(math.pi / 4) - F.least(d, F.lit(2 * math.pi) - d)


def score_degrees(a: Column, b: Column) -> Column:
    """45 less the smaller angle, of angles in radians."""
    d = F.abs(F.degrees(a) - F.degrees(b))
    return F.lit(45.0) - F.least(d, F.lit(360.0) - d)


def diagonal_code(kind: Column) -> Column:
    """Code of a segment type on the diagonal (F8)."""
    return reduce(lambda c, k: c.when(kind == k, DIAGONAL[k]), DIAGONAL, F.when(F.lit(False), ""))


def diagonal_number(kind: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == k, DIAGONAL_NUMBER[k]), DIAGONAL_NUMBER, F.when(F.lit(False), 0))


def residue(text: Column) -> Column:
    """``resnum, icode`` of a residue number with an optional insertion code (F9); ordering the struct orders residues."""
    icode = F.regexp_extract(text, r"^(-?\d+)(\D?)$", 2)
    return F.struct(F.regexp_extract(text, r"^(-?\d+)(\D?)$", 1).try_cast("int").alias("resnum"), F.when(icode != "", icode).alias("icode"))


def residue_text(res: Column, with_icode: bool = True) -> Column:
    """A residue number as text."""
    number = res["resnum"].cast("string")
    return F.concat(number, F.coalesce(res["icode"], F.lit(""))) if with_icode else number


def chain_id(raw: Column) -> Column:
    """One blank, '-' or '0' for a chain without a name becomes '-' (F28)."""
    return F.when(F.trim(raw).isin("", "-", "0"), "-").otherwise(F.trim(raw))


def repaired_sid(sid: Column) -> Column:
    """A domain id's first g as d, and a blank chain as a."""
    return F.regexp_replace(F.regexp_replace(sid, "^g", "d"), "^(.{5})_", "$1a")


def packed_index(i: Column, j: Column) -> Column:
    """Place of a pair of 0-based numbers in a packed upper triangle, in either order."""
    low, high = F.least(i, j), F.greatest(i, j)
    return (low + high * (high + 1) / 2).cast("long")


def flat_index(sizes: list[int], *at: Column) -> Column:
    """Row-major number of a place in an array of these sizes."""
    out = at[0]
    for size, x in zip(sizes[1:], at[1:], strict=True):
        out = out * size + x
    return out


def hsv_to_hex(hue: Column, saturation: float = 1.0, value: float = 1.0) -> Column:
    """Hex colour of a hue in degrees."""
    h = F.pmod(hue, F.lit(360.0)) / 60
    sector, f = F.floor(h).cast("int"), h - F.floor(h)
    p = F.lit(value * (1 - saturation))
    q, t = F.lit(value) * (1 - saturation * f), F.lit(value) * (1 - saturation * (1 - f))
    v = F.lit(value)
    rows = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]

    def pick(k: int) -> Column:
        return reduce(lambda c, n: c.when(sector == n, rows[n][k]), range(1, 6), F.when(sector == 0, rows[0][k]))

    return F.format_string("%02x%02x%02x", *[F.floor(pick(k) * 255 + 0.5).cast("int") for k in range(3)])


def gradient(rank: Column, count: Column) -> Column:
    """Colour of place ``rank`` (from 0) of ``count``, from blue (hue 240) down to red."""
    return hsv_to_hex(F.lit(240.0) - rank * (F.lit(240.0) / count))


def palette(colours: list[str], number: Column) -> Column:
    """A colour of a repeating palette."""
    return F.element_at(F.array(*map(F.lit, colours)), (F.pmod(number, F.lit(len(colours))) + 1).cast("int"))


#: The colours of groups, in their order.
COLOURS = ["ff0000", "0000ff", "00ff00", "ffa500", "800080", "00ffff", "ffc0cb", "808000", "008080", "a52a2a"]


def from_flat_index(sizes: list[int], number: Column) -> list[Column]:
    """The place in an array of these sizes that has a row-major number: the inverse of ``flat_index``."""
    out, left = [], number
    for size in reversed(sizes[1:]):
        out.append(F.pmod(left, F.lit(size)).cast("long"))
        left = F.floor(left / size)
    return [left.cast("long"), *reversed(out)]


def from_packed_index(number: Column) -> Column:
    """``i, j`` of a place in a packed upper triangle."""
    j = F.floor((F.sqrt(8.0 * number + 1) - 1) / 2).cast("long")
    return F.struct((number - (j * (j + 1) / 2).cast("long")).cast("long").alias("i"), j.alias("j"))


def hex_to_rgb(colour: Column) -> Column:
    """``r, g, b`` from 0 to 1 of a hex colour (F23); null if it is none."""
    part = lambda k: F.conv(F.substring(colour, 2 * k + 1, 2), 16, 10).cast("int") / F.lit(255.0)
    return F.when(colour.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b")))


def colour_list(names: Column) -> Column:
    """Hex colours of a comma-separated list, in order, without what is none."""
    return F.filter(F.transform(F.split(names, ","), lambda x: F.lower(F.trim(x))), lambda x: x.rlike("^[0-9a-f]{6}$"))


def blank_to_null(x: Column) -> Column:
    """A character, or null for a blank."""
    return F.when(F.trim(x) != "", x)
