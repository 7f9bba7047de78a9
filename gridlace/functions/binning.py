"""Column builders: grid cells of planar points, and the centres of cells.

FLOAT columns keep 32-bit arithmetic where a 32-bit engine would (Spark divides in DOUBLE): casts mark those
places. Nothing here touches rows, so every plan stays within code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ways to turn an offset coordinate into a cell: floor of the quotient, or floor division by remainder.
MODES = ("floor", "floordiv")


def check_positive(value: float, name: str) -> float:
    if not (isinstance(value, int | float) and math.isfinite(value) and value > 0):
        raise ValueError(f"{name} must be positive and finite, not {value!r}")
    return float(value)


def cell(v: Column, size: float, mode: str = "floor", single: bool = False) -> Column:
    """Cell (BIGINT) of an offset coordinate: left edge inside, right edge outside. single: v is FLOAT."""
    size = check_positive(size, "resolution")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    width = F.lit(size).cast("float") if single else F.lit(size)
    if mode == "floor":
        quotient = v / width
        return F.floor(quotient.cast("float") if single else quotient).cast("bigint")
    return F.rint((v - v % width) / width).cast("bigint")


def hex_cell(x: Column, y: Column, size: float, single: bool = False) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-topped hexagon that holds (x, y); size is the distance of neighbouring centres.

    Half-even rounding of cube coordinates; the one with the largest error is recomputed, q before r before s."""
    size = check_positive(size, "resolution")
    root = F.sqrt(F.lit(3.0))
    side = F.lit(size) / root
    q = (root * x - y) / (F.lit(3.0) * side)
    part = (F.lit(2.0) / F.lit(3.0)).cast("float") * y if single else (F.lit(2.0) / F.lit(3.0)) * y
    r = part.cast("double") / side
    s = -q - r
    q0, r0, s0 = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(q0 - q), F.abs(r0 - r), F.abs(s0 - s)
    by_q = (dq >= dr) & (dq >= ds)
    by_r = ~by_q & (dr >= ds)
    return F.when(by_q, -r0 - s0).otherwise(q0).cast("bigint"), F.when(by_r, -q0 - s0).otherwise(r0).cast("bigint")


def square_center(b: Column, size: float, origin: Column | float) -> Column:
    size = check_positive(size, "resolution")
    origin = origin.cast("double") if isinstance(origin, Column) else F.lit(float(origin))
    return (b.cast("double") + F.lit(0.5)) * F.lit(size) + origin


def hex_center(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    size = check_positive(size, "resolution")
    root = F.sqrt(F.lit(3.0))
    side = F.lit(size) / root
    return side * (root * q.cast("double") + root / F.lit(2.0) * r.cast("double")), side * F.lit(1.5) * r.cast("double")


def _spread(v: Column) -> Column:
    """The low 32 bits of v with a zero bit before each."""
    v = v.bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_order(x: Column, y: Column) -> Column:
    """Place (BIGINT) of integer cells along a Z-shaped curve: neighbours in the plane are mostly near each other in this order.

    Cells of 31 bits and a sign are told apart; others share places, which costs locality alone."""
    bits = [_spread(F.least(F.greatest(v, F.lit(-(2**30))), F.lit(2**30 - 1)) + F.lit(2**30)) for v in (x, y)]
    return bits[0].bitwiseOR(F.shiftleft(bits[1], 1))
