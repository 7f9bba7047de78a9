"""Points to cells: null policy, offsets, square and hexagonal bins, centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlace.functions import binning


def clean(points: DataFrame) -> DataFrame:
    """Points without null or NaN coordinates and, where there is a gene, without a null one."""
    keep = F.lit(True)
    for c in ("x", "y"):
        keep = keep & F.col(c).isNotNull()
        if points.schema[c].dataType.simpleString() in ("float", "double"):
            keep = keep & ~F.isnan(c)
    if "gene" in points.columns:
        keep = keep & F.col("gene").isNotNull()
    return points.filter(keep)


def is_single(points: DataFrame) -> bool:
    return points.schema["x"].dataType.simpleString() == "float"


def offset(points: DataFrame) -> DataFrame:
    """One row (x_min, y_min)."""
    return points.agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"))


def origin(points: DataFrame) -> tuple[Column, Column]:
    """x_min and y_min as scalar subqueries: worked out once, while the plan runs."""
    both = offset(points).select(F.struct("x_min", "y_min").alias("o")).scalar()
    return both["x_min"], both["y_min"]


def bin_square(points: DataFrame, resolution: float, mode: str = "floor", at: tuple[float, float] | None = None) -> DataFrame:
    """points with bx, by, relative to the smallest coordinates, or to the given ones."""
    points = clean(points)
    x0, y0 = origin(points) if at is None else (F.lit(float(v)) for v in at)
    single = is_single(points) and at is None
    return points.withColumns({"bx": binning.cell(F.col("x") - x0, resolution, mode, single), "by": binning.cell(F.col("y") - y0, resolution, mode, single)})


def bin_hexagonal(points: DataFrame, resolution: float) -> DataFrame:
    """points with axial q, r; the origin is (0, 0), so ids may be negative."""
    points = clean(points)
    q, r = binning.hex_cell(F.col("x"), F.col("y"), resolution, is_single(points))
    return points.withColumns({"q": q, "r": r})


def get_bin_centers(bins: DataFrame, bin_type: str, resolution: float, offset: tuple | None = None) -> DataFrame:
    """bins (bx, by) or (q, r) with cx, cy. offset: two numbers or columns, needed for square bins."""
    if bin_type == "square":
        if offset is None:
            raise ValueError("square bins need the offset (x_min, y_min)")
        return bins.withColumns({"cx": binning.square_center(F.col("bx"), resolution, offset[0]), "cy": binning.square_center(F.col("by"), resolution, offset[1])})
    if bin_type == "hex":
        cx, cy = binning.hex_center(F.col("q"), F.col("r"), resolution)
        return bins.withColumns({"cx": cx, "cy": cy})
    raise ValueError(f"bin_type must be 'square' or 'hex', not {bin_type!r}")
