"""Graphs of nodes (node, cx, cy): a distance-bounded self-join, adjacency, degrees and the Laplacian.

The join puts nodes into square cells a little larger than the distance and meets each cell with itself
and its four forward neighbours: an equi-join with a residual distance, every pair once. Cells with more than CROWD nodes
are split: their nodes stand along a Z-order curve, runs of CROWD of it are blocks with a bounding box, as the leaves of a quadtree are, and blocks
whose boxes are within the distance meet, each pair of blocks under a key of its own. So no key has more than CROWD nodes on either side,
however many are in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlace.functions import binning
from gridlace.sources import shared

from . import matrix

_FORWARD = ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))
#: Cells are larger than the distance by this, so that rounding can't part nodes by two cells.
_SLACK = 1 + 2**-20
#: Nodes of a cell, or of a block, that meet those of another under one key. Parts of a cell's side that the curve tells apart.
CROWD, PARTS = 2048, 2**10


def lattice_bound(spacing: float, max_distance: float) -> int:
    """Nodes that a cell can have if they lie on a square or hexagonal lattice with that spacing, and some more."""
    return math.ceil(1.2 * (max_distance / spacing + 2) ** 2)


def _met(left: DataFrame, right: DataFrame, keys: list[str], r: float) -> DataFrame:
    dx, dy = F.col("ax_") - F.col("bx_"), F.col("ay_") - F.col("by_")
    met = left.join(right, keys).filter((~F.col("own") | (F.col("a") < F.col("b"))) & (dx * dx + dy * dy <= F.lit(r * r)))
    return met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def neighbours(nodes: DataFrame, max_distance: float, densest: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(src, dst), src < dst, of nodes whose distance is at most max_distance (equality counts, no tolerance).

    densest: a known bound on the nodes of a cell (see lattice_bound); without one they are counted."""
    if not math.isfinite(max_distance) or max_distance < 0:
        raise ValueError(f"max_distance must be finite and not negative, not {max_distance!r}")
    nodes = nodes.select("node", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    if max_distance == 0:
        a, b = nodes.select(F.col("node").alias("src"), "cx", "cy"), nodes.select(F.col("node").alias("dst"), "cx", "cy")
        return a.join(b, ["cx", "cy"]).filter("src < dst").select("src", "dst")
    r = float(max_distance)
    kx, ky = (F.floor(F.col(c) / F.lit(r * _SLACK)).cast("bigint") for c in ("cx", "cy"))
    placed = nodes.withColumns({"kx": kx, "ky": ky})
    if densest is None or densest > crowd:
        placed = shared.written(placed)
        dense = placed.groupBy("kx", "ky").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("kx", "ky")
        if not dense.isEmpty():
            return _sparse(placed.join(dense, ["kx", "ky"], "left_anti"), r).unionByName(_crowded(placed, dense, r, crowd))
    return _sparse(placed, r)


def _stepped(left: DataFrame) -> DataFrame:
    """Each row of (kx, ky, ...) at its own cell and the four forward ones; own marks its own."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _FORWARD))
    rest = [c for c in left.columns if c not in ("kx", "ky")]
    own = ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own")
    return left.withColumn("s", F.explode(steps)).select(*rest, (F.col("kx") + F.col("s.i")).alias("kx"), (F.col("ky") + F.col("s.j")).alias("ky"), own)


def _sparse(placed: DataFrame, r: float) -> DataFrame:
    right = placed.select(F.col("node").alias("b"), F.col("cx").alias("bx_"), F.col("cy").alias("by_"), "kx", "ky")
    left = placed.select(F.col("node").alias("a"), F.col("cx").alias("ax_"), F.col("cy").alias("ay_"), "kx", "ky")
    return _met(_stepped(left), right, ["kx", "ky"], r)


def _crowded(placed: DataFrame, dense: DataFrame, r: float, crowd: int) -> DataFrame:
    """Pairs of which one end at least is in a dense cell, by pairs of blocks."""
    part = [F.floor(F.col(c) * F.lit(PARTS / (r * _SLACK))).cast("bigint") for c in ("cx", "cy")]
    many = matrix.dense_ids(placed.join(dense, ["kx", "ky"], "left_semi").withColumn("z", binning.z_order(*part)), "z", "node", "rank")
    many = many.select("node", "cx", "cy", "kx", "ky", F.floor(F.col("rank") / crowd).cast("bigint").alias("block"))
    # sparse cells beside dense ones are blocks as they are
    around = F.explode(F.array(*(F.struct((F.col("kx") + i).alias("kx"), (F.col("ky") + j).alias("ky")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c")
    near = dense.select(around).select("c.kx", "c.ky").distinct().join(dense, ["kx", "ky"], "left_anti")
    few = placed.join(near, ["kx", "ky"], "left_semi").select("node", "cx", "cy", "kx", "ky", F.lit(-1).cast("bigint").alias("block"))
    both = shared.written(many.unionByName(few))
    boxes = both.groupBy("kx", "ky", "block").agg(*(f(c).alias(f"{c}_{n}") for c in ("cx", "cy") for n, f in (("min", F.min), ("max", F.max))))
    boxes = shared.written(boxes)
    left = _stepped(boxes.select(F.struct("kx", "ky", "block").alias("a"), F.struct("cx_min", "cx_max", "cy_min", "cy_max").alias("abox"), "kx", "ky"))
    right = boxes.select(F.struct("kx", "ky", "block").alias("b"), F.struct("cx_min", "cx_max", "cy_min", "cy_max").alias("bbox"), "kx", "ky")
    gap = [F.greatest(F.col(f"abox.{c}_min") - F.col(f"bbox.{c}_max"), F.col(f"bbox.{c}_min") - F.col(f"abox.{c}_max"), F.lit(0.0)) for c in ("cx", "cy")]
    close = gap[0] * gap[0] + gap[1] * gap[1] <= F.lit(r * r)
    known = (F.col("a.block") >= 0) | (F.col("b.block") >= 0)
    pairs = left.join(right, ["kx", "ky"]).filter(close & known & (~F.col("own") | (F.col("a.block") <= F.col("b.block"))))
    pairs = shared.written(pairs.select("a", "b", (F.col("a") == F.col("b")).alias("own")))
    grouped = both.withColumn("g", F.struct("kx", "ky", "block"))
    sides = [
        pairs.withColumn("g", F.col(s)).join(grouped.select("g", F.col("node").alias(f"{s}_"), F.col("cx").alias(f"{s}x_"), F.col("cy").alias(f"{s}y_")), "g").drop("g") for s in "ab"
    ]
    ends = sides[0].select(F.struct("a", "b").alias("pair"), F.col("a_").alias("a"), "ax_", "ay_", "own"), sides[1].select(F.struct("a", "b").alias("pair"), F.col("b_").alias("b"), "bx_", "by_")
    return _met(ends[0], ends[1], ["pair"], r)


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, with value 1."""
    one = F.lit(1.0).cast("float").alias("value")
    return edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), one).unionByName(edges.select(F.col("dst").alias("row"), F.col("src").alias("col"), one))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree) of all nodes, 0 included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(row, col, value): degrees on the diagonal, -1 for each edge; nodes without edges have no entry."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("row")).groupBy("row").agg(F.count("*").cast("double").alias("value"))
    off = adjacency(edges).select("row", "col", F.lit(-1.0).alias("value"))
    return ends.select("row", F.col("row").alias("col"), "value").unionByName(off)


def segments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, x0, y0, x1, y1) for drawing."""
    a = nodes.select(F.col("node").alias("src"), F.col("cx").alias("x0"), F.col("cy").alias("y0"))
    b = nodes.select(F.col("node").alias("dst"), F.col("cx").alias("x1"), F.col("cy").alias("y1"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "x0", "y0", "x1", "y1")


def build_spatial_graph(nodes: DataFrame, max_distance: float) -> tuple[DataFrame, DataFrame]:
    """Adjacency and Laplacian of (node, cx, cy), as rows (row, col, value)."""
    edges = neighbours(nodes, max_distance)
    return adjacency(edges), laplacian(edges)
