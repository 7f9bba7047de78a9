"""The same computation over a data set partitioned into square tiles, with results equal to the global ones.

Tiles lie on a lattice from (0, 0), bins on one from the smallest coordinates; a bin may span tiles. The tile that
holds a bin's centre is its home and owns it if it has points; else the smallest tile (by x, then y) with points
in the bin does. Owners, counts and edges are worked out by one global plan: a bin's points meet in
the shuffle, so nothing depends on how wide a border a tile sees.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlace.functions import binning
from gridlace.sources import shared, tileset

from . import graph, matrix
from . import points as P


#: Columns of what is stored; given to readers, as an empty table has no files.
_BINS = "bx bigint, by bigint, cx double, cy double, home_x bigint, home_y bigint, home_active boolean, owner_x bigint, owner_y bigint, run int"
_COUNTS = "bx bigint, by bigint, gene string, n bigint, owner_x bigint, owner_y bigint, run int"
_EDGES = "bx_a bigint, by_a bigint, bx_b bigint, by_b bigint, owner_x bigint, owner_y bigint, run int"
_REDONE = "owner_x bigint, owner_y bigint, run int"
#: Distances are widened by this share of a coordinate, so that rounding can't leave a tile out.
_SLACK = 2.0**-40


def assign_tiles(points: DataFrame, tile_size: float) -> DataFrame:
    """points with tile_x, tile_y (may be negative)."""
    size = binning.check_positive(tile_size, "tile_size")
    return P.clean(points).withColumns({f"tile_{c}": F.floor(F.col(c).cast("double") / F.lit(size)).cast("bigint") for c in "xy"})


def partition_dataset_to_tiles(points: DataFrame, tile_size: float, partition_dir: str, mode: str = "overwrite") -> None:
    """Points by tile under partition_dir, with index, genes and offset (see sources.tileset); what was there is replaced, or with mode
    "append" added to, for which the new points alone are read."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be 'overwrite' or 'append', not {mode!r}")
    tiled = assign_tiles(points.select(F.col("x").cast("double"), F.col("y").cast("double"), "gene"), tile_size)
    tileset.append(tiled, tile_size, partition_dir, replace=mode == "overwrite")


def read_tiles(spark: SparkSession, partition_dir: str) -> DataFrame:
    return tileset.read_points(spark, partition_dir)


def read_offset(spark: SparkSession, partition_dir: str) -> tuple[float, float]:
    return tileset.read_offset(spark, partition_dir)


def read_genes(spark: SparkSession, partition_dir: str) -> DataFrame:
    """(gene, gene_id) of all points."""
    return matrix.gene_ids(tileset.read_genes(spark, partition_dir))


def near_tile(tiled: DataFrame, tile_x: int, tile_y: int, tile_size: float, halo_width: float) -> DataFrame:
    """Rows of the 3 x 3 tiles within halo_width of the tile (edges included), with src_tile_x, src_tile_y."""
    size = binning.check_positive(tile_size, "tile_size")
    ring = F.col("tile_x").between(tile_x - 1, tile_x + 1) & F.col("tile_y").between(tile_y - 1, tile_y + 1)
    box = F.col("x").between(tile_x * size - halo_width, (tile_x + 1) * size + halo_width) & F.col("y").between(tile_y * size - halo_width, (tile_y + 1) * size + halo_width)
    return tiled.filter(ring & box).withColumnsRenamed({"tile_x": "src_tile_x", "tile_y": "src_tile_y"})


def load_tile_with_halo(spark: SparkSession, tile_x: int, tile_y: int, tile_size: float, halo_width: float, partition_dir: str) -> DataFrame:
    """near_tile() of a data set on disk; only files with points in the box are opened."""
    ring = F.col("tile_x").between(tile_x - 1, tile_x + 1) & F.col("tile_y").between(tile_y - 1, tile_y + 1)
    low, high = ([(t + k) * tile_size + s * halo_width for t in (tile_x, tile_y)] for k, s in ((0, -1), (1, 1)))
    box = (F.col("x_max") >= low[0]) & (F.col("x_min") <= high[0]) & (F.col("y_max") >= low[1]) & (F.col("y_min") <= high[1])
    return near_tile(tileset.read_files(spark, partition_dir, tileset.read_index(spark, partition_dir).filter(ring & box)), tile_x, tile_y, tile_size, halo_width)


def tile_cells(tiled: DataFrame, resolution: float, at=None, mode: str = "floor") -> DataFrame:
    """(bx, by, gene, tile_x, tile_y, n, x_min, y_min): counts by bin and tile, written once; all else is made of them."""
    x0, y0 = P.origin(tiled) if at is None else (F.lit(float(v)) for v in at)
    binned = P.bin_square(tiled, resolution, mode, at).groupBy("bx", "by", "gene", "tile_x", "tile_y")
    return shared.written(binned.agg(F.count("*").alias("n"), F.any_value(x0).alias("x_min"), F.any_value(y0).alias("y_min")))


def bin_owners(tiled: DataFrame, tile_size: float, resolution: float, at=None, mode: str = "floor") -> DataFrame:
    """(bx, by, cx, cy, home_x, home_y, home_active, owner_x, owner_y) of every bin with points."""
    return owners_of(tile_cells(tiled, resolution, at, mode), tile_size, resolution)


def owners_of(cells: DataFrame, tile_size: float, resolution: float) -> DataFrame:
    """bin_owners() of tile_cells()."""
    source = F.min(F.struct("tile_x", "tile_y")).alias("source")
    spread = cells.select("bx", "by", "tile_x", "tile_y", "x_min", "y_min").distinct()
    bins = spread.groupBy("bx", "by").agg(source, F.any_value("x_min").alias("x_min"), F.any_value("y_min").alias("y_min"))
    bins = P.get_bin_centers(bins, "square", resolution, (F.col("x_min"), F.col("y_min")))
    bins = bins.withColumns({f"home_{c}": F.floor(F.col(f"c{c}") / F.lit(float(tile_size))).cast("bigint") for c in "xy"})
    active = spread.select(F.col("tile_x").alias("home_x"), F.col("tile_y").alias("home_y"), F.lit(True).alias("home_active")).distinct()
    bins = bins.join(active, ["home_x", "home_y"], "left").withColumn("home_active", F.coalesce("home_active", F.lit(False)))
    owner = [F.when(F.col("home_active"), F.col(f"home_{c}")).otherwise(F.col(f"source.tile_{c}")).alias(f"owner_{c}") for c in "xy"]
    return shared.written(bins.select("bx", "by", "cx", "cy", "home_x", "home_y", "home_active", *owner))


def tile_counts(tiled: DataFrame, tile_size: float, resolution: float, at=None, mode: str = "floor") -> DataFrame:
    """(owner_x, owner_y, bx, by, gene, n): each bin's counts at its owner."""
    cells = tile_cells(tiled, resolution, at, mode)
    return counts_at(cells, owners_of(cells, tile_size, resolution))


def counts_at(cells: DataFrame, owners: DataFrame) -> DataFrame:
    """tile_counts() of tile_cells() and their owners."""
    counts = cells.groupBy("bx", "by", "gene").agg(F.sum("n").alias("n"))
    return counts.join(owners.select("bx", "by", "owner_x", "owner_y"), ["bx", "by"]).select("owner_x", "owner_y", "bx", "by", "gene", "n")


def bin_edges(bins: DataFrame, max_dist: float, resolution: float | None = None) -> DataFrame:
    """(bx_a, by_a, bx_b, by_b) of (bx, by, cx, cy), the smaller bin first; resolution, if it is known, bounds the bins of a cell."""
    nodes = bins.select(F.struct("bx", "by").alias("node"), "cx", "cy")
    e = graph.neighbours(nodes, max_dist, graph.lattice_bound(resolution, max_dist) if resolution else None)
    return e.select(F.col("src.bx").alias("bx_a"), F.col("src.by").alias("by_a"), F.col("dst.bx").alias("bx_b"), F.col("dst.by").alias("by_b"))


def tile_edges(owners: DataFrame, max_dist: float, resolution: float | None = None) -> DataFrame:
    """(owner_x, owner_y, bx_a, by_a, bx_b, by_b): an edge stands at the owner of either end, once for each."""
    edges = bin_edges(owners, max_dist, resolution)
    ends = owners.select("bx", "by", "owner_x", "owner_y")
    sides = [edges.join(ends.withColumnsRenamed({"bx": f"bx_{s}", "by": f"by_{s}"}), [f"bx_{s}", f"by_{s}"]) for s in "ab"]
    names = ["owner_x", "owner_y", "bx_a", "by_a", "bx_b", "by_b"]
    return sides[0].select(*names).unionByName(sides[1].select(*names)).distinct()


def _runs(spark: SparkSession, out_dir: str, sizes: tuple[float, float, float] | None = None, at: tuple[float, float] | None = None) -> list[dict]:
    """Runs whose results count, oldest first; ValueError if they had other sizes or another offset."""
    runs = tileset.entries(spark, f"{out_dir}/log")
    if runs and sizes and tuple(runs[-1]["sizes"]) != sizes:
        raise ValueError(f"results there are for (tile_size, resolution, max_dist) = {tuple(runs[-1]['sizes'])}, not {sizes}")
    if runs and at and tuple(runs[-1]["offset"]) != at:
        raise ValueError("the offset of the points has changed since: all tiles have to be processed")
    return runs


def _write(tiled: DataFrame, sizes: tuple[float, float, float], at: tuple[float, float], out_dir: str, n: int, batch: int, only: DataFrame | None = None) -> None:
    """Results of a run: of all tiles, or of those in only (owner_x, owner_y), which count instead of earlier ones from then on."""
    spark = tiled.sparkSession
    tile_size, resolution, max_dist = sizes
    cells = tile_cells(tiled, resolution, at)
    owners = owners_of(cells, tile_size, resolution)
    for name, df in {"bins": owners, "counts": counts_at(cells, owners), "edges": tile_edges(owners, max_dist, resolution)}.items():
        own = df if only is None else df.join(only, ["owner_x", "owner_y"], "left_semi")
        # bins are looked up by their owners when points are appended: files along the curve have narrow bounds
        own = tileset.along_curve(own, F.col("owner_x"), F.col("owner_y"), "owner_x", "owner_y") if name == "bins" else own.hint("rebalance", "owner_x", "owner_y")
        own.write.mode("overwrite").parquet(f"{out_dir}/{name}/run={n}")
    tileset.enter(spark, f"{out_dir}/log", {"n": n, "full": only is None, "sizes": sizes, "offset": at, "batch": batch})


def process_tiles(spark: SparkSession, tile_size: float, resolution: float, max_dist: float, partition_dir: str, out_dir: str) -> None:
    """Bins, counts and edges of all tiles at once; what was there is replaced."""
    old, batch = _runs(spark, out_dir), tileset.entries(spark, f"{partition_dir}/log")
    tiled = read_tiles(spark, partition_dir)
    _write(tiled, (float(tile_size), float(resolution), float(max_dist)), read_offset(spark, partition_dir), out_dir, old[-1]["n"] + 1 if old else 1, batch[-1]["n"])
    for e in old:
        for name in (f"log/{e['n']}.json", *(f"{x}/run={e['n']}" for x in ("bins", "counts", "edges", "redone"))):
            tileset.delete(spark, f"{out_dir}/{name}")


def _redo(spark: SparkSession, dirty: DataFrame, sizes: tuple[float, float, float], at: tuple[float, float], partition_dir: str, out_dir: str, n: int, batch: int) -> DataFrame:
    """Process the tiles of dirty (owner_x, owner_y) by themselves; files are read that hold tiles within reach of these, and no others."""
    tile_size, resolution, max_dist = sizes
    dirty.distinct().write.mode("overwrite").parquet(f"{out_dir}/redone/run={n}")
    only = spark.read.schema(_REDONE.removesuffix(", run int")).parquet(f"{out_dir}/redone/run={n}")
    ring = 1 + math.ceil((max_dist + 2 * resolution) / tile_size)
    around = [F.explode(F.sequence(F.col(f"owner_{c}") - ring, F.col(f"owner_{c}") + ring)).alias(f"tile_{c}") for c in "xy"]
    near = only.select("owner_y", around[0]).select("tile_x", around[1]).distinct()
    held = tileset.read_index(spark, partition_dir).join(near, ["tile_x", "tile_y"], "left_semi")
    tiled = tileset.read_files(spark, partition_dir, held).join(near, ["tile_x", "tile_y"], "left_semi").select("x", "y", "gene", "tile_x", "tile_y")
    _write(tiled, sizes, at, out_dir, n, batch, only)
    return only


def process_tile_out_of_core(spark: SparkSession, tile_x: int, tile_y: int, tile_size: float, resolution: float, max_dist: float, partition_dir: str, tmp_out_dir: str) -> None:
    """The same for one tile, of which earlier results no longer count; others aren't touched."""
    sizes, at = (float(tile_size), float(resolution), float(max_dist)), read_offset(spark, partition_dir)
    runs = _runs(spark, tmp_out_dir, sizes, at)
    tile = spark.createDataFrame([(tile_x, tile_y)], "owner_x bigint, owner_y bigint")
    _redo(spark, tile, sizes, at, partition_dir, tmp_out_dir, runs[-1]["n"] + 1 if runs else 1, runs[-1]["batch"] if runs else 0)


def process_appended(spark: SparkSession, tile_size: float, resolution: float, max_dist: float, partition_dir: str, out_dir: str) -> DataFrame:
    """Bring results up to date with the points appended since; (owner_x, owner_y) of the tiles that were processed.

    A tile is processed again if it can own a bin that got points, if the owner of a bin can have changed as a tile got its first
    points, or if it can own a bin within max_dist of a new one. All are if the smallest coordinates have changed, as all bins have then, if
    the points were replaced, or if there are no complete results for these sizes. Files of earlier results stay as they are."""
    sizes, at = (float(tile_size), float(resolution), float(max_dist)), read_offset(spark, partition_dir)
    log, runs = tileset.entries(spark, f"{partition_dir}/log"), _runs(spark, out_dir)
    if not runs or not runs[0]["full"] or (tuple(runs[-1]["sizes"]), tuple(runs[-1]["offset"])) != (sizes, at) or log[0]["n"] > runs[-1]["batch"]:
        process_tiles(spark, *sizes, partition_dir, out_dir)
        return results(spark, out_dir, "bins").select("owner_x", "owner_y").distinct()
    done = runs[-1]["batch"]
    if done == log[-1]["n"]:
        return spark.createDataFrame([], "owner_x bigint, owner_y bigint")
    new = P.bin_square(tileset.read_points(spark, partition_dir, done), resolution, at=at).select("bx", "by").distinct()
    new = shared.written(P.get_bin_centers(new, "square", resolution, at))
    # a bin's owner is within half a bin of its centre: of the stored ones those in the box around the new are read
    box = _tiles_within(new.withColumn("reach", F.lit(resolution / 2)), sizes[0]).agg(*(f(f"owner_{c}") for c in "xy" for f in (F.min, F.max))).first()
    inside = F.col("owner_x").between(box[0], box[1]) & F.col("owner_y").between(box[2], box[3])
    known = results(spark, out_dir, "bins").filter(inside).select("bx", "by", F.lit(True).alias("known"))
    bins = new.join(known, ["bx", "by"], "left").withColumn("reach", F.lit(resolution / 2) + F.when(F.col("known"), 0.0).otherwise(sizes[2]))
    index = tileset.read_index(spark, partition_dir)
    tiles_ = index.filter(F.col("batch") > done).select("tile_x", "tile_y").distinct()
    active = tiles_.join(index.filter(F.col("batch") <= done), ["tile_x", "tile_y"], "left_anti")
    half = F.lit(tile_size / 2)
    active = active.select(*((F.col(f"tile_{c}") * F.lit(sizes[0]) + half).alias(f"c{c}") for c in "xy"), (half + F.lit(resolution / 2)).alias("reach"))
    return _redo(spark, _tiles_within(bins.select("cx", "cy", "reach").unionByName(active), sizes[0]), sizes, at, partition_dir, out_dir, runs[-1]["n"] + 1, log[-1]["n"])


def _tiles_within(boxes: DataFrame, tile_size: float) -> DataFrame:
    """(owner_x, owner_y) of the tiles that meet boxes of a reach around (cx, cy)."""
    edge = lambda c, sign: F.floor((F.col(c) + sign * (F.col("reach") + (F.abs(c) + F.col("reach")) * _SLACK)) / F.lit(tile_size)).cast("bigint")
    span = [F.explode(F.sequence(edge(f"c{c}", -1), edge(f"c{c}", 1))).alias(f"owner_{c}") for c in "xy"]
    return boxes.select("cy", "reach", span[0]).select("owner_x", span[1]).distinct()


def results(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """bins, counts or edges as the latest run of each tile has them; FileNotFoundError if there were no runs."""
    runs = _runs(spark, out_dir)
    if not runs:
        raise FileNotFoundError(f"{out_dir}/log")
    kept = F.col("run").between(runs[0]["n"], runs[-1]["n"])
    df = spark.read.schema({"bins": _BINS, "counts": _COUNTS, "edges": _EDGES}[name]).parquet(f"{out_dir}/{name}").filter(kept)
    names = [c for c in df.columns if c != "run"]
    if runs[0]["full"] and len(runs) == 1:
        return df.select(*names)
    redone = spark.read.schema(_REDONE).parquet(f"{out_dir}/redone").filter(kept).groupBy("owner_x", "owner_y").agg(F.max("run").alias("last"))
    return df.join(redone, ["owner_x", "owner_y"], "left").filter("last is null or last = run").select(*names)


def stitch_out_of_core_results(spark: SparkSession, tmp_out_dir: str, resolution: float):
    """(counts: CountMatrix, nodes (node, cx, cy), adjacency, laplacian) of what the tiles wrote; rows in the order of (by, bx)."""
    runs = _runs(spark, tmp_out_dir)
    if not runs:
        raise ValueError(f"no tile results in {tmp_out_dir}")
    at = tuple(runs[-1]["offset"])
    counts = shared.written(results(spark, tmp_out_dir, "counts").select("bx", "by", "gene", "n").distinct())
    bins = matrix.dense_ids(counts.select("bx", "by").distinct(), "by", "bx", "bin_id")
    bins = P.get_bin_centers(bins, "square", resolution, at)
    edges = stitched_edges(results(spark, tmp_out_dir, "edges"), bins)
    out = matrix.CountMatrix(counts, bins, matrix.gene_ids(counts), ("bx", "by"))
    return out, bins.select(F.col("bin_id").alias("node"), "cx", "cy"), graph.adjacency(edges), graph.laplacian(edges)


def stitched_edges(edges: DataFrame, bins: DataFrame) -> DataFrame:
    """(src, dst) by bin_id of edges between bins: canonical, once each."""
    a, b = F.struct(F.col("bx_a").alias("bx"), F.col("by_a").alias("by")), F.struct(F.col("bx_b").alias("bx"), F.col("by_b").alias("by"))
    once = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    once = once.select(F.col("a.bx").alias("bx_a"), F.col("a.by").alias("by_a"), F.col("b.bx").alias("bx_b"), F.col("b.by").alias("by_b"))
    for s, name in (("a", "src"), ("b", "dst")):
        once = once.join(bins.select(F.col("bx").alias(f"bx_{s}"), F.col("by").alias(f"by_{s}"), F.col("bin_id").alias(name)), [f"bx_{s}", f"by_{s}"])
    return once.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
