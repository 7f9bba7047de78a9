"""Tiles on disk: files that are opened, metadata that is merged, and results that are brought up to date."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from gridlace.functions import binning
from gridlace.operators import graph, matrix, tiles
from gridlace.sources import tileset

SCHEMA = "x double, y double, gene string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def cloud(seed, n, low=0.0, high=400.0):
    rng = random.Random(seed)
    return [(rng.uniform(low, high), rng.uniform(low, high), rng.choice("ABCD")) for _ in range(n)]


def stored(at):
    """Data files with the time of their last change."""
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}


def results(spark, out, resolution):
    m, nodes, adjacency, lap = tiles.stitch_out_of_core_results(spark, out, resolution)
    return rows(m.cells, "bin_id", "gene_id", "n"), rows(nodes, "node", "cx", "cy"), rows(adjacency, "row", "col", "value"), rows(lap, "row", "col", "value")


def by_tile(spark, out):
    each = [tiles.results(spark, out, name) for name in ("bins", "counts", "edges")]
    return [rows(df, *sorted(df.columns)) for df in each]


def opened(df):
    return df.select(F.col("_metadata.file_path")).distinct().count()


def test_z_order(spark):
    cells = [(x, y) for x in range(-4, 4) for y in range(-4, 4)]
    df = spark.createDataFrame([*cells, (2**40, 0), (-(2**40), 0)], "x long, y long").withColumn("z", binning.z_order(F.col("x"), F.col("y")))
    got = {(r.x, r.y): r.z for r in df.collect()}
    assert len({got[c] for c in cells}) == 64 and min(got.values()) >= 0
    # each aligned square of two by two is a run of four
    for x in range(-4, 4, 2):
        for y in range(-4, 4, 2):
            four = sorted(got[x + i, y + j] for i in (0, 1) for j in (0, 1))
            assert four == list(range(four[0], four[0] + 4))


def test_only_files_within_the_halo_are_opened(spark, tmp_path):
    at = str(tmp_path / "tiles")
    crowded = cloud(3, 3000, 100.0, 150.0)
    df = spark.createDataFrame(cloud(1, 3000) + crowded, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, it would be one file
    try:
        tiles.partition_dataset_to_tiles(df, 50.0, at)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = spark.read.parquet(f"{at}/points")
    held = {(r.f, r.tile_x, r.tile_y) for r in every.select(F.col("_metadata.file_path").alias("f"), "tile_x", "tile_y").distinct().collect()}
    assert len({f for f, _, _ in held}) < len({(x, y) for _, x, y in held})  # fewer files than tiles
    assert len({f for f, x, y in held if (x, y) == (2, 2)}) > 1  # a crowded tile is several
    near = tiles.load_tile_with_halo(spark, 0, 6, 50.0, 10.0, at)
    overlap = {f for f, x, y in held if abs(x) <= 1 and abs(y - 6) <= 1}
    assert 0 < opened(tileset.read_files(spark, at, tileset.read_index(spark, at).filter("tile_x between -1 and 1 and tile_y between 5 and 7"))) <= len(overlap) < opened(every)
    assert rows(near, "x", "y") == rows(tiles.near_tile(tiles.assign_tiles(df, 50.0), 0, 6, 50.0, 10.0), "x", "y")


def test_appends_merge_offset_and_genes(spark, tmp_path):
    at = str(tmp_path / "tiles")
    tiles.partition_dataset_to_tiles(spark.createDataFrame([(5.0, 7.0, "B"), (60.0, 9.0, "C")], SCHEMA), 50.0, at)
    first = stored(at)
    shutil.move(f"{at}/points/batch=1", tmp_path / "away")  # rows that were there can't be read, and needn't be
    tiles.partition_dataset_to_tiles(spark.createDataFrame([(6.0, -3.0, "A"), (70.0, 9.0, "C")], SCHEMA), 50.0, at, mode="append")
    tiles.partition_dataset_to_tiles(spark.createDataFrame([], SCHEMA), 50.0, at, mode="append")
    shutil.move(tmp_path / "away", f"{at}/points/batch=1")
    assert tiles.read_offset(spark, at) == (5.0, -3.0) and tileset.read_offset(spark, at, 1) == (5.0, 7.0)
    assert rows(tiles.read_genes(spark, at), "gene", "gene_id") == [("A", 0), ("B", 1), ("C", 2)]
    assert rows(spark.read.parquet(f"{at}/genes/batch=2"), "gene") == [("A",)]  # no gene is written twice
    assert rows(tiles.read_tiles(spark, at), "x", "tile_x", "tile_y") == [(5.0, 0, 0), (6.0, 0, -1), (60.0, 1, 0), (70.0, 1, 0)]
    assert {f: t for f, t in stored(at).items() if f in first} == first
    with pytest.raises(ValueError, match="size"):
        tiles.partition_dataset_to_tiles(spark.createDataFrame([], SCHEMA), 40.0, at, mode="append")
    with pytest.raises(ValueError, match="mode"):
        tiles.partition_dataset_to_tiles(spark.createDataFrame([], SCHEMA), 40.0, at, mode="ignore")
    # rows of a batch that wasn't entered don't count
    spark.createDataFrame([(1.0, 1.0, "Z", 0, 0)], SCHEMA + ", tile_x long, tile_y long").write.parquet(f"{at}/points/batch=9")
    assert tiles.read_tiles(spark, at).count() == 4
    tiles.partition_dataset_to_tiles(spark.createDataFrame([(1.0, 2.0, "Q")], SCHEMA), 40.0, at)
    assert rows(tiles.read_tiles(spark, at), "x", "y", "gene") == [(1.0, 2.0, "Q")] and tiles.read_offset(spark, at) == (1.0, 2.0)


@pytest.mark.parametrize(("tile", "resolution", "reach"), [(50.0, 10.0, 15.0), (30.0, 35.0, 40.0)])
def test_appended_points_redo_what_they_touch(spark, tmp_path, tile, resolution, reach):
    """Sparse clouds, so that tiles get their first points and bins change owners."""
    at, out, full = (str(tmp_path / n) for n in ("tiles", "out", "full"))
    tiles.partition_dataset_to_tiles(spark.createDataFrame([(0.0, 0.0, "A"), *cloud(1, 90, 0, 600)], SCHEMA), tile, at)
    assert tiles.process_appended(spark, tile, resolution, reach, at, out).count() > 0  # nothing was there: all
    assert tiles.process_appended(spark, tile, resolution, reach, at, out).count() == 0  # nothing is new
    for seed in (2, 3)[: 1 + (tile == 50.0)]:
        tiles.partition_dataset_to_tiles(spark.createDataFrame(cloud(seed, 6, 100.0 * seed, 100.0 * seed + 150), SCHEMA), tile, at, mode="append")
        before = stored(out)
        redone = {tuple(r) for r in tiles.process_appended(spark, tile, resolution, reach, at, out).collect()}
        after = stored(out)
        assert {f: t for f, t in after.items() if f in before} == before
        tiles.process_tiles(spark, tile, resolution, reach, at, full)
        want = by_tile(spark, full)
        owners = {r[-2:] for r in want[0]}  # owner_x and owner_y come last
        assert redone and not owners <= redone and by_tile(spark, out) == want
    assert results(spark, out, resolution) == results(spark, full, resolution)
    tiles.process_tile_out_of_core(spark, *min(owners), tile, resolution, reach, at, out)
    assert by_tile(spark, out) == want


def test_a_smaller_minimum_makes_all_stale(spark, tmp_path):
    at, out = str(tmp_path / "tiles"), str(tmp_path / "out")
    tiles.partition_dataset_to_tiles(spark.createDataFrame(cloud(1, 60), SCHEMA), 50.0, at)
    tiles.process_tiles(spark, 50.0, 10.0, 15.0, at, out)
    tiles.partition_dataset_to_tiles(spark.createDataFrame([(-3.0, 200.0, "E")], SCHEMA), 50.0, at, mode="append")
    with pytest.raises(ValueError, match="offset"):
        tiles.process_tile_out_of_core(spark, 0, 0, 50.0, 10.0, 15.0, at, out)
    with pytest.raises(ValueError, match="sizes|results there"):
        tiles.process_tile_out_of_core(spark, 0, 0, 50.0, 20.0, 15.0, at, out)
    redone = tiles.process_appended(spark, 50.0, 10.0, 15.0, at, out)
    got = results(spark, out, 10.0)
    assert rows(redone, "owner_x", "owner_y") == sorted({r[-2:] for r in by_tile(spark, out)[0]})
    whole = matrix.compute_square_bins(tiles.read_tiles(spark, at).select("x", "y", "gene"), 10.0)
    e = graph.neighbours(whole.bins.select(F.col("bin_id").alias("node"), "cx", "cy"), 15.0)
    assert got[0] == rows(whole.cells, "bin_id", "gene_id", "n")
    assert got[3] == rows(graph.laplacian(e), "row", "col", "value")


def test_no_points(spark, tmp_path):
    at, out = str(tmp_path / "tiles"), str(tmp_path / "out")
    tiles.partition_dataset_to_tiles(spark.createDataFrame([], SCHEMA), 50.0, at)
    tiles.process_tiles(spark, 50.0, 10.0, 15.0, at, out)
    assert results(spark, out, 10.0) == ([], [], [], [])
    assert tiles.load_tile_with_halo(spark, 0, 0, 50.0, 5.0, at).count() == 0
    tiles.partition_dataset_to_tiles(spark.createDataFrame(cloud(4, 20), SCHEMA), 50.0, at, mode="append")
    assert tiles.process_appended(spark, 50.0, 10.0, 15.0, at, out).count() > 0
    with pytest.raises(FileNotFoundError):
        tiles.read_tiles(spark, str(tmp_path / "none"))
