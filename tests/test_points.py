"""Hand-computed cases of binning, counts, graphs and tiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlace.operators import graph, matrix, summary, tiles
from gridlace.operators import points as P

SCHEMA = "x double, y double, gene string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def points(spark, pts, schema="x double, y double"):
    return spark.createDataFrame(pts, schema)


@pytest.mark.parametrize("mode", ["floor", "floordiv"])
def test_square_bins(spark, mode):
    df = points(spark, [(v, v) for v in (0.0, 5.0, 10.0, 14.9, 15.0)])
    assert [r[0] for r in rows(P.bin_square(df, 10.0, mode), "bx", "by")] == [0, 0, 1, 1, 1]
    assert P.offset(df).first() == (0.0, 0.0)


def test_square_modes_differ_at_edges_only(spark):
    pts = [(k * 0.1, k * 0.1) for k in range(400)]
    df = points(spark, pts)
    floor = {r.x: r.bx for r in P.bin_square(df, 0.1).collect()}
    div = {r.x: r.bx for r in P.bin_square(df, 0.1, "floordiv").collect()}
    assert floor == {x: math.floor(x / 0.1) for x, _ in pts}
    assert div == {x: int(x // 0.1) for x, _ in pts}


def test_hexagons(spark):
    side = 10 / math.sqrt(3)
    df = points(spark, [(0.0, 0.0), (10.0, 0.0), (5.0, 1.5 * side)])
    assert {(r.x, r.q, r.r) for r in P.bin_hexagonal(df, 10.0).collect()} == {(0.0, 0, 0), (10.0, 1, 0), (5.0, 0, 1)}


def test_hexagon_centre_is_nearest(spark):
    rng = random.Random(5)
    df = points(spark, [(rng.uniform(-80, 80), rng.uniform(-80, 80)) for _ in range(400)])
    for r in P.get_bin_centers(P.bin_hexagonal(df, 7.0), "hex", 7.0).collect():
        side = 7 / math.sqrt(3)
        best = min(math.hypot(r.x - side * math.sqrt(3) * (q + s / 2), r.y - side * 1.5 * s) for q in range(r.q - 2, r.q + 3) for s in range(r.r - 2, r.r + 3))
        assert math.hypot(r.x - r.cx, r.y - r.cy) <= best + 1e-9


def test_centres(spark):
    square = P.get_bin_centers(spark.createDataFrame([(0, 0), (1, 2)], "bx long, by long"), "square", 10.0, (100.0, 200.0))
    assert rows(square, "cx", "cy") == [(105.0, 205.0), (115.0, 225.0)]
    side = 10 / math.sqrt(3)
    hexes = P.get_bin_centers(spark.createDataFrame([(0, 0), (1, 2)], "q long, r long"), "hex", 10.0)
    assert rows(hexes, "cx", "cy")[1] == pytest.approx((2 * math.sqrt(3) * side, 3 * side))
    with pytest.raises(ValueError):
        P.get_bin_centers(square, "square", 10.0)
    with pytest.raises(ValueError):
        P.get_bin_centers(square, "triangle", 10.0)


def binned(spark):
    return spark.createDataFrame([(0, 0, "ACTB"), (0, 0, "ACTB"), (0, 1, "CD3D"), (0, 0, "GAPDH"), (1, 1, "CD3D")], "bx long, by long, gene string")


def test_count_matrix(spark):
    m = matrix.build_sparse_matrix(binned(spark))
    assert rows(m.bins, "bin_id", "bx", "by") == [(0, 0, 0), (1, 0, 1), (2, 1, 1)]
    assert rows(m.genes, "gene_id", "gene") == [(0, "ACTB"), (1, "CD3D"), (2, "GAPDH")]
    assert rows(m.cells, "bin_id", "gene_id", "n") == [(0, 0, 2), (0, 2, 1), (1, 1, 1), (2, 1, 1)]
    csr = {r.bin_id: (r.row_start, r.row_end, r.indices, r.data) for r in m.compressed().collect()}
    assert csr == {0: (0, 2, [0, 2], [2, 1]), 1: (2, 3, [1], [1]), 2: (3, 4, [1], [1])}
    csc = {r.gene_id: (r.row_start, r.row_end, r.indices, r.data) for r in m.compressed("CSC").collect()}
    assert csc == {0: (0, 1, [0], [2]), 1: (1, 3, [1, 2], [1, 1]), 2: (3, 4, [0], [1])}
    with pytest.raises(ValueError):
        m.compressed("coo")
    dense = matrix.dense_matrix(m.counts, ("bx", "by"), ["ACTB", "CD3D", "GAPDH"])
    assert rows(dense, "bx", "by", "ACTB", "CD3D", "GAPDH") == [(0, 0, 2, 0, 1), (0, 1, 0, 1, 0), (1, 1, 0, 1, 0)]


def test_one_bin(spark):
    df = spark.createDataFrame([(10.2, 20.1, "GeneA"), (10.5, 20.4, "GeneB"), (10.8, 20.3, "GeneA")], SCHEMA)
    m = matrix.compute_square_bins(df, 5.0)
    assert m.bins.count() == 1
    assert rows(m.counts, "gene", "n") == [("GeneA", 2), ("GeneB", 1)]
    every = matrix.compute_square_bins(df, 5.0, genes=spark.createDataFrame([("GeneA",), ("GeneB",), ("GeneC",)], "gene string"))
    assert every.genes.count() == 3


def test_null_and_nan_points_go(spark):
    df = spark.createDataFrame([(None, 1.0, "A"), (float("nan"), 1.0, "A"), (1.0, 1.0, None), (1.0, 1.0, "A")], SCHEMA)
    assert P.bin_square(df, 1.0).count() == 1
    assert P.bin_hexagonal(df, 1.0).count() == 1


def test_bad_sizes(spark):
    df = points(spark, [(0.0, 0.0)])
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            P.bin_square(df, bad)
    with pytest.raises(ValueError):
        graph.neighbours(spark.createDataFrame([(0, 0.0, 0.0)], "node long, cx double, cy double"), -1.0)


def grid(spark):
    return spark.createDataFrame([(3 * j + i, 5.0 + 10 * i, 5.0 + 10 * j) for j in range(3) for i in range(3)], "node long, cx double, cy double")


@pytest.mark.parametrize(("r", "degree", "edges"), [(10.1, 4, 12), (14.2, 8, 20), (10.0, 4, 12)])
def test_square_graph(spark, r, degree, edges):
    e = graph.neighbours(grid(spark), r)
    assert e.count() == edges
    assert {x.node: x.degree for x in graph.degrees(grid(spark), e).collect()}[4] == degree
    entries = {(x.row, x.col): x.value for x in graph.laplacian(e).collect()}
    assert entries[4, 4] == degree and entries[4, 1] == -1
    adjacency, lap = graph.build_spatial_graph(grid(spark), r)
    assert all(x.row != x.col for x in adjacency.collect())
    assert {x[1] for x in lap.groupBy("row").agg(F.sum("value")).collect()} == {0.0}


def test_hexagon_ring(spark):
    ring = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)], "q long, r long")
    nodes = matrix.dense_ids(P.get_bin_centers(ring, "hex", 10.0), "q", "r", "node")
    e = graph.neighbours(nodes, 10.1)
    middle = nodes.filter("q = 0 and r = 0").first().node
    assert e.count() == 12
    assert {x.node: x.degree for x in graph.degrees(nodes, e).collect()}[middle] == 6


def test_neighbours_against_all_pairs(spark):
    rng = random.Random(9)
    pts = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)] + [(150, 1.5, 2.5), (151, 1.5, 2.5)]
    nodes = spark.createDataFrame(pts, "node long, cx double, cy double")
    for r in (0.0, 3.0, 20.0):
        want = sorted((a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= r * r)
        assert rows(graph.neighbours(nodes, r), "src", "dst") == want


def test_empty_points(spark):
    df = spark.createDataFrame([], SCHEMA)
    m = matrix.compute_square_bins(df, 5.0)
    nodes = m.bins.select(F.col("bin_id").alias("node"), "cx", "cy")
    assert m.cells.count() == 0 and graph.laplacian(graph.neighbours(nodes, 1.0)).count() == 0
    k = summary.kpi_summary(m.counts, graph.neighbours(nodes, 1.0)).first()
    assert (k.molecules, k.active_bins, k.edges, k.sparsity_pct) == (0, 0, 0, 0.0)


TILE = [(12.5, 45.2, "GAPDH"), (13.1, 44.8, "GAPDH"), (55.0, 82.1, "MALAT1"), (14.2, 46.0, "ACTB"), (85.0, 81.0, "GAPDH"), (88.0, 83.0, "MALAT1"), (102.0, 105.0, "ACTB")]
EDGE = [(12.5, 45.2, "G"), (13.1, 44.8, "G"), (14.2, 46.0, "A"), (48.0, 48.0, "G"), (49.5, 53.0, "M"), (52.0, 51.0, "A"), (61.0, 48.5, "G"), (71.0, 98.0, "M"), (103.0, 99.0, "G"), (102.0, 105.0, "A")]


@pytest.mark.parametrize(("pts", "edges"), [(TILE, 0), (EDGE, 2)])
@pytest.mark.parametrize("each", [True, False])
def test_tiles_equal_global(spark, tmp_path, pts, edges, each):
    df = spark.createDataFrame(pts, SCHEMA)
    at, out = str(tmp_path / "tiles"), str(tmp_path / "out")
    tiles.partition_dataset_to_tiles(df, 50.0, at)
    if each:
        # owners may be tiles around those with points
        for t in {(r.tile_x, r.tile_y) for r in tiles.read_tiles(spark, at).select("tile_x", "tile_y").distinct().collect()}:
            tiles.process_tile_out_of_core(spark, *t, 50.0, 10.0, 15.0, at, out)
    else:
        tiles.process_tiles(spark, 50.0, 10.0, 15.0, at, out)
    m, nodes, adjacency, lap = tiles.stitch_out_of_core_results(spark, out, 10.0)
    want = matrix.compute_square_bins(df, 10.0)
    own = want.bins.select(F.col("bin_id").alias("node"), "cx", "cy")
    e = graph.neighbours(own, 15.0)
    assert e.count() == edges
    assert rows(nodes, "node", "cx", "cy") == rows(own, "node", "cx", "cy")
    assert rows(m.cells, "bin_id", "gene_id", "n") == rows(want.cells, "bin_id", "gene_id", "n")
    assert rows(adjacency, "row", "col", "value") == rows(graph.adjacency(e), "row", "col", "value")
    assert rows(lap, "row", "col", "value") == rows(graph.laplacian(e), "row", "col", "value")


def test_narrow_halo_keeps_counts(spark):
    df = spark.createDataFrame([(0.0, 0.0, "G"), (41.0, 1.0, "G"), (59.0, 1.0, "G")], SCHEMA)
    counts = tiles.tile_counts(tiles.assign_tiles(df, 50.0), 50.0, 20.0)
    assert rows(counts, "owner_x", "bx", "n") == [(0, 0, 1), (1, 2, 2)]


def test_halo(spark, tmp_path):
    at = str(tmp_path / "tiles")
    tiles.partition_dataset_to_tiles(spark.createDataFrame(TILE, SCHEMA), 50.0, at)
    got = rows(tiles.load_tile_with_halo(spark, 1, 1, 50.0, 5.0, at), "x", "src_tile_x", "src_tile_y")
    assert got == [(55.0, 1, 1), (85.0, 1, 1), (88.0, 1, 1), (102.0, 2, 2)]
    assert tiles.load_tile_with_halo(spark, 9, 9, 50.0, 5.0, at).columns == ["x", "y", "gene", "src_tile_x", "src_tile_y"]
    with pytest.raises(FileNotFoundError):
        tiles.read_tiles(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        tiles.stitch_out_of_core_results(spark, str(tmp_path / "none"), 10.0)


def test_sample_and_labels(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("x"))
    got = [r.x for r in summary.sample(df, 100).collect()]
    assert len(got) == 100 == len(set(got))
    assert summary.sample(df, 1000).count() == 500
    assert summary.bin_labels(spark.createDataFrame([(3, 7)], "bin_id long, total long")).first().label == "Bin 3\nTotal transcripts: 7"


def test_radius_join_is_an_equi_join(spark):
    plan = graph.neighbours(grid(spark), 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
