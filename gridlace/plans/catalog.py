"""Queries over the driver's tables and their DuckDB forms.

Four tables are read as molecules (x, y, gene): events, lineitem, customer (negative coordinates) and embeddings
(FLOAT). Every query covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlace.operators import graph, matrix, summary, tiles
from gridlace.operators import points as P
from gridlace.sources import exports, shared, synthetic
from gridlace.sources import points as sources


@dataclass(frozen=True)
class Source:
    table: str
    spark: tuple[str, str, str]
    sql: tuple[str, str, str]
    resolution: float
    radius: float
    tile: float
    single: bool = False


SOURCES = {
    "ev": Source("events", ("value", "cast(user_id as double)", "event_type"), ("value", "user_id::DOUBLE", "event_type"), 10.0, 15.0, 50.0),
    "li": Source(
        "lineitem", ("l_extendedprice / cast(100 as double)", "l_quantity * cast(10 as double)", "concat(l_returnflag, l_linestatus)"),
        ("l_extendedprice / 100::DOUBLE", "l_quantity * 10::DOUBLE", "concat(l_returnflag, l_linestatus)"), 20.0, 30.0, 100.0,
    ),
    "cu": Source("customer", ("c_acctbal", "cast(c_custkey as double)", "c_mktsegment"), ("c_acctbal", "c_custkey::DOUBLE", "c_mktsegment"), 100.0, 150.0, 500.0),
    "em": Source("embeddings", ("embedding[0]", "embedding[1]", "cast(label as string)"), ("embedding[1]", "embedding[2]", "label::VARCHAR"), 0.05, 0.075, 0.25, True),
}


def molecules(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    s = SOURCES[key]
    return spark.read.parquet(f"{sf_dir}/{s.table}.parquet").selectExpr(*(f"{e} as {n}" for e, n in zip(s.spark, ("x", "y", "gene"), strict=True)))


def _square(spark, d, key, mode="floor") -> DataFrame:
    return P.bin_square(molecules(spark, d, key), SOURCES[key].resolution, mode)


def _hex(spark, d, key) -> DataFrame:
    return P.bin_hexagonal(molecules(spark, d, key), SOURCES[key].resolution)


def _fused(spark, d, key) -> matrix.CountMatrix:
    return matrix.compute_square_bins(molecules(spark, d, key), SOURCES[key].resolution)


def _bound(key) -> int:
    """Centres of bins that a cell of the radius can have."""
    return graph.lattice_bound(SOURCES[key].resolution, SOURCES[key].radius)


def _graph(spark, d, key) -> tuple[matrix.CountMatrix, DataFrame, DataFrame]:
    """Counts, nodes and edges, all of one table of counts."""
    m = _fused(spark, d, key)
    nodes = m.bins.select(F.col("bin_id").alias("node"), "cx", "cy")
    return m, nodes, graph.neighbours(nodes, SOURCES[key].radius, _bound(key))


def _edges(spark, d, key) -> DataFrame:
    return _graph(spark, d, key)[2]


def _hex_nodes(spark, d, key) -> DataFrame:
    bins = matrix.dense_ids(_hex(spark, d, key).select("q", "r").distinct(), "q", "r", "node")
    return P.get_bin_centers(bins, "hex", SOURCES[key].resolution).select("node", "cx", "cy")


def _tiled(spark, d, key) -> DataFrame:
    return tiles.assign_tiles(molecules(spark, d, key), SOURCES[key].tile)


def _owners(spark, d, key) -> DataFrame:
    return tiles.bin_owners(_tiled(spark, d, key), SOURCES[key].tile, SOURCES[key].resolution)


def _centers(spark, d, key) -> DataFrame:
    pts = molecules(spark, d, key)
    return P.get_bin_centers(_square(spark, d, key).select("bx", "by").distinct(), "square", SOURCES[key].resolution, P.origin(P.clean(pts)))


def _kpi(spark, d, key) -> DataFrame:
    m, _, edges = _graph(spark, d, key)
    return summary.kpi_summary(m.counts, edges)


def _stitched(spark, d, key) -> tuple[DataFrame, DataFrame]:
    """Bins with ids, and edges between them, put together from what stands at the owners of tiles."""
    owners = _owners(spark, d, key)
    bins = matrix.dense_ids(owners.select("bx", "by"), "by", "bx", "bin_id")
    return bins, tiles.stitched_edges(tiles.tile_edges(owners, SOURCES[key].radius, SOURCES[key].resolution), bins)


def _stitched_counts(spark, d, key) -> DataFrame:
    counts = tiles.tile_counts(_tiled(spark, d, key), SOURCES[key].tile, SOURCES[key].resolution)
    bins = matrix.dense_ids(counts.select("bx", "by").distinct(), "by", "bx", "bin_id")
    return matrix.CountMatrix(counts, bins, matrix.gene_ids(counts), ("bx", "by")).cells


def _qv(spark, d) -> DataFrame:
    both = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_extendedprice / cast(100 as double) as x_location", "l_quantity * cast(10 as double) as y_location", "concat(l_returnflag, l_linestatus) as feature_name", "l_quantity as qv", "l_tax as extra")
    return sources.standardise(both)


def _place(spark) -> str:
    """A new path in the shared folder."""
    at = shared.folder(spark)
    if at is None:
        raise ValueError("spark.checkpoint.dir must name a shared folder for queries that write files")
    return at


def _partitioned(spark, d, key) -> str:
    """A data set of tiles on disk: half of the table is written first, the rest appended."""
    at, pts = _place(spark), molecules(spark, d, key)
    half = F.pmod(F.hash("x", "y", "gene"), F.lit(2)) == 0
    tiles.partition_dataset_to_tiles(pts.filter(half), SOURCES[key].tile, at)
    tiles.partition_dataset_to_tiles(pts.filter(~half | half.isNull()), SOURCES[key].tile, at, mode="append")
    return at


def _tile_file(spark, d, key) -> DataFrame:
    return tiles.load_tile_with_halo(spark, 1, 0, SOURCES[key].tile, SOURCES[key].radius, _partitioned(spark, d, key))


def _from_files(spark, d, key):
    """What the tiles wrote, put together from their files; one of the tiles was processed once more by itself."""
    s, at, out = SOURCES[key], _partitioned(spark, d, key), _place(spark)
    tiles.process_tiles(spark, s.tile, s.resolution, s.radius, at, out)
    tiles.process_tile_out_of_core(spark, 1, 0, s.tile, s.resolution, s.radius, at, out)
    return tiles.stitch_out_of_core_results(spark, out, s.resolution)


def _late(spark, d, key, at: str):
    """Write a table as tiles in two batches, points from tile 2 on (by x) in the second; after each the caller has a turn."""
    pts, late = molecules(spark, d, key), F.col("x") >= F.lit(2 * SOURCES[key].tile)
    for part, mode in ((~late | late.isNull(), "overwrite"), (late, "append")):
        tiles.partition_dataset_to_tiles(pts.filter(part), SOURCES[key].tile, at, mode=mode)
        yield mode


def _appended(spark, d, key):
    """Stitched results of tiles that were processed after the first batch, and brought up to date after the second."""
    s, at, out = SOURCES[key], _place(spark), _place(spark)
    for _ in _late(spark, d, key, at):
        tiles.process_appended(spark, s.tile, s.resolution, s.radius, at, out)
    return tiles.stitch_out_of_core_results(spark, out, s.resolution)


def _appended_metadata(spark, d, key) -> DataFrame:
    """(gene, gene_id, x_min, y_min) as merged from the batches."""
    at = _place(spark)
    list(_late(spark, d, key, at))
    x0, y0 = tiles.read_offset(spark, at)
    return tiles.read_genes(spark, at).withColumns({"x_min": F.lit(x0), "y_min": F.lit(y0)})


def _csv(spark, d, load: Callable, rename: dict[str, str] | None = None, codec: str = "none") -> DataFrame:
    at = f"{_place(spark)}.csv"
    molecules(spark, d, "ev").withColumn("qv", F.lit(30)).withColumnsRenamed(rename or {}).write.option("compression", codec).csv(at, header=True)
    return load(spark, at)


def _exported(spark, d, form: str) -> DataFrame:
    at = _place(spark)
    if form == "dense":
        exports.export_csv(_dense(spark, d), at)
        return spark.read.csv(at, header=True, schema="bin_x double, bin_y double, " + ", ".join(f"{e} bigint" for e in EVENT_TYPES))
    edges = _edges(spark, d, "ev")
    if form == "edges":
        exports.export_edges(edges, at)
        return spark.read.csv(at, header=True, schema="source_bin bigint, target_bin bigint")
    if form == "npz":
        m, _, edges = _graph(spark, d, "ev")
        exports.export_npz_shards(graph.laplacian(edges), at, m.bins.count(), 1000)
        return exports.read_npz_shards(spark, at)
    exports.export_matrix(graph.laplacian(edges), at)
    return spark.read.parquet(at)


def _sampled(spark, d, key: str, ids: tuple[str, ...]) -> DataFrame:
    """Rows of a table as points, drawn by the hash of their ids."""
    s = SOURCES[key]
    own = spark.read.parquet(f"{d}/{s.table}.parquet").selectExpr(*ids, *(f"{e} as {n}" for e, n in zip(s.spark, ("x", "y", "gene"), strict=True)))
    return summary.sample(own, keys=list(ids))


def _sampled_sql(key: str, ids: tuple[str, ...]) -> str:
    s = SOURCES[key]
    columns = ", ".join([*ids, *(f"{e} AS {n}" for e, n in zip(s.sql, ("x", "y", "gene"), strict=True))])
    return f"SELECT {columns} FROM {s.table} ORDER BY md5('42:sample:' || {" || ':' || ".join(ids)}) LIMIT {summary.SAMPLE_ROWS}"


def _dictionary(spark, d) -> DataFrame:
    """A dictionary that two data sets share: it lacks one gene of the events, and has some that they haven't."""
    own = molecules(spark, d, "ev").select("gene").filter("gene <> 'click'").unionByName(molecules(spark, d, "cu").select("gene"))
    return matrix.gene_ids(own)


def _synthetic(spark, d) -> DataFrame:
    """A synthetic molecule for each event."""
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    return synthetic.molecules_of(ids, 500).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "gene")


def _synthetic_csv(spark, d) -> DataFrame:
    """The same written as CSV and loaded again."""
    at = f"{_place(spark)}.csv"
    _synthetic(spark, d).drop("id").write.csv(at, header=True)
    return sources.load_transcript_data(spark, at)


def _empty_exits(spark, d) -> DataFrame:
    """What has nothing in it, of a data set that has: a tile without points, before and after it was processed, and a radius below any distance."""
    s, at, out = SOURCES["ev"], _place(spark), _place(spark)
    tiles.partition_dataset_to_tiles(molecules(spark, d, "ev"), s.tile, at)
    far = 10**6
    tiles.process_tile_out_of_core(spark, far, far, s.tile, s.resolution, s.radius, at, out)
    _, nodes, _ = _graph(spark, d, "ev")
    edges = graph.neighbours(nodes, s.resolution / 2)
    parts = {"molecules": tiles.read_tiles(spark, at), "far_rows": tiles.load_tile_with_halo(spark, far, far, s.tile, s.radius, at), "edges": edges, "laplacian": graph.laplacian(edges)}
    parts |= {f"far_{name}": tiles.results(spark, out, name) for name in ("bins", "counts", "edges")}
    whole = None
    for name, df in parts.items():
        own = df.agg(F.count("*").alias(name))
        whole = own if whole is None else whole.crossJoin(F.broadcast(own))  # one row each
    return whole


EVENT_TYPES = ["add_to_cart", "click", "purchase", "search", "view"]


def _dense(spark, d) -> DataFrame:
    m = _fused(spark, d, "ev")
    wide = matrix.dense_matrix(m.counts, ("bx", "by"), EVENT_TYPES)
    return wide.join(m.bins, ["bx", "by"]).select(F.col("cx").alias("bin_x"), F.col("cy").alias("bin_y"), *EVENT_TYPES)


#: name: (query of (spark, sf_dir, source), sources)
FORMS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "square_bins": (lambda s, d, k: _square(s, d, k), ("ev", "li", "cu", "em")),
    "square_floordiv_bins": (lambda s, d, k: _square(s, d, k, "floordiv"), ("ev", "li", "cu", "em")),
    "square_counts": (lambda s, d, k: matrix.count_genes(_square(s, d, k)), ("ev", "li", "cu", "em")),
    "hex_bins": (lambda s, d, k: _hex(s, d, k), ("ev", "li", "cu", "em")),
    "hex_counts": (lambda s, d, k: matrix.count_genes(_hex(s, d, k), ("q", "r")), ("ev", "li", "cu", "em")),
    "square_centers": (_centers, ("ev", "li", "cu", "em")),
    "hex_centers": (lambda s, d, k: P.get_bin_centers(_hex(s, d, k).select("q", "r").distinct(), "hex", SOURCES[k].resolution), ("ev", "li", "cu", "em")),
    "count_matrix_coo": (lambda s, d, k: matrix.build_sparse_matrix(_square(s, d, k)).cells, ("ev", "li", "cu", "em")),
    "fused_matrix_coo": (lambda s, d, k: _fused(s, d, k).cells, ("ev", "li", "cu", "em")),
    "csr_view": (lambda s, d, k: matrix.build_sparse_matrix(_square(s, d, k)).compressed("csr"), ("ev", "li")),
    "csc_view": (lambda s, d, k: matrix.build_sparse_matrix(_square(s, d, k)).compressed("CSC"), ("ev", "li")),
    "gene_dictionary": (lambda s, d, k: matrix.gene_ids(P.clean(molecules(s, d, k))), ("ev", "li", "cu")),
    "bin_dictionary": (lambda s, d, k: _fused(s, d, k).bins.select("bin_id", "bx", "by", "cx", "cy"), ("ev", "li", "cu")),
    "bin_totals": (lambda s, d, k: matrix.bin_totals(matrix.count_genes(_square(s, d, k))), ("ev", "li", "cu")),
    "edges": (_edges, ("ev", "li", "cu", "em")),
    "hex_edges": (lambda s, d, k: graph.neighbours(_hex_nodes(s, d, k), SOURCES[k].radius, _bound(k)), ("ev", "cu")),
    "adjacency": (lambda s, d, k: graph.adjacency(_edges(s, d, k)), ("ev", "li", "cu")),
    "degree": (lambda s, d, k: graph.degrees(*_graph(s, d, k)[1:]), ("ev", "li", "cu")),
    "laplacian": (lambda s, d, k: graph.laplacian(_edges(s, d, k)), ("ev", "li", "cu")),
    "edge_segments": (lambda s, d, k: graph.segments(*_graph(s, d, k)[1:]), ("ev", "li", "cu")),
    "kpi_summary": (_kpi, ("ev", "li", "cu")),
    "tile_assign": (_tiled, ("ev", "cu")),
    "halo_tile": (lambda s, d, k: tiles.near_tile(_tiled(s, d, k), 1, 0, SOURCES[k].tile, SOURCES[k].radius), ("ev", "cu")),
    "tile_home": (lambda s, d, k: _owners(s, d, k).select("bx", "by", "home_x", "home_y", "home_active"), ("ev", "cu")),
    "bin_owner": (lambda s, d, k: _owners(s, d, k).select("bx", "by", "owner_x", "owner_y"), ("ev", "li", "cu")),
    "tile_counts": (lambda s, d, k: tiles.tile_counts(_tiled(s, d, k), SOURCES[k].tile, SOURCES[k].resolution), ("ev", "li", "cu")),
    "tile_edges": (lambda s, d, k: tiles.tile_edges(_owners(s, d, k), SOURCES[k].radius, SOURCES[k].resolution), ("ev", "cu")),
    "stitched_counts": (_stitched_counts, ("ev", "li", "cu")),
    "stitched_edges": (lambda s, d, k: _stitched(s, d, k)[1], ("ev", "li", "cu")),
    "stitched_laplacian": (lambda s, d, k: graph.laplacian(_stitched(s, d, k)[1]), ("ev", "li", "cu")),
    "tiles_written": (lambda s, d, k: tiles.read_tiles(s, _partitioned(s, d, k)), ("ev", "cu")),
    "tile_file": (_tile_file, ("ev", "cu")),
    "tiles_appended_counts": (lambda s, d, k: _appended(s, d, k)[0].cells, ("ev", "cu")),
    "tiles_appended_laplacian": (lambda s, d, k: _appended(s, d, k)[3], ("ev", "cu")),
    "tiles_appended_metadata": (_appended_metadata, ("ev", "cu")),
    "stitched_files_counts": (lambda s, d, k: _from_files(s, d, k)[0].cells, ("ev", "cu")),
    "stitched_files_nodes": (lambda s, d, k: _from_files(s, d, k)[1], ("ev", "cu")),
    "stitched_files_adjacency": (lambda s, d, k: _from_files(s, d, k)[2], ("ev", "cu")),
    "stitched_files_laplacian": (lambda s, d, k: _from_files(s, d, k)[3], ("ev", "cu")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f"{name}_{k}": (lambda s, d, f=f, k=k: f(s, d, k)) for name, (f, keys) in FORMS.items() for k in keys}
    out |= {
        "dense_matrix_ev": _dense,
        "load_qv_filter_li": _qv,
        "gene_filter_ev": lambda s, d: summary.only_gene(molecules(s, d, "ev"), "click"),
        "sample_ev": lambda s, d: _sampled(s, d, "ev", ("event_id",)),
        "bin_labels_ev": lambda s, d: summary.bin_labels(_fused(s, d, "ev").cells.groupBy("bin_id").agg(F.sum("n").alias("total"))),
        "degree_labels_ev": lambda s, d: summary.degree_labels(graph.degrees(*_graph(s, d, "ev")[1:])),
        "sample_li": lambda s, d: _sampled(s, d, "li", ("l_orderkey", "l_linenumber")),
        "fixed_dictionary_ev": _dictionary,
        "fixed_dictionary_coo_ev": lambda s, d: matrix.compute_square_bins(molecules(s, d, "ev"), SOURCES["ev"].resolution, _dictionary(s, d)).cells,
        "fixed_dictionary_coo_cu": lambda s, d: matrix.build_sparse_matrix(_square(s, d, "cu"), genes=_dictionary(s, d)).cells,
        "synthetic_molecules_ev": _synthetic,
        "synthetic_csv_ev": _synthetic_csv,
        "empty_exits_ev": _empty_exits,
        "load_csv_ev": lambda s, d: _csv(s, d, sources.load_coordinates, {"x": "x_location", "y": "y_location", "gene": "feature_name"}),
        "load_csv_gz_ev": lambda s, d: _csv(s, d, sources.load_coordinates, codec="gzip"),
        "load_transcripts_ev": lambda s, d: _csv(s, d, sources.load_transcript_data),
        "export_dense_ev": lambda s, d: _exported(s, d, "dense"),
        "export_edges_ev": lambda s, d: _exported(s, d, "edges"),
        "export_laplacian_ev": lambda s, d: _exported(s, d, "laplacian"),
        "export_npz_ev": lambda s, d: _exported(s, d, "npz"),
    }
    return out


def _base(k: str) -> str:
    """Common table expressions of a source; each later one is used by the forms that need it."""
    s = SOURCES[k]
    kind = "FLOAT" if s.single else "DOUBLE"
    res, rad, tile = f"{s.resolution!r}::{kind}", f"{s.radius!r}::DOUBLE", f"{s.tile!r}::DOUBLE"
    wide = f"{s.resolution!r}::DOUBLE"
    root, side = "sqrt(3::DOUBLE)", f"({wide} / sqrt(3::DOUBLE))"
    part = "((2::DOUBLE / 3::DOUBLE)::FLOAT * y)::DOUBLE" if s.single else "(2::DOUBLE / 3::DOUBLE) * y"
    x, y, gene = s.sql

    def quotient(v: str) -> str:
        return f"round_even(({v} - {v} % {res}) / {res}, 0)::BIGINT"

    return f"""
WITH m AS (SELECT * FROM (SELECT {x} AS x, {y} AS y, {gene} AS gene FROM {s.table}) WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND gene IS NOT NULL),
o AS (SELECT min(x) AS x0, min(y) AS y0 FROM m),
sq AS (SELECT x, y, gene, floor((x - x0) / {res})::BIGINT AS bx, floor((y - y0) / {res})::BIGINT AS "by" FROM m, o),
fd AS (SELECT x, y, gene, {quotient("(x - x0)")} AS bx, {quotient("(y - y0)")} AS "by" FROM m, o),
h0 AS (SELECT x, y, gene, ({root} * x - y) / (3::DOUBLE * {side}) AS fq, {part} / {side} AS fr FROM m),
h1 AS (SELECT *, -fq - fr AS fs FROM h0),
h2 AS (SELECT *, round_even(fq, 0) AS q0, round_even(fr, 0) AS r0, round_even(fs, 0) AS s0 FROM h1),
h3 AS (SELECT *, abs(q0 - fq) AS dq, abs(r0 - fr) AS dr, abs(s0 - fs) AS ds FROM h2),
hx AS (SELECT x, y, gene, (CASE WHEN dq >= dr AND dq >= ds THEN -r0 - s0 ELSE q0 END)::BIGINT AS q,
  (CASE WHEN NOT (dq >= dr AND dq >= ds) AND dr >= ds THEN -q0 - s0 ELSE r0 END)::BIGINT AS r FROM h3),
sc AS (SELECT bx, "by", gene, count(*) AS n FROM sq GROUP BY ALL),
fc AS (SELECT bx, "by", gene, count(*) AS n FROM fd GROUP BY ALL),
g AS (SELECT gene, (row_number() OVER (ORDER BY gene) - 1)::INTEGER AS gene_id FROM (SELECT DISTINCT gene FROM m)),
sb AS (SELECT bx, "by", row_number() OVER (ORDER BY bx, "by") - 1 AS bin_id FROM (SELECT DISTINCT bx, "by" FROM sc)),
fb AS (SELECT bx, "by", row_number() OVER (ORDER BY "by", bx) - 1 AS bin_id, (bx::DOUBLE + 0.5::DOUBLE) * {wide} + x0::DOUBLE AS cx, ("by"::DOUBLE + 0.5::DOUBLE) * {wide} + y0::DOUBLE AS cy
  FROM (SELECT DISTINCT bx, "by" FROM fc), o),
cells AS (SELECT bin_id, gene_id, n FROM sc JOIN sb USING (bx, "by") JOIN g USING (gene)),
e AS (SELECT a.bin_id AS src, b.bin_id AS dst FROM fb a JOIN fb b ON a.bin_id < b.bin_id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= {rad} * {rad}),
hb AS (SELECT q, r, row_number() OVER (ORDER BY q, r) - 1 AS node, {side} * ({root} * q::DOUBLE + {root} / 2::DOUBLE * r::DOUBLE) AS cx, {side} * 1.5::DOUBLE * r::DOUBLE AS cy FROM (SELECT DISTINCT q, r FROM hx)),
dg AS (SELECT bin_id AS node, (SELECT count(*) FROM e WHERE src = bin_id OR dst = bin_id) AS degree FROM fb),
lp AS (SELECT node AS row, node AS col, degree::DOUBLE AS value FROM dg WHERE degree > 0 UNION ALL SELECT src, dst, -1::DOUBLE FROM e UNION ALL SELECT dst, src, -1::DOUBLE FROM e),
t AS (SELECT x, y, gene, floor(x::DOUBLE / {tile})::BIGINT AS tile_x, floor(y::DOUBLE / {tile})::BIGINT AS tile_y FROM m),
ts AS (SELECT DISTINCT floor((x - x0) / {res})::BIGINT AS bx, floor((y - y0) / {res})::BIGINT AS "by", tile_x, tile_y FROM t, o),
tb AS (SELECT bx, "by", min((tile_x, tile_y)) AS source, (bx::DOUBLE + 0.5::DOUBLE) * {wide} + any_value(x0)::DOUBLE AS cx, ("by"::DOUBLE + 0.5::DOUBLE) * {wide} + any_value(y0)::DOUBLE AS cy FROM ts, o GROUP BY bx, "by"),
th AS (SELECT *, floor(cx / {tile})::BIGINT AS home_x, floor(cy / {tile})::BIGINT AS home_y FROM tb),
tw AS (SELECT th.*, EXISTS (SELECT 1 FROM ts WHERE tile_x = home_x AND tile_y = home_y) AS home_active FROM th),
ow AS (SELECT *, CASE WHEN home_active THEN home_x ELSE source[1] END AS owner_x, CASE WHEN home_active THEN home_y ELSE source[2] END AS owner_y FROM tw),
oe AS (SELECT a.bx AS bx_a, a."by" AS by_a, a.owner_x AS ax, a.owner_y AS ay, b.bx AS bx_b, b."by" AS by_b, b.owner_x AS bxo, b.owner_y AS byo
  FROM ow a JOIN ow b ON (a.bx < b.bx OR (a.bx = b.bx AND a."by" < b."by")) AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= {rad} * {rad}),
si AS (SELECT bx, "by", row_number() OVER (ORDER BY "by", bx) - 1 AS bin_id FROM ow),
se AS (SELECT least(a.bin_id, b.bin_id) AS src, greatest(a.bin_id, b.bin_id) AS dst FROM oe JOIN si a ON a.bx = bx_a AND a."by" = by_a JOIN si b ON b.bx = bx_b AND b."by" = by_b)
"""


def _view(major: str, minor: str) -> str:
    return f"""SELECT {major}, (sum(count(*)) OVER (ORDER BY {major}) - count(*))::BIGINT AS row_start, (sum(count(*)) OVER (ORDER BY {major}))::BIGINT AS row_end,
list({minor} ORDER BY {minor}) AS indices, list(n ORDER BY {minor}) AS data FROM cells GROUP BY {major}"""


_SELECTS = {
    "square_bins": "SELECT * FROM sq",
    "square_floordiv_bins": "SELECT * FROM fd",
    "square_counts": "SELECT * FROM sc",
    "hex_bins": "SELECT * FROM hx",
    "hex_counts": "SELECT q, r, gene, count(*) AS n FROM hx GROUP BY ALL",
    "square_centers": 'SELECT DISTINCT bx, "by", (bx::DOUBLE + 0.5::DOUBLE) * {wide} + x0::DOUBLE AS cx, ("by"::DOUBLE + 0.5::DOUBLE) * {wide} + y0::DOUBLE AS cy FROM sc, o',
    "hex_centers": "SELECT q, r, cx, cy FROM hb",
    "count_matrix_coo": "SELECT * FROM cells",
    "fused_matrix_coo": 'SELECT bin_id, gene_id, n FROM fc JOIN fb USING (bx, "by") JOIN g USING (gene)',
    "csr_view": _view("bin_id", "gene_id"),
    "csc_view": """SELECT gene_id, bin_id // 65536 AS block, (sum(count(*)) OVER w - count(*))::BIGINT AS row_start, (sum(count(*)) OVER w)::BIGINT AS row_end,
list(bin_id ORDER BY bin_id) AS indices, list(n ORDER BY bin_id) AS data FROM cells GROUP BY gene_id, bin_id // 65536 WINDOW w AS (ORDER BY gene_id, bin_id // 65536)""",
    "gene_dictionary": "SELECT * FROM g",
    "bin_dictionary": "SELECT * FROM fb",
    "bin_totals": 'SELECT bx, "by", sum(n)::BIGINT AS total FROM sc GROUP BY ALL',
    "edges": "SELECT * FROM e",
    "hex_edges": "SELECT a.node AS src, b.node AS dst FROM hb a JOIN hb b ON a.node < b.node AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= {rad} * {rad}",
    "adjacency": "SELECT src AS row, dst AS col, 1::FLOAT AS value FROM e UNION ALL SELECT dst, src, 1::FLOAT FROM e",
    "degree": "SELECT * FROM dg",
    "laplacian": "SELECT * FROM lp",
    "edge_segments": "SELECT src, dst, a.cx AS x0, a.cy AS y0, b.cx AS x1, b.cy AS y1 FROM e JOIN fb a ON a.bin_id = src JOIN fb b ON b.bin_id = dst",
    "kpi_summary": """SELECT sum(n)::BIGINT AS molecules, count(DISTINCT (bx, "by")) AS active_bins, count(DISTINCT gene) AS genes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) * 2 FROM e) AS adjacency_nnz,
100::DOUBLE * (1::DOUBLE - count(*)::DOUBLE / (count(DISTINCT (bx, "by")) * count(DISTINCT gene))::DOUBLE) AS sparsity_pct FROM fc""",
    "tile_assign": "SELECT * FROM t",
    "halo_tile": "SELECT x, y, gene, tile_x AS src_tile_x, tile_y AS src_tile_y FROM t WHERE tile_x BETWEEN 0 AND 2 AND tile_y BETWEEN -1 AND 1 AND x BETWEEN {tile} - {rad} AND 2 * {tile} + {rad} AND y BETWEEN -{rad} AND {tile} + {rad}",
    "tile_home": 'SELECT bx, "by", home_x, home_y, home_active FROM tw',
    "bin_owner": 'SELECT bx, "by", owner_x, owner_y FROM ow',
    "tile_counts": 'SELECT owner_x, owner_y, bx, "by", gene, n FROM sc JOIN ow USING (bx, "by")',
    "tile_edges": "SELECT DISTINCT * FROM (SELECT ax AS owner_x, ay AS owner_y, bx_a, by_a, bx_b, by_b FROM oe UNION ALL SELECT bxo, byo, bx_a, by_a, bx_b, by_b FROM oe)",
    "stitched_counts": 'SELECT bin_id, gene_id, n FROM sc JOIN si USING (bx, "by") JOIN g USING (gene)',
    "stitched_edges": "SELECT * FROM se",
    "stitched_laplacian": """SELECT v AS row, v AS col, count(*)::DOUBLE AS value FROM (SELECT src AS v FROM se UNION ALL SELECT dst FROM se) GROUP BY v
UNION ALL SELECT src, dst, -1::DOUBLE FROM se UNION ALL SELECT dst, src, -1::DOUBLE FROM se""",
}
_SELECTS |= {
    "tiles_written": _SELECTS["tile_assign"],
    "tile_file": _SELECTS["halo_tile"],
    "tiles_appended_counts": _SELECTS["stitched_counts"],
    "tiles_appended_laplacian": _SELECTS["stitched_laplacian"],
    "tiles_appended_metadata": "SELECT gene, gene_id, x0 AS x_min, y0 AS y_min FROM g, o",
    "stitched_files_counts": _SELECTS["stitched_counts"],
    "stitched_files_nodes": 'SELECT bin_id AS node, cx, cy FROM ow JOIN si USING (bx, "by")',
    "stitched_files_adjacency": "SELECT src AS row, dst AS col, 1::FLOAT AS value FROM se UNION ALL SELECT dst, src, 1::FLOAT FROM se",
    "stitched_files_laplacian": _SELECTS["stitched_laplacian"],
}


_DICTIONARY = """WITH dict AS (SELECT gene, (row_number() OVER (ORDER BY gene) - 1)::INTEGER AS gene_id FROM (SELECT event_type AS gene FROM events WHERE event_type <> 'click' UNION SELECT c_mktsegment FROM customer)) """


def _drawn(stream: str, of: str = "event_id") -> str:
    return f"(('0x' || md5('42:{stream}:' || {of})[1:13])::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"


def _synthetic_sql() -> str:
    at = []
    for c in "xy":
        normal = f"sqrt(-2::DOUBLE * ln(1::DOUBLE - {_drawn(f'near {c}/r')})) * cos(2::DOUBLE * pi() * {_drawn(f'near {c}/a')})"
        around = f"{_drawn(f'centre {c}', 'k')} * 400::DOUBLE + 50::DOUBLE + {normal} * 15::DOUBLE"
        at.append(f"round(least(greatest(CASE WHEN event_id < 500 THEN {_drawn(f'flat {c}')} * 490::DOUBLE + 10::DOUBLE ELSE {around} END, 10::DOUBLE), 500::DOUBLE), 6) AS {c}")
    genes = ", ".join(f"'{g}'" for g in synthetic.CLI_GENES)
    return f"SELECT event_id AS id, {', '.join(at)}, [{genes}][floor({_drawn('gene')} * 5)::INTEGER + 1] AS gene FROM (SELECT event_id, floor({_drawn('cluster')} * 5)::BIGINT AS k FROM events)"


_SYNTHETIC = _synthetic_sql()


def _sql(name: str, k: str) -> str:
    s = SOURCES[k]
    own = _SELECTS[name]
    for mark, value in (("wide", s.resolution), ("rad", s.radius), ("tile", s.tile)):
        own = own.replace(f"{{{mark}}}", f"{value!r}::DOUBLE")
    return _base(k) + own


def oracle_sql() -> dict[str, str]:
    out = {f"{name}_{k}": _sql(name, k) for name, (_, keys) in FORMS.items() for k in keys}
    base = _base("ev")
    each = ", ".join(f"sum(CASE WHEN gene = '{g}' THEN n ELSE 0 END)::BIGINT AS {g}" for g in EVENT_TYPES)
    out |= {
        "dense_matrix_ev": base + f'SELECT cx AS bin_x, cy AS bin_y, {each} FROM fc JOIN fb USING (bx, "by") GROUP BY cx, cy',
        "load_qv_filter_li": _base("li") + "SELECT l_extendedprice / 100::DOUBLE AS x, l_quantity * 10::DOUBLE AS y, concat(l_returnflag, l_linestatus) AS gene FROM lineitem WHERE l_quantity >= 20",
        "gene_filter_ev": "SELECT value AS x, user_id::DOUBLE AS y, event_type AS gene FROM events WHERE event_type = 'click'",
        "bin_labels_ev": base + "SELECT bin_id, 'Bin ' || bin_id || chr(10) || 'Total transcripts: ' || sum(n)::BIGINT AS label FROM fc JOIN fb USING (bx, \"by\") GROUP BY bin_id",
        "sample_ev": _sampled_sql("ev", ("event_id",)),
        "sample_li": _sampled_sql("li", ("l_orderkey", "l_linenumber")),
        "fixed_dictionary_ev": _DICTIONARY + "SELECT gene, gene_id FROM dict",
        "fixed_dictionary_coo_ev": base + _DICTIONARY.replace("WITH", ",", 1) + 'SELECT bin_id, coalesce(dict.gene_id, -1) AS gene_id, sum(n)::BIGINT AS n FROM fc JOIN fb USING (bx, "by") LEFT JOIN dict USING (gene) GROUP BY ALL',
        "fixed_dictionary_coo_cu": _base("cu") + _DICTIONARY.replace("WITH", ",", 1) + 'SELECT bin_id, coalesce(dict.gene_id, -1) AS gene_id, sum(n)::BIGINT AS n FROM sc JOIN sb USING (bx, "by") LEFT JOIN dict USING (gene) GROUP BY ALL',
        "synthetic_molecules_ev": _SYNTHETIC,
        "synthetic_csv_ev": f"SELECT x::FLOAT AS x, y::FLOAT AS y, gene FROM ({_SYNTHETIC})",
        "empty_exits_ev": "SELECT count(*) AS molecules, 0::BIGINT AS far_rows, 0::BIGINT AS edges, 0::BIGINT AS laplacian, 0::BIGINT AS far_bins, 0::BIGINT AS far_counts, 0::BIGINT AS far_edges FROM events",
        "load_csv_ev": base + "SELECT * FROM m",
        "load_csv_gz_ev": base + "SELECT * FROM m",
        "load_transcripts_ev": base + "SELECT x::FLOAT AS x, y::FLOAT AS y, gene FROM m",
        "export_edges_ev": base + "SELECT src AS source_bin, dst AS target_bin FROM e",
        "export_laplacian_ev": base + _SELECTS["laplacian"],
        "export_npz_ev": base + _SELECTS["laplacian"],
        "degree_labels_ev": base + "SELECT node, 'Bin ' || node || chr(10) || 'Degree: ' || degree AS label FROM dg",
    }
    out["export_dense_ev"] = out["dense_matrix_ev"]
    return out
