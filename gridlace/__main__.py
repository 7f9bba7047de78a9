"""python -m gridlace: bins and the radius graph of one file or of mock data; prints a summary, writes on request."""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, matrix, summary
from .sources import exports, synthetic
from .sources import points as sources


def run(spark: SparkSession, points: DataFrame, resolution: float, max_dist: float, output: str | None = None) -> DataFrame:
    """The one-row summary; with output, counts, bins, edges and the Laplacian are written below it."""
    m = matrix.compute_square_bins(points, resolution)
    edges = graph.neighbours(m.bins.select(F.col("bin_id").alias("node"), "cx", "cy"), max_dist, graph.lattice_bound(resolution, max_dist))
    if output:
        m.cells.write.mode("overwrite").parquet(f"{output}/counts")
        m.bins.write.mode("overwrite").parquet(f"{output}/bins")
        m.genes.write.mode("overwrite").parquet(f"{output}/genes")
        exports.export_edges(edges, f"{output}/edges")
        exports.export_matrix(graph.laplacian(edges), f"{output}/laplacian")
    return summary.kpi_summary(m.counts, edges)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridlace", description=__doc__)
    parser.add_argument("--input", help="CSV with x, y, gene, or Parquet with any accepted names")
    parser.add_argument("--min_qv", type=float, help="least quality of points; reads any accepted names from CSV too")
    parser.add_argument("--resolution", type=float, default=10.0)
    parser.add_argument("--max_dist", type=float, default=15.0)
    parser.add_argument("--generate-mock", action="store_true", help="use mock data, even with --input")
    parser.add_argument("--output", help="folder for results")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gridlace").getOrCreate()
    if args.generate_mock or not args.input:
        at = f"{tempfile.mkdtemp(prefix='gridlace-')}/mock.csv"
        if spark.sparkContext.master.startswith("local"):
            synthetic.generate_vectorized_mock_data(spark, at)
            points = sources.load_transcript_data(spark, at)
        else:  # a driver's folder isn't shared
            points = synthetic.mock_molecules(spark)
    else:
        plain = args.min_qv is None and not args.input.rstrip("/").endswith(".parquet")
        points = sources.load_transcript_data(spark, args.input) if plain else sources.load_coordinates(spark, args.input, args.min_qv)
    s = run(spark, points, args.resolution, args.max_dist, args.output).first()
    print(f"molecules: {s.molecules}\nactive bins: {s.active_bins}\ngenes: {s.genes}\nadjacency entries: {s.adjacency_nnz}\nLaplacian: {s.active_bins} x {s.active_bins}")


if __name__ == "__main__":
    main()
