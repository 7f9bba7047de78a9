"""Planar point analytics on Spark DataFrames: binning, count matrices, radius graphs and tiles."""

from .operators.graph import build_spatial_graph
from .operators.matrix import build_sparse_matrix, compute_square_bins
from .operators.points import bin_hexagonal, bin_square, get_bin_centers
from .operators.tiles import load_tile_with_halo, partition_dataset_to_tiles, process_appended, process_tile_out_of_core, process_tiles, stitch_out_of_core_results
from .sources.points import download_dataset, load_coordinates, load_transcript_data
from .sources.synthetic import generate_vectorized_mock_data

__all__ = [
    "bin_hexagonal",
    "bin_square",
    "build_sparse_matrix",
    "build_spatial_graph",
    "compute_square_bins",
    "download_dataset",
    "generate_vectorized_mock_data",
    "get_bin_centers",
    "load_coordinates",
    "load_tile_with_halo",
    "load_transcript_data",
    "partition_dataset_to_tiles",
    "process_appended",
    "process_tile_out_of_core",
    "process_tiles",
    "stitch_out_of_core_results",
]
