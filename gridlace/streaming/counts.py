"""Counts that grow with a folder of CSV files: the bins and counts of the batch operators over a stream.

The offset must be given, as the smallest coordinate of a stream isn't known. State is one row for each (bin, gene).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlace.operators import matrix
from gridlace.operators import points as P


def read_points(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Streaming (x, y, gene) of CSV files with that header."""
    return spark.readStream.schema("x double, y double, gene string").option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def running_counts(points: DataFrame, resolution: float, offset: tuple[float, float], mode: str = "floor") -> DataFrame:
    """Streaming (bx, by, gene, n); write it in complete or update mode."""
    return matrix.count_genes(P.bin_square(points, resolution, mode, offset))
