"""Synthetic molecules: distributions with fixed figures, made by the executors from ids and a seed.

Each row depends on its id and the seed alone (see functions.random): partitions, executors and retries change nothing, and the ids may be those of a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlace.functions import random

#: Fixed values of the two generators.
CLI_GENES = ("GAPDH", "ACTB", "MALAT1", "EPCAM", "CD3D")
BOARD_GENES = ("GAPDH", "ACTB", "EPCAM", "CD3D", "MS4A1", "ERBB2", "KRT19", "PECAM1", "COL1A1", "VIM")


def _clip(c, low: float, high: float):
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def molecules_of(ids: DataFrame, flat: int, seed: int = 42) -> DataFrame:
    """(id, x DOUBLE, y DOUBLE, gene) for each id: uniform in [10, 500) squared below flat, else around five centres in [50, 450) with deviation 15; five genes alike."""
    i = F.col("id")
    cluster = F.floor(random.uniform(seed, "cluster", i) * 5.0).cast("bigint")
    out = {}
    for c in "xy":
        centre = random.uniform(seed, f"centre {c}", cluster) * 400.0 + 50.0
        around = centre + random.normal(seed, f"near {c}", i) * 15.0
        out[c] = _clip(F.when(i < F.lit(flat), random.uniform(seed, f"flat {c}", i) * 490.0 + 10.0).otherwise(around), 10.0, 500.0).alias(c)
    return ids.select("id", out["x"], out["y"], random.choice(seed, "gene", CLI_GENES, i).alias("gene"))


def mock_molecules(spark: SparkSession, num_molecules: int = 15_000, seed: int = 42) -> DataFrame:
    """Half of num_molecules uniform, the rest in clusters."""
    drawn = molecules_of(spark.range(num_molecules), num_molecules // 2, seed)
    return drawn.select(F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), "gene")


def mock_dashboard(spark: SparkSession, seed: int = 42) -> DataFrame:
    """20 000 uniform in [50, 550) squared and eight clusters of 800 to 1999 with deviation 18; ten genes by drawn weights."""
    rng = np.random.default_rng(seed)  # figures of the clusters, a few numbers
    centres, sizes = rng.uniform(120, 480, (8, 2)), rng.integers(800, 2000, 8)
    ends = 20_000 + np.cumsum(sizes)
    shares = rng.dirichlet(np.ones(len(BOARD_GENES))).tolist()
    i, cx, cy = F.col("id"), F.lit(float(centres[-1][0])), F.lit(float(centres[-1][1]))
    for (a, b), e in reversed(list(zip(centres[:-1], ends[:-1], strict=True))):
        cx, cy = F.when(i < int(e), float(a)).otherwise(cx), F.when(i < int(e), float(b)).otherwise(cy)
    flat = i < 20_000
    at = {c: F.when(flat, random.uniform(seed, f"board flat {c}", i) * 500.0 + 50.0).otherwise(centre + random.normal(seed, f"board near {c}", i) * 18.0) for c, centre in (("x", cx), ("y", cy))}
    gene = random.choice(seed, "board gene", BOARD_GENES, i, shares=shares)
    return spark.range(int(ends[-1])).select(*(_clip(e, 50.0, 550.0).cast("float").alias(c) for c, e in at.items()), gene.alias("gene"))


def generate_vectorized_mock_data(spark: SparkSession, file_path: str, num_molecules: int = 15_000, seed: int = 42) -> None:
    """Write mock molecules as CSV files with header under file_path."""
    mock_molecules(spark, num_molecules, seed).write.mode("overwrite").csv(file_path, header=True)
