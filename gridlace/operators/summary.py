"""Figures of a data set, labels for drawing, and a fixed-size sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlace.functions import random

SAMPLE_ROWS, SAMPLE_SEED = 30_000, 42
#: Leading hex digits of a hash that are counted at a time.
LEAD = 4


def kpi_summary(counts: DataFrame, edges: DataFrame, keys: tuple[str, str] = ("bx", "by")) -> DataFrame:
    """One row: molecules, active_bins, genes, edges, adjacency_nnz, sparsity_pct."""
    figures = counts.agg(F.sum("n").alias("molecules"), F.count_distinct(*keys).alias("active_bins"), F.count_distinct("gene").alias("genes"), F.count("*").alias("nnz"))
    links = edges.agg(F.count("*").alias("edges"))
    cells = F.col("active_bins") * F.col("genes")
    share = F.when(cells > 0, F.lit(100.0) * (F.lit(1.0) - F.col("nnz").cast("double") / cells.cast("double"))).otherwise(F.lit(0.0))
    return figures.crossJoin(F.broadcast(links)).select(F.coalesce("molecules", F.lit(0)).alias("molecules"), "active_bins", "genes", "edges", (F.col("edges") * 2).alias("adjacency_nnz"), share.alias("sparsity_pct"))


def sample(points: DataFrame, rows: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED, keys: list[str] | None = None) -> DataFrame:
    """min(rows, all) rows drawn without replacement: those with the smallest hashes of seed and keys (all columns, if none are given).

    The same rows for any partitioning. Two counts of leading digits, of at most 16**LEAD rows each, give the hash up to which rows are
    taken; of all others only those that share its leading digits are sorted. Rows that share a hash follow in the order of their columns."""
    names = points.columns
    plain = points.toDF(*(f"c{i}" for i in range(len(names))))
    own = [F.col(f"c{names.index(k)}") for k in keys] if keys else [F.col(c) for c in plain.columns]
    hashed = plain.withColumn("hash", random.digest(seed, "sample", *own))
    known, left = "", rows
    for level in (1, 2):
        digits = F.substring("hash", 1, LEAD * level)
        inside = hashed.filter(F.col("hash").startswith(known)) if known else hashed
        counts = inside.groupBy(digits.alias("lead")).agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("lead")))
        cut = upto.filter(F.col("upto") >= left).orderBy("lead").select("lead", (F.col("upto") - F.col("n")).alias("before")).first()
        if cut is None:  # fewer rows than asked for
            return points
        known, left = cut["lead"], left - cut["before"]
    below = hashed.filter(F.substring("hash", 1, len(known)) < F.lit(known))
    rest = hashed.filter(F.col("hash").startswith(known)).orderBy("hash", *plain.columns).limit(left)
    return below.unionByName(rest).drop("hash").toDF(*names)


def only_gene(points: DataFrame, gene: str) -> DataFrame:
    return points.filter(F.col("gene") == gene)


def bin_labels(totals: DataFrame) -> DataFrame:
    """(bin_id, label) of (bin_id, total)."""
    return totals.select("bin_id", F.format_string("Bin %d\nTotal transcripts: %d", F.col("bin_id"), F.col("total")).alias("label"))


def degree_labels(degrees: DataFrame) -> DataFrame:
    return degrees.select("node", F.format_string("Bin %d\nDegree: %d", F.col("node"), F.col("degree")).alias("label"))
