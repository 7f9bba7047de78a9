"""Counts of (bin, gene) as a sparse matrix in rows, and its other shapes.

Counts of (bin, gene) are written once to the shared folder, if there is one; bins, ids, totals and cells are made of them, so the
points are read twice (for the offset and for the counts) whatever follows. Ids are explicit columns: bins count from 0 in the
order of two key columns, genes in the order of their names. Bin ids come from ranges of the sorted keys, one task a range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlace.sources import shared

from . import points as P

#: Ids of the minor side that stand in one row of a compressed column.
BLOCK = 65536

#: Rows from which bounds of ranges are taken, for each range.
_BOUND_ROWS = 20


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)))
    return F.lit(value).cast(kind)


def _ranged(rows: DataFrame, major: str, minor: str) -> DataFrame:
    """rows with __part, the number of their range of the order; worked out alike however often the plan runs."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if shared.folder(rows.sparkSession) is not None:
        return shared.written(rows.repartitionByRange(parts, major, minor).withColumn("__part", F.spark_partition_id()))
    # nothing can be stored: bounds are the quantiles of a sample, the rows with the smallest hashes, and each row counts those below it
    drawn = rows.select(major, minor).orderBy(F.xxhash64(major, minor), major, minor).limit(_BOUND_ROWS * parts)
    bounds = drawn.distinct().orderBy(major, minor).collect()[_BOUND_ROWS::_BOUND_ROWS]
    kinds = [rows.schema[c].dataType for c in (major, minor)]
    key = F.struct(F.col(major).alias("a"), F.col(minor).alias("b"))
    if not bounds:
        return rows.withColumn("__part", F.lit(0))
    known = F.array(*(F.struct(_literal(a, kinds[0]).alias("a"), _literal(b, kinds[1]).alias("b")) for a, b in bounds))
    return rows.withColumn("__part", F.size(F.filter(known, lambda x: x <= key)))


def dense_ids(rows: DataFrame, major: str, minor: str, name: str) -> DataFrame:
    """rows, distinct in (major, minor), with their place in that order, from 0.

    Each range of the order is numbered by one task, however many rows a value of major has; the sizes of the ranges, one row each, give where it begins."""
    ranged = _ranged(rows, major, minor)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(major, minor)) - 1
    return ranged.withColumn("__rank", rank).join(F.broadcast(before), "__part").withColumn(name, (F.col("__rank") + F.col("__before")).cast("bigint")).drop("__part", "__rank", "__before")


#: The code of a gene that a given dictionary lacks.
UNKNOWN = -1


def gene_ids(genes: DataFrame) -> DataFrame:
    """(gene, gene_id) of the distinct genes in binary order; a dictionary that has gene_id already, as one shared by several data sets, stays as it is."""
    if "gene_id" in genes.columns:
        return genes.select("gene", "gene_id")
    return genes.select("gene").distinct().select("gene", (F.row_number().over(Window.orderBy("gene")) - 1).cast("int").alias("gene_id"))


def count_genes(binned: DataFrame, keys: tuple[str, str] = ("bx", "by")) -> DataFrame:
    """(keys, gene, n)."""
    return binned.groupBy(*keys, "gene").agg(F.count("*").alias("n"))


def bin_totals(counts: DataFrame, keys: tuple[str, str] = ("bx", "by")) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("total"))


@dataclass
class CountMatrix:
    """Parts of a count matrix. counts has (keys, gene, n), cells (bin_id, gene_id, n); fixed: genes is a given dictionary, which may lack some.

    Counts of genes that a dictionary lacks stand, added up, under the id UNKNOWN of their bin."""

    counts: DataFrame
    bins: DataFrame
    genes: DataFrame
    keys: tuple[str, str]
    fixed: bool = False

    @property
    def cells(self) -> DataFrame:
        with_bin = self.counts.join(self.bins.select(*self.keys, "bin_id"), list(self.keys))
        if not self.fixed:
            return with_bin.join(self.genes, "gene").select("bin_id", "gene_id", "n")
        coded = with_bin.join(self.genes, "gene", "left").select("bin_id", F.coalesce("gene_id", F.lit(UNKNOWN)).alias("gene_id"), "n")
        return coded.groupBy("bin_id", "gene_id").agg(F.sum("n").alias("n"))

    def compressed(self, matrix_format: str = "csr") -> DataFrame:
        return compressed(self.cells, matrix_format)


def build_sparse_matrix(binned: DataFrame, keys: tuple[str, str] = ("bx", "by"), order: tuple[str, str] | None = None, genes: DataFrame | None = None) -> CountMatrix:
    """Counts with bins in the order of keys (or order) and the observed genes, or all of a given dictionary."""
    counts = shared.written(count_genes(P.clean(binned) if "x" in binned.columns else binned.filter("gene is not null"), keys))
    bins = dense_ids(counts.select(*keys).distinct(), *(order or keys), "bin_id")
    return CountMatrix(counts, bins, gene_ids(counts if genes is None else genes), keys, genes is not None)


def compute_square_bins(points: DataFrame, resolution: float, genes: DataFrame | None = None) -> CountMatrix:
    """Binning by floor division, counts and centres in one plan; bins are in the order of (by, bx)."""
    points = P.clean(points)
    x0, y0 = P.origin(points)
    binned = P.bin_square(points, resolution, "floordiv").groupBy("bx", "by", "gene")
    counts = shared.written(binned.agg(F.count("*").alias("n"), F.any_value(x0).alias("x_min"), F.any_value(y0).alias("y_min")))
    bins = dense_ids(counts.groupBy("bx", "by").agg(F.any_value("x_min").alias("x_min"), F.any_value("y_min").alias("y_min")), "by", "bx", "bin_id")
    bins = P.get_bin_centers(bins, "square", resolution, (F.col("x_min"), F.col("y_min"))).drop("x_min", "y_min")
    counts = counts.select("bx", "by", "gene", "n")
    return CountMatrix(counts, bins, gene_ids(counts if genes is None else genes), ("bx", "by"), genes is not None)


def compressed(cells: DataFrame, matrix_format: str = "csr") -> DataFrame:
    """One row for each row (csr: bin_id) or block of a column (csc: gene_id, block): start and end in the list of all values, indices, data.

    A row has an entry for each gene at most; a column may have one for every bin, so it is given by blocks of BLOCK bin ids."""
    kind = matrix_format.lower()
    if kind not in ("csr", "csc"):
        raise ValueError(f"matrix_format must be 'csr' or 'csc', not {matrix_format!r}")
    own = lambda minor: F.array_sort(F.collect_list(F.struct(minor, "n"))).alias("own")
    if kind == "csr":
        major, minor, keys = "bin_id", "gene_id", ["bin_id"]
        lists = cells.groupBy(*keys).agg(F.count("*").alias("nnz"), own(minor)).withColumn("group", (F.col(major) / BLOCK).cast("bigint"))
    else:
        major, minor, keys = "gene_id", "bin_id", ["gene_id", "block"]
        lists = cells.withColumn("block", (F.col(minor) / BLOCK).cast("bigint")).groupBy(*keys).agg(F.count("*").alias("nnz"), own(minor)).withColumn("group", F.col(major))
    # prefix sums within blocks of rows, or within columns, whose totals are few
    sums = lists.groupBy("group").agg(F.sum("nnz").alias("all")).select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("before"))
    end = F.sum("nnz").over(Window.partitionBy("group").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    placed = lists.join(sums, "group").withColumn("row_end", end)
    return placed.select(*keys, (F.col("row_end") - F.col("nnz")).alias("row_start"), "row_end", F.transform("own", lambda c: c[minor]).alias("indices"), F.transform("own", lambda c: c["n"]).alias("data"))


def dense_matrix(counts: DataFrame, keys: tuple[str, ...], genes: list[str]) -> DataFrame:
    """One row for each bin, one column for each gene, zero where nothing was counted."""
    return counts.groupBy(*keys).pivot("gene", genes).agg(F.sum("n")).na.fill(0, genes)
