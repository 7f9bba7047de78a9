"""Writers of results: CSV, Parquet and compressed NumPy arrays."""

from __future__ import annotations

import io
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries up to which a matrix may be gathered on the driver for one .npz file.
NPZ_ENTRIES = 20_000_000
#: Entries (or one row, if it has more) and span of rows of a shard.
SHARD_ENTRIES, SHARD_ROWS = 4_000_000, 1 << 20
_SHARD = "shard bigint, row_from bigint, row_to bigint, entries_before bigint, n bigint, npz binary"


def export_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header; one_file is for results of a size for one reader."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def export_edges(edges: DataFrame, path: str) -> None:
    """(source_bin, target_bin), each undirected edge once."""
    export_csv(edges.select(F.col("src").alias("source_bin"), F.col("dst").alias("target_bin")), path)


def export_matrix(entries: DataFrame, path: str) -> None:
    """(row, col, value) as Parquet."""
    entries.write.mode("overwrite").parquet(path)


def export_npz(entries: DataFrame, path: str, size: int) -> None:
    """(row, col, value) of a size x size matrix as compressed sparse rows in a local .npz; ValueError beyond NPZ_ENTRIES."""
    n = entries.count()
    if n > NPZ_ENTRIES:
        raise ValueError(f"{n} entries are too many for one file; write Parquet by export_matrix()")
    df = entries.orderBy("row", "col").toPandas()
    indptr = np.concatenate([[0], np.cumsum(np.bincount(df["row"], minlength=size))])
    np.savez_compressed(path, indices=df["col"].to_numpy(), indptr=indptr, data=df["value"].to_numpy(), shape=np.array([size, size]), format=np.array(b"csr"))


def _shards(entries: DataFrame, limit: int) -> DataFrame:
    """(row, block, nth, before): rows that have entries, the shard they go to and the entries before them."""
    rows = entries.groupBy("row").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("row") / SHARD_ROWS).cast("bigint"))
    blocks = rows.groupBy("block").agg(F.sum("n").alias("all"))  # one row for each SHARD_ROWS rows of the matrix
    blocks = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("blocks_before"))
    own = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("within", F.sum("n").over(own) - F.col("n")).join(blocks, "block")
    return inside.select("row", "block", F.floor(F.col("within") / limit).cast("bigint").alias("nth"), (F.col("within") + F.col("blocks_before")).alias("before"))


def export_npz_shards(entries: DataFrame, path: str, size: int, limit: int = SHARD_ENTRIES) -> None:
    """(row, col, value) of a size x size matrix as shards of compressed sparse rows, built by the executors: a table with the bytes of one .npz a row.

    A shard has whole rows, row_from to row_to, and says how many entries come before it; rows that are in none are empty. Columns in a row are in ascending order."""

    def pack(table: pa.Table) -> pa.Table:
        row, col, value, before = (table[c].to_numpy() for c in ("row", "col", "value", "before"))
        order = np.lexsort((col, row))
        first, last = int(row.min()), int(row.max()) + 1
        starts = np.concatenate([[0], np.cumsum(np.bincount(row - first, minlength=last - first))])
        out = io.BytesIO()
        np.savez_compressed(out, indices=col[order], indptr=starts, data=value[order], shape=np.array([last - first, size]), format=np.array(b"csr"))
        row_ = [[int(table["block"][0].as_py()) << 32 | int(table["nth"][0].as_py())], [first], [last], [int(before.min())], [len(row)], [out.getvalue()]]
        return pa.table([pa.array(v, t) for v, t in zip(row_, [pa.int64()] * 5 + [pa.binary()], strict=True)], names=["shard", "row_from", "row_to", "entries_before", "n", "npz"])

    placed = entries.join(_shards(entries, limit), "row")
    placed.groupBy("block", "nth").applyInArrow(pack, _SHARD).write.mode("overwrite").parquet(path)


def read_npz_shards(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(row, col, value) of shards."""

    def unpack(batches):
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with np.load(io.BytesIO(raw.as_buffer())) as z:
                    row = first + np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(z["indices"]), pa.array(z["data"])], ["row", "col", "value"])

    return spark.read.schema(_SHARD).parquet(path).select("row_from", "npz").mapInArrow(unpack, f"row bigint, col bigint, value {kind}")


def save_npz_shards(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Copy shards to .npz files in a local folder, one at a time; their names, in the order of rows."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for r in spark.read.schema(_SHARD).parquet(path).orderBy("row_from").toLocalIterator():
        out.append(os.path.join(folder, f"rows_{r['row_from']}_{r['row_to']}.npz"))
        with open(out[-1], "wb") as f:
            f.write(r["npz"])
    return out
