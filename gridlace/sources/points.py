"""Readers of point tables: aliases, quality filter, types, and errors for what isn't there."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted column names and what they stand for, in the order in which they are taken.
ALIASES = {"x_location": "x", "y_location": "y", "feature_name": "gene", "x": "x", "y": "y", "gene": "gene", "qv": "qv"}
#: Texts that a CSV reader of the data frame world takes for null.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Bytes that are copied at a time, and bytes between two lines of progress.
_BLOCK, _TOLD = 64 * 1024, 8 << 20


def _copy(spark: SparkSession, source, sink, total: int = 0, name: str = "") -> None:
    """Stream bytes within the JVM; the share of total that has arrived is printed."""
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    if not total:
        copy(source, sink, _BLOCK, False)
        return
    done = -1
    while done < sink.getPos():
        done = sink.getPos()
        copy(source, sink, _TOLD, False)
        print(f"\r{name}: {100 * sink.getPos() // total} %", end="", flush=True)
    print()


def download_dataset(url: str, output_dir: str, spark: SparkSession | None = None) -> str:
    """Fetch url into output_dir unless it is there, unpack a zip unless it is unpacked; the path of the file or folder.

    output_dir may be in any file system that Spark knows, so that executors can read what was fetched; a path without a scheme is in the default one.
    Files get their names when they are complete. An entry of a zip that leads out of its folder is an error."""
    spark = spark or SparkSession.builder.getOrCreate()
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    fs = at(output_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(output_dir))
    name = os.path.basename(urlparse(url).path) or "dataset"
    target = f"{output_dir.rstrip('/')}/{name}"
    if not fs.exists(at(target)):
        link = jvm.java.net.URI(url).toURL().openConnection()
        link.setRequestProperty("User-Agent", "Mozilla/5.0 (point-analytics)")
        source, sink = link.getInputStream(), fs.create(at(f"{target}.part"), True)
        try:
            _copy(spark, source, sink, max(0, link.getContentLengthLong()), name)
        finally:
            sink.close()
            source.close()
        fs.rename(at(f"{target}.part"), at(target))
    if not name.endswith(".zip"):
        return target
    folder = target[: -len(".zip")]
    if not fs.exists(at(folder)):
        fs.delete(at(f"{folder}.part"), True)
        fs.mkdirs(at(f"{folder}.part"))
        packed = jvm.java.util.zip.ZipInputStream(fs.open(at(target)))
        try:
            while (entry := packed.getNextEntry()) is not None:
                inner = entry.getName()
                if inner.startswith("/") or ".." in inner.split("/"):
                    raise ValueError(f"{name} has an entry outside its folder: {inner!r}")
                if entry.isDirectory():
                    fs.mkdirs(at(f"{folder}.part/{inner}"))
                    continue
                sink = fs.create(at(f"{folder}.part/{inner}"), True)
                try:
                    _copy(spark, packed, sink)
                finally:
                    sink.close()
        finally:
            packed.close()
        fs.rename(at(f"{folder}.part"), at(folder))
    return folder


def require(spark: SparkSession, path: str) -> None:
    """FileNotFoundError unless path exists in its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its ending, anything else as CSV with a header (packed ones are read by one task each); texts only."""
    require(spark, path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True)


def _null(name: str, df: DataFrame):
    c = F.col(f"`{name}`")
    return F.when(~c.isin(*NULLS), c) if df.schema[name].dataType.simpleString() == "string" else c


def standardise(raw: DataFrame, min_qv: float | None = 20.0, kind: str = "double") -> DataFrame:
    """(x, y, gene) of a table under any accepted names; rows below min_qv go where there is a qv, and so do NaN ones."""
    found = [c for c in ALIASES if c in raw.columns]
    names = [ALIASES[c] for c in found]
    for n in ("x", "y", "gene"):
        if names.count(n) > 1:
            raise ValueError(f"several columns stand for {n}: {[c for c in found if ALIASES[c] == n]}")
        if n not in names:
            raise ValueError(f"no column stands for {n}; accepted names: {[c for c, m in ALIASES.items() if m == n]}")
    df = raw.select(*(_null(c, raw).alias(ALIASES[c]) for c in found))
    if "qv" in names and min_qv is not None:
        qv = F.col("qv").cast("double")
        df = df.filter((qv >= F.lit(float(min_qv))) & ~F.isnan(qv))
    return df.select(F.col("x").cast(kind), F.col("y").cast(kind), F.col("gene").cast("string"))


def load_coordinates(spark: SparkSession, file_path: str, min_qv: float | None = 20.0) -> DataFrame:
    """(x DOUBLE, y DOUBLE, gene STRING) of a CSV, packed CSV or Parquet file."""
    return standardise(read_table(spark, file_path), min_qv)


def load_transcript_data(spark: SparkSession, file_path: str) -> DataFrame:
    """(x FLOAT, y FLOAT, gene STRING) of a CSV with these columns; all others are pruned at the scan."""
    require(spark, file_path)
    raw = spark.read.csv(file_path, header=True)
    missing = [c for c in ("x", "y", "gene") if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return raw.select(_null("x", raw).cast("float").alias("x"), _null("y", raw).cast("float").alias("y"), _null("gene", raw).alias("gene"))
