"""Points by tiles on disk, in batches: files along a Z-order curve, an index of what each file holds, and a log.

``points/batch=n``: the rows of one append, in files by ranges of a curve through quarters of quarters of tiles, so a file covers few tiles and
a crowded tile is several files. ``index/batch=n``: one row for each file and tile in it, with the smallest and largest coordinates;
a reader opens the files that hold what it wants, and no others. ``genes/batch=n``: the genes that no earlier batch had. ``log/n.json`` is written last and makes a
batch count; it has its smallest coordinates, so offset and dictionary of the whole are merged from batches, and an
append reads its own rows alone. One writer at a time; a batch that failed is written over by the next.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlace.functions import binning

#: Columns of what is stored; given to readers, as an empty table has no files.
POINTS = "x double, y double, gene string, tile_x bigint, tile_y bigint, batch int"
INDEX = "file string, tile_x bigint, tile_y bigint, n bigint, x_min double, x_max double, y_min double, y_max double, batch int"
#: Parts of a tile's side that the curve tells apart; files up to which a reader lists them.
PARTS, FILES = 64, 10_000


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def entries(spark: SparkSession, log: str) -> list[dict]:
    """Entries of a log from its last full one on, oldest first."""
    jvm, where = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in fs.listStatus(where) if fs.exists(where) else ():
        if status.getPath().getName().endswith(".json"):
            source = fs.open(status.getPath())
            try:
                rows.append(json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
            finally:
                source.close()
    rows.sort(key=lambda e: e["n"])
    return rows[max((i for i, e in enumerate(rows) if e["full"]), default=0) :]


def enter(spark: SparkSession, log: str, entry: dict) -> None:
    """Add an entry, which has its number n; it is there as a whole or not at all."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(log).getFileSystem(spark._jsc.hadoopConfiguration())
    sink = fs.create(at(f"{log}/{entry['n']}.part"), True)
    sink.write(bytearray(json.dumps(entry).encode()))
    sink.close()
    fs.rename(at(f"{log}/{entry['n']}.part"), at(f"{log}/{entry['n']}.json"))


def along_curve(df: DataFrame, x, y, *more: str) -> DataFrame:
    """df in ranges of the curve through cells (x, y), sorted in each; rows of one place are spread over ranges where they are many."""
    keyed = df.withColumns({"__z": binning.z_order(x, y), "__tie": F.monotonically_increasing_id()})
    return keyed.repartitionByRange("__z", "__tie").sortWithinPartitions("__z", *more).drop("__z", "__tie")


def append(tiled: DataFrame, tile_size: float, at: str, replace: bool = False, epoch: int | None = None) -> None:
    """Add (x, y, gene, tile_x, tile_y) as a batch, or with replace instead of all earlier ones; ValueError if those have tiles of another size.

    epoch: number of a batch of a stream; one that has been added already, before a restart, isn't added again."""
    spark = tiled.sparkSession
    known = entries(spark, f"{at}/log")
    if epoch is not None and any(e["epoch"] is not None and e["epoch"] >= epoch for e in known):
        return
    if known and not replace and known[-1]["tile_size"] != float(tile_size):
        raise ValueError(f"tiles there have the size {known[-1]['tile_size']!r}, not {tile_size!r}")
    n = known[-1]["n"] + 1 if known else 1
    fine = [F.floor(F.col(c) / F.lit(float(tile_size) / PARTS)).cast("bigint") for c in "xy"]
    along_curve(tiled, *fine, "tile_x", "tile_y").write.mode("overwrite").parquet(f"{at}/points/batch={n}")
    own = spark.read.schema(POINTS.removesuffix(", batch int")).parquet(f"{at}/points/batch={n}")
    bounds = [f(c).alias(f"{c}_{name}") for c in "xy" for name, f in (("min", F.min), ("max", F.max))]
    own.groupBy(F.col("_metadata.file_name").alias("file"), "tile_x", "tile_y").agg(F.count("*").alias("n"), *bounds).write.mode("overwrite").parquet(f"{at}/index/batch={n}")
    genes = own.select("gene").distinct()
    if known and not replace:
        genes = genes.join(read_genes(spark, at), "gene", "left_anti")
    genes.write.mode("overwrite").parquet(f"{at}/genes/batch={n}")
    least = spark.read.schema(INDEX.removesuffix(", batch int")).parquet(f"{at}/index/batch={n}").agg(F.min("x_min"), F.min("y_min")).first()
    enter(spark, f"{at}/log", {"n": n, "full": replace or not known, "tile_size": float(tile_size), "x_min": least[0], "y_min": least[1], "epoch": epoch})
    if replace:
        for e in known:
            for name in (f"log/{e['n']}.json", *(f"{x}/batch={e['n']}" for x in ("points", "index", "genes"))):
                delete(spark, f"{at}/{name}")


def _table(spark: SparkSession, at: str, name: str, schema: str) -> DataFrame:
    """Rows of the batches that count."""
    known = entries(spark, f"{at}/log")
    if not known:
        raise FileNotFoundError(f"{at}/log")
    return spark.read.schema(schema).parquet(f"{at}/{name}").filter(F.col("batch").between(known[0]["n"], known[-1]["n"]))


def read_points(spark: SparkSession, at: str, after: int = 0) -> DataFrame:
    """(x, y, gene, tile_x, tile_y) of all batches, or of those after a number."""
    return _table(spark, at, "points", POINTS).filter(F.col("batch") > after).drop("batch")


def read_index(spark: SparkSession, at: str) -> DataFrame:
    return _table(spark, at, "index", INDEX)


def read_genes(spark: SparkSession, at: str) -> DataFrame:
    return _table(spark, at, "genes", "gene string, batch int").select("gene")


def read_offset(spark: SparkSession, at: str, upto: int | None = None) -> tuple[float, float]:
    """The smallest coordinates of all batches, or of those up to a number; zeros where there are no points."""
    known = entries(spark, f"{at}/log")
    if not known:
        raise FileNotFoundError(f"{at}/log")
    own = [e for e in known if upto is None or e["n"] <= upto]
    return tuple(min((e[c] for e in own if e[c] is not None), default=0.0) for c in ("x_min", "y_min"))


def read_files(spark: SparkSession, at: str, held: DataFrame) -> DataFrame:
    """(x, y, gene, tile_x, tile_y) from those files that some rows of the index name."""
    paths = [f"{at}/points/batch={r['batch']}/{r['file']}" for r in held.select("batch", "file").distinct().limit(FILES + 1).collect()]
    if len(paths) > FILES:  # a large part of a large data set: no list of names, the caller's filter does it
        return read_points(spark, at)
    plain = POINTS.removesuffix(", batch int")
    return spark.read.schema(plain).parquet(*paths) if paths else spark.createDataFrame([], plain)
