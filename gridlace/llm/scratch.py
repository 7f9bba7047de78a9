"""Shared-folder tables that cut lineage, and checks of size before a broadcast."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this count may be broadcast (8 bytes each in Arrow, about 100 MB as a hash relation).
BROADCAST_ROWS = 1_000_000
#: Rows of a few numbers each that one task takes in without a shuffle.
PART_ROWS = 100_000

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir or of setCheckpointDir; without either, a temporary one in local mode alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gridlace-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def freeing_shuffles(spark: SparkSession):
    """Within it, the shuffle files of an execution go as soon as that execution ends."""
    return _setting(spark, _CLEAN, "true")


def short_batches(spark: SparkSession, size: int):
    """Within it, executions give Python tasks batches of about so many bytes, one row at least."""
    return _setting(spark, _BATCH, str(size))


_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables of a Scratch that was made within it, in this thread, go at its end: write what they were for before."""
    before = _made.set([])
    try:
        yield
    finally:
        for at in _made.get() or ():
            _delete(spark, at)
        _made.reset(before)


class Scratch:
    """Parquet tables of one operator call, in a new subfolder of the shared folder; they stay until the scope around the call ends, if there is one."""

    def __init__(self, spark: SparkSession, name: str, batch: int | None = None):
        """batch: short_batches() for what makes the tables."""
        self.batch = batch
        self.spark, self.at = spark, f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if (own := _made.get()) is not None:
            own.append(self.at)

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df once and return a reader of what was written; executors may be lost after that."""
        with freeing_shuffles(self.spark), short_batches(self.spark, self.batch) if self.batch else contextlib.nullcontext():
            df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def compact(self, df: DataFrame, name: str) -> DataFrame:
        """table(), read in as many partitions as its counted rows need; a table within one part is then grouped and joined without a shuffle."""
        out = self.table(df, name)
        return out.coalesce(max(1, -(-out.count() // PART_ROWS)))

    def small(self, table: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
        """A written table of ids, to be broadcast if its counted rows are within the bound, else as it is."""
        return F.broadcast(table) if table.count() <= bound else table

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, self.path(name))


def fanout(spark: SparkSession) -> int:
    """Shuffle partitions as the session has them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1 and so on, and these by the names they had; so no name can clash or need quotes."""
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at
