"""Tables in the folder that the driver and all executors share (spark.checkpoint.dir): written once, read by all later steps.

Where a session names no such folder nothing is written: the same plans run, give the same rows, and read their input once more for each step.
Tables stay until the caller is done with what was made of them: ``with scope(spark): ...`` deletes those that were written within.
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def folder(spark: SparkSession) -> str | None:
    """A new path in the shared folder, or None where the session names no such folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        return None
    path = f"{at.rstrip('/')}/gridlace-{uuid.uuid4().hex}"
    if (own := _made.get()) is not None:
        own.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, so that what it was made of is read once; df itself where there is no shared folder."""
    at = folder(df.sparkSession)
    if at is None:
        return df
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Paths that folder() gave within it, in this thread, are deleted at its end: consume or write results before."""
    before = _made.set([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _made.get() or ():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        _made.reset(before)
