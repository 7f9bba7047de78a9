"""Distributed prefix sums: rows in a total order with their ranks and running sums, a range of the order in each task."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words


def scan(df: DataFrame, keys: list[str], store: scratch.Scratch, name: str, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """df with rank (from 0, in the order of keys, nulls first) and for each of sums and xors a column c_upto: the sum, or the exclusive
    or, of c (BIGINT, no nulls) over all rows up to this one, itself included.

    Each task scans one range of the sorted rows as a stream; the ranges' own totals, one row each, are added up on the driver.
    A group of any size is spread over ranges as long as the keys tell its rows apart."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(scratch.fanout(spark), *keys).sortWithinPartitions(*keys)
    values = [*((c, np.add) for c in sums), *((c, np.bitwise_xor) for c in xors)]
    plain = df.columns
    at = [plain.index(c) for c, _ in values]
    added = ["part", "rank", *(f"{c}_upto" for c, _ in values)]

    def run(batches):
        part, n, totals = TaskContext.get().partitionId(), 0, [np.int64(0)] * len(values)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            cols = [pa.array(np.full(size, part, dtype=np.int64)), pa.array(np.arange(n, n + size))]
            for k, (_, op) in enumerate(values):
                upto = op(op.accumulate(batch.column(at[k]).to_numpy()), totals[k])
                totals[k] = upto[-1]
                cols.append(pa.array(upto))
            n += size
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*plain, *added])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` long" for c in added)])
    local = store.table(ranged.mapInArrow(words.freeing(run), kinds), name)
    own = local.groupBy("part").agg(F.count("*").alias("rank"), *(F.sum(c).alias(f"{c}_upto") for c in sums), *(F.bit_xor(c).alias(f"{c}_upto") for c in xors))
    totals = [[r[c] for c in added] for r in own.orderBy("part").collect()]
    ops = [lambda a, b: a + b] * (1 + len(sums)) + [lambda a, b: a ^ b] * len(xors)
    before = itertools.accumulate((t[1:] for t in totals), lambda a, b: [op(x, y) for op, x, y in zip(ops, a, b, strict=True)], initial=[0] * len(ops))
    rows = [(t[0], *b) for t, b in zip(totals, before, strict=False)]
    offsets = spark.createDataFrame(rows, ", ".join(f"`{c}` long" for c in ["part", *(f"{c}_before" for c in added[1:])]))
    whole = local.join(F.broadcast(offsets), "part")
    exact = {c: F.col(c) + F.col(f"{c}_before") for c in added[1 : 2 + len(sums)]} | {c: F.col(c).bitwiseXOR(F.col(f"{c}_before")) for c in added[2 + len(sums) :]}
    return whole.select(*plain, *(e.alias(c) for c, e in exact.items()))
