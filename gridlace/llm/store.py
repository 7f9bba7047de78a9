"""Content-addressed store of token ids: chunks once, recipes in order, and a Merkle manifest.

Layout under a folder that all executors share, three Parquet tables:
``chunks`` (digest, data): a chunk of ids as little-endian unsigned integers, two bytes each where the
vocabulary fits, zstd-compressed; the digest is of the plain bytes. Each digest has one row.
``recipes`` (row, doc_id, start, n_tokens, digests): one row a document, sorted by row, in ascending
doc_id; start is the number of ids before it. ``manifest`` (level, node, hash): level 0 hashes blocks of
FAN recipes, each further level FAN nodes of the one below, the last has one node.

A rolling hash of 32 ids cuts the stream of each document, so equal passages give equal chunks
wherever they stand. Reading joins recipes with chunks and checks every digest; ``verify`` rebuilds the
manifest from the recipes as they are read.

Defined results: a null text is empty and has the end id alone; null ids come first, rows that share an id
follow by their digests; repeated rows are stored as recipes of the same chunks; an empty table gives
empty tables; only the id and the text column are read. A hot chunk has one small row for each
place; the join that hands out its data is split where it is skewed.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, tokens, words

#: Ids of a chunk: on average, at least and at most. Children of a node of the manifest.
MEAN, LEAST, MOST, FAN = 1024, 256, 8192, 1024
#: Digests that a task keeps in mind.
SEEN = 500_000
#: Rows that are put together at once.
ROWS = 512


def _digest(raw: bytes | memoryview) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def encode_chunks(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n_tokens, digests, data) of (doc_id, text); data has the plain bytes of a chunk where the task meets it first, else null."""

    def run(batches):
        enc, seen = tokens.encoder(path), set()
        size, end = enc.dtype.itemsize, enc.dtype.type(end_id)
        for batch in batches:
            bounds, data = words.utf8(batch.column(1))
            for i, j in words.spans(bounds, tokens.SLICE):
                ids, edges = enc.encode_bytes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                ids, edges = np.insert(ids, edges[1:], end), edges + np.arange(len(edges))
                raw = memoryview(ids).cast("B")
                digests, fresh = [], []
                for at, cuts in zip(edges[:-1].tolist(), tokens.cut_many(ids, edges, MEAN, LEAST, MOST), strict=True):
                    parts = [raw[(at + a) * size : (at + b) * size] for a, b in itertools.pairwise([0, *cuts])]
                    own = [_digest(p) for p in parts]
                    digests.append(own)
                    fresh.append([None if d in seen or seen.add(d) else p for d, p in zip(own, parts, strict=True)])
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(edges)), pa.array(digests, pa.list_(pa.binary())), pa.array(fresh, pa.list_(pa.binary()))], ["doc_id", "n_tokens", "digests", "data"])
        enc.forget()  # the worker may go on to other work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(words.freeing(run), f"doc_id {kind}, n_tokens long, digests array<binary>, data array<binary>")


def _pack(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(x.as_buffer()) for x in batch.column(1)], pa.binary())], ["digest", "data"])


def _placed(small: DataFrame, at: scratch.Scratch) -> DataFrame:
    """Rows in order with row and start: running sums within ranges of ids, and of the ranges on the driver (one row each)."""
    spark = small.sparkSession
    order = ["doc_id", "tie"]
    ranged = small.withColumn("tie", F.xxhash64("digests")).repartitionByRange(scratch.fanout(spark), *order).withColumn("part", F.spark_partition_id())
    ranged = at.table(ranged, "ranged")
    sums = ranged.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("ids")).orderBy("part").collect()
    before = itertools.accumulate(((r["rows"], r["ids"]) for r in sums), lambda a, b: (a[0] + b[0], a[1] + b[1]), initial=(0, 0))
    offsets = spark.createDataFrame([(r["part"], *b) for r, b in zip(sums, before, strict=False)], "part int, rows_before long, ids_before long")
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(offsets), "part").select(
        (F.count("*").over(own) - 1 + F.col("rows_before")).alias("row"), "doc_id", (F.sum("n_tokens").over(own) - F.col("n_tokens") + F.col("ids_before")).alias("start"), "n_tokens", "digests"
    )
    return placed.repartitionByRange(scratch.fanout(spark), "row").sortWithinPartitions("row")


def manifest(recipes: DataFrame) -> DataFrame:
    """(level, node, hash) of recipes; each node has FAN children at most."""
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", F.concat_ws(",", F.transform("digests", F.hex)))
    below = recipes.select(F.col("row").alias("node"), F.sha2(text, 256).alias("hash"))
    n, out, level = recipes.count(), None, 0
    while True:
        many = F.sort_array(F.collect_list(F.struct("node", "hash")))
        below = below.groupBy((F.col("node") / FAN).cast("long").alias("up")).agg(F.sha2(F.concat_ws("", F.transform(many, lambda x: x.hash)), 256).alias("hash")).withColumnRenamed("up", "node")
        own = below.select(F.lit(level).alias("level"), "node", "hash")
        out = own if out is None else out.unionByName(own)
        n, level = -(-n // FAN), level + 1
        if n <= 1:
            return out


def write(docs: DataFrame, at: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0) -> None:
    """Encode docs and write the store's tables under at."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    work = scratch.Scratch(spark, "store")
    with scratch.freeing_shuffles(spark):
        with scratch.short_batches(spark, tokens.SLICE * 7 // 8):  # one slice each; long ones would stand in the JVM and in the worker
            encoded = work.table(encode_chunks(docs, path or tokens.default_path(), end_id), "encoded")
        _placed(encoded.select("doc_id", "n_tokens", "digests"), work).write.option("compression", "zstd").parquet(f"{at}/recipes")
        each = encoded.select(F.explode(F.arrays_zip("digests", "data")).alias("x")).select(F.col("x.digests").alias("digest"), F.col("x.data").alias("data"))
        once = each.filter("data is not null").groupBy("digest").agg(F.min("data").alias("data"))
        once.mapInArrow(words.freeing(_pack), "digest binary, data binary").write.option("compression", "none").parquet(f"{at}/chunks")
        manifest(spark.read.parquet(f"{at}/recipes")).write.parquet(f"{at}/manifest")
    work.drop("encoded")
    work.drop("ranged")


def verify(spark: SparkSession, at: str) -> None:
    """ValueError if the recipes aren't those of the manifest."""
    stored = spark.read.parquet(f"{at}/manifest")
    now = manifest(spark.read.parquet(f"{at}/recipes"))
    same = stored.join(now.withColumnRenamed("hash", "now"), ["level", "node"], "full_outer")
    bad = same.filter("not (hash <=> now)").orderBy("level", "node").limit(1).collect()
    if bad:
        raise ValueError(f"manifest and recipes differ at level {bad[0]['level']}, node {bad[0]['node']}")


def read(spark: SparkSession, at: str, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) rebuilt from chunks; an error if a chunk is missing or isn't what its digest says."""
    size = tokens.dtype(path or tokens.default_path()).itemsize
    recipes, chunks = spark.read.parquet(f"{at}/recipes"), spark.read.parquet(f"{at}/chunks")
    places = recipes.select("row", "doc_id", "start", "n_tokens", F.posexplode("digests").alias("seq", "digest"))
    got = places.join(chunks.hint("shuffle_hash"), "digest")
    whole = got.groupBy("row", "doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("seq", "digest", "data")).alias("parts"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, len(b), ROWS)):
            out = []
            for n, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                plain = []
                for p in sorted(parts, key=lambda p: p["seq"]):
                    raw = unpack.decompress(p["data"])
                    if _digest(raw) != p["digest"]:
                        raise ValueError(f"chunk {p['digest'].hex()} has other bytes")
                    plain.append(raw)
                ids = b"".join(plain)
                if len(ids) != n * size:
                    raise ValueError("chunks are missing")
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return whole.select("doc_id", "start", "n_tokens", "parts").mapInArrow(words.freeing(run), f"doc_id {kind}, start long, n_tokens long, ids binary")


def checksums(stored: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read() gave, over unsigned 32-bit ids."""
    kind = tokens.dtype(path or tokens.default_path())

    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), dtype=kind).astype("<u4")) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    id_kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(words.freeing(run), f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long")


def op2_store(spark, sf_dir: str) -> DataFrame:
    at = scratch.Scratch(spark, "op2").at
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), at)
    verify(spark, at)
    return checksums(read(spark, at))
