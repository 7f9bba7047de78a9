"""Substring dedup: Rabin-Karp hashes of every 50-word window, counted in Spark.

Neighbouring rows of a task form units of up to UNIT bytes of text (one row at least), written once to the
shared folder; ids have no part in it, so rows that share one id, or have none, are spread like others.
Pass 1 splits the texts of a unit into words, hashes every window of WIDTH consecutive words to 64 bits and packs the
hashes by buckets of hash values, with the unit and the smallest and largest id they have there; so a
window has one entry a unit, not one a document. Per bucket, numpy finds the smallest id of each window
and tells every unit which of its windows also start in a smaller document.
Pass 2 joins units with those windows and merges the words they cover into maximal removal intervals.

Volume: 8 bytes a word and a little for ids; no row per word. The number of buckets follows the
counted bytes of text, so that one holds about BUCKET bytes of hashes, and is twice the partitions at least. Beyond 2**RANGE_BITS buckets (some 40 GB of
text) windows are dealt by ranges first and split into buckets by a second shuffle, so that packed rows stay long. A
collision of 64-bit hashes would remove a window wrongly; n windows have about n * n / 2**65 of them.

Defined results: ids must be integers (TypeError otherwise); a null text has no words; a null id counts as larger
than all others; rows that share one id (or have none) never remove each other's words; fewer words than WIDTH: nothing
goes; a text of any length is taken whole; an empty table gives an empty one; only the id and the text column are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import scratch, words

WIDTH = 50
#: Bytes of text of a unit, bytes of text gathered before blocks go out, bytes of hashes meant for a bucket.
UNIT, GATHER, BUCKET = 2 << 20, 24 << 20, 32 << 20
#: Bits of a hash that blocks are first dealt by, and bytes of hashes of one range that are gathered before it is split into buckets.
RANGE_BITS, AGAIN = 11, 64 << 20
_LAST = np.iinfo(np.int64).max


def _windows(data: np.ndarray, bounds: np.ndarray, width: int):
    starts, ends, first = words.split(data, bounds)
    h, at, doc = words.doc_windows(words.word_hashes(data, starts, ends), first, width)
    return starts, ends, first, h, at, doc


def _units(texts: DataFrame) -> DataFrame:
    """(unit, size, ids, ends, packed): neighbouring rows of a task; ids and ends as 64-bit integers, texts as one zstd frame."""

    def run(batches):
        pack, base, k = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            bounds, data = words.utf8(batch.column(1))
            for i, j in words.spans(bounds, UNIT):
                a, b = int(bounds[i]), int(bounds[j])
                row = [[base + k], [b - a], [ids[i:j].tobytes()], [(bounds[i + 1 : j + 1] - a).tobytes()], [pack.compress(data[a:b].tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["unit", "size", "ids", "ends", "packed"])
                k += 1

    return texts.mapInArrow(words.freeing(run), "unit long, size long, ids binary, ends binary, packed binary")


def _rows(unit: dict, unpack: zstandard.ZstdDecompressor):
    """Slices of a unit's texts: (bytes, bounds, ids)."""
    ids = np.frombuffer(unit["ids"], dtype=np.int64)
    bounds = np.concatenate([[0], np.frombuffer(unit["ends"], dtype=np.int64)])
    data = np.frombuffer(unpack.decompress(unit["packed"], max_output_size=max(1, unit["size"])), dtype=np.uint8)
    for i, j in words.spans(bounds):
        yield data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], ids[i:j]


def _once(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once, in order of first places, with its smallest and largest doc."""
    if not len(h):
        return h, doc, doc
    order = np.argsort(h, kind="stable")
    sh, sd = h[order], doc[order]
    lead = np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]]))
    first = order[lead]
    low, high = np.zeros_like(doc), np.zeros_like(doc)
    low[first], high[first] = np.minimum.reduceat(sd, lead), np.maximum.reduceat(sd, lead)
    keep = np.zeros(len(h), dtype=bool)
    keep[first] = True
    return h[keep], low[keep], high[keep]


_PACKED = "bucket int, hashes binary, units binary, low binary, more binary"


def _blocks(kept: list[tuple[np.ndarray, ...]], shift: int, spread: int):
    """Rows of _PACKED out of (hashes, units, low, more), by the bits of the hashes from shift on; of these the lowest spread bits differ."""
    pack = zstandard.ZstdCompressor(level=1)
    h, unit, low, more = (np.concatenate(x) for x in zip(*kept, strict=True))
    at = (h >> np.uint64(shift)).astype(np.uint32) if shift < 64 else np.zeros(len(h), dtype=np.uint32)
    part = at & np.uint32((1 << spread) - 1)
    order = np.argsort(part.astype(np.uint16) if spread <= 16 else part, kind="stable")
    h, unit, low, more, at = (x[order] for x in (h, unit, low, more, at))
    edges = np.append(np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1)), len(at)).tolist()
    for k in range(0, len(edges) - 1, 64):
        cut = list(zip(edges[k : k + 64], edges[k + 1 : k + 65]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(at[i]) for i, _ in cut], pa.int32()),
                pa.array([h[i:j].tobytes() for i, j in cut], pa.binary()),
                *(pa.array([pack.compress(np.diff(x[i:j], prepend=0).tobytes()) for i, j in cut], pa.binary()) for x in (unit, low, more)),
            ],
            ["bucket", "hashes", "units", "low", "more"],
        )


def _opened(hashes, rest, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, ...]:
    """Hashes, units, low and more of a row of _PACKED."""
    return np.frombuffer(hashes, dtype=np.uint64), *(np.cumsum(np.frombuffer(unpack.decompress(x), dtype=np.int64)) for x in rest)


def _buckets(units: DataFrame, width: int, buckets: int) -> DataFrame:
    """Packed windows of a few units of a task, by buckets; beyond RANGES of them in two steps.

    A row should hold many hashes, so a task deals what it gathers to RANGES ranges at most. Where these are not the buckets themselves, they are
    dealt out once more: tasks that have gathered more of one range split it into its buckets."""
    bits = int(buckets - 1).bit_length()
    first = min(bits, RANGE_BITS)

    def run(batches):
        unpack, kept, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                unit = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                found = [(h, ids[doc]) for data, bounds, ids in _rows(unit, unpack) for *_, h, _, doc in [_windows(data, bounds, width)]]
                if not found:
                    continue
                h, low, high = _once(*(np.concatenate(x) for x in zip(*found, strict=True)))
                kept.append((h, np.full(len(h), unit["unit"]), low, high - low))
                size += unit["size"]
                if size >= GATHER:
                    yield from _blocks(kept, 64 - first, first)
                    kept, size = [], 0
        if kept:
            yield from _blocks(kept, 64 - first, first)

    packed = units.mapInArrow(words.freeing(run), _PACKED)
    if bits == first:
        return packed

    def split(batches):
        unpack, kept, size, own = zstandard.ZstdDecompressor(), [], 0, None
        for batch in batches:
            for k in range(batch.num_rows):
                at = batch.column(0)[k].as_py()
                if kept and (at != own or size >= AGAIN):
                    yield from _blocks(kept, 64 - bits, bits - first)
                    kept, size = [], 0
                own = at
                kept.append(_opened(batch.column(1)[k].as_buffer(), [batch.column(c)[k].as_buffer() for c in (2, 3, 4)], unpack))
                size += len(kept[-1][0]) * 8
        if kept:
            yield from _blocks(kept, 64 - bits, bits - first)

    # a range goes to as many tasks as there are partitions for each
    parts = scratch.fanout(units.sparkSession)
    salt = F.pmod(F.spark_partition_id(), F.lit(-(-parts // (1 << first))) if parts > 1 << first else F.lit(1))
    dealt = packed.withColumn("salt", salt).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket").drop("salt")
    return dealt.mapInArrow(words.freeing(split), _PACKED)


def _repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: for each unit, the windows that start in a smaller document than one there, and the smallest document."""
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    rows = zip(*(table.column(name) for name in ("hashes", "units", "low", "more")), strict=True)
    h, unit, low, more = (np.concatenate(x) for x in zip(*(_opened(r[0].as_buffer(), [x.as_buffer() for x in r[1:]], unpack) for r in rows), strict=True))
    order = np.argsort(h, kind="stable")
    h = h[order]
    lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    least = np.repeat(np.minimum.reduceat(low[order], lead), np.diff(np.append(lead, len(h)))) if len(h) else low
    told = np.flatnonzero((low + more)[order] > least)
    h, unit, least = h[told], unit[order][told], least[told]
    order = np.argsort(unit, kind="stable")
    h, unit, least = h[order], unit[order], least[order]
    edges = np.append(np.flatnonzero(np.diff(unit, prepend=-1)), len(unit)).tolist()
    cut = list(zip(edges[:-1], edges[1:]))
    return pa.table(
        {
            "unit": pa.array([int(unit[i]) for i, _ in cut], pa.int64()),
            "hashes": pa.array([h[i:j].tobytes() for i, j in cut], pa.binary()),
            "least": pa.array([pack.compress(least[i:j].tobytes()) for i, j in cut], pa.binary()),
        }
    )


def _cut(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, known: np.ndarray, least: np.ndarray, width: int):
    """Words, removed words, kept texts and removal intervals (in words) of documents of one unit; known is sorted."""
    starts, ends, first, h, at, doc = _windows(data, bounds, width)
    mine = ids[doc]
    found = np.zeros(len(h), dtype=bool)
    if len(known):
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        found = (known[k] == h) & (least[k] < mine)
    cover = np.zeros(len(starts) + 1, dtype=np.int32)
    np.add.at(cover, at[found], 1)
    np.add.at(cover, at[found] + width, -1)
    gone = np.cumsum(cover[:-1]) > 0
    kept = np.flatnonzero(~gone)
    owner = np.searchsorted(first, kept, side="right") - 1
    last = np.ones(len(kept), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    # a kept word that isn't its document's last is followed by white space: that byte becomes the blank
    edge = ends[kept] + ~last
    text = data.copy()
    text[ends[kept][~last]] = 0x20
    mask = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(mask, starts[kept], 1)
    np.add.at(mask, edge, -1)
    mask = np.cumsum(mask[:-1], dtype=np.int8) > 0
    sizes = np.concatenate([[0], np.cumsum(mask)])[bounds]
    step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    n = np.diff(first)
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
    intervals = []
    for d in range(len(n)):
        i, j = np.searchsorted(end, first[d], side="right"), np.searchsorted(begin, first[d + 1])
        intervals.append([x for a, b in zip(begin[i:j], end[i:j], strict=True) for x in (max(0, int(a - first[d])), min(int(n[d]), int(b - first[d])))] if lost[d] else [])
    return n, lost, sizes, text[mask], intervals


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): removed has starts and ends of maximal intervals, in words."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"ids must be integers, not {kind.simpleString()}")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))).alias("id"), F.col(text_col).cast("string").alias("text"))
    store = scratch.Scratch(spark, "substring")
    units = store.table(_units(texts), "units", codec="none")
    if buckets is None:
        size = units.agg(F.sum("size")).first()[0] or 0
        buckets = 1 << max(4, (2 * scratch.fanout(spark)).bit_length(), (8 * size // 5 // BUCKET).bit_length())
    told = _buckets(units, width, buckets).groupBy("bucket").applyInArrow(_repeats, "unit long, hashes binary, least binary")
    told = store.table(told, "told").groupBy("unit").agg(F.collect_list(F.struct("hashes", "least")).alias("told"))
    joined = units.join(told.hint("shuffle_hash"), "unit", "left").select("size", "ids", "ends", "packed", "told")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                unit = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                t = unit["told"] or []
                known = np.concatenate([np.frombuffer(x["hashes"], dtype=np.uint64) for x in t] or [np.zeros(0, dtype=np.uint64)])
                least = np.concatenate([np.frombuffer(unpack.decompress(x["least"]), dtype=np.int64) for x in t] or [np.zeros(0, dtype=np.int64)])
                order = np.argsort(known, kind="stable")
                known, least = known[order], least[order]
                for data, bounds, ids in _rows(unit, unpack):
                    n, lost, sizes, text, intervals = _cut(data, bounds, ids, known, least, width)
                    out = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), out, pa.array(intervals, pa.list_(pa.int64()))], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    done = joined.mapInArrow(words.freeing(run), "doc_id long, n_words long, n_removed long, kept_text string, removed array<long>")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def op1_substring(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_removed_values"))
