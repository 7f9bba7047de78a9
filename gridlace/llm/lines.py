"""Line dedup across sites: HyperLogLog sketches of the sites of each line, merged by aggregation.

A line is a text's part between newlines, stripped of white space at both ends; empty lines are
never boilerplate. Each task hashes its lines to 64 bits and passes on each (line, site)
pair once. A first count of pairs drops lines that can't reach the threshold (a sum over tasks
bounds the number of sites from above); for all others Spark merges sketches of their
sites. Lines whose estimate is within the sketch's error of the threshold get an exact count of
sites. Lines on at least ``min_sites`` sites are boilerplate and go from every document.

Defined results: a null text stays null; a null site is a site of its own; a document whose
lines all go keeps an empty text; newlines between kept lines stay; repeated rows give repeated
results; very long texts are cut whole, one at a time; an empty table gives an empty one; further columns are kept whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

#: Sites from which a line is boilerplate, log2 of the sketch's registers, and its error in parts of the estimate.
MIN_SITES, LOG_K = 12, 10
ERROR = 3 * 1.04 / 2 ** (LOG_K / 2)
#: Pairs of line and site that a task keeps in mind, eight bytes each.
SEEN = 300_000


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def _lines(batch: pa.RecordBatch, at: int):
    """For slices of a batch: (first row, texts, lines of each text, hash of each line or 0 if it is empty)."""
    bounds, _ = words.utf8(batch.column(at))
    for i, j in words.spans(bounds):
        texts = batch.column(at).slice(i, j - i).to_pylist()
        parts = [[] if t is None else t.split("\n") for t in texts]
        hashes = np.array([_hash(s) if (s := p.strip()) else 0 for own in parts for p in own], dtype=np.uint64)
        yield i, texts, parts, hashes


def line_sites(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(line, site): 64-bit hashes of lines and the hash of a site that has it, mostly each pair once a task."""

    def run(batches):
        seen = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            sites = batch.column(1).to_numpy()
            for i, _, parts, line in _lines(batch, 0):
                site = np.repeat(sites[i : i + len(parts)], [len(p) for p in parts])
                some = np.flatnonzero(line)
                pair, at = np.unique(words.mix(line[some] + words.mix(site[some].view(np.uint64))), return_index=True)
                new = ~np.isin(pair, seen, assume_unique=True)
                at = some[at[new]]
                seen = np.concatenate([seen, pair[new]]) if len(seen) < SEEN else pair[new]
                yield pa.RecordBatch.from_arrays([pa.array(line[at].view(np.int64)), pa.array(site[at])], ["line", "site"])

    return docs.select(F.col(text_col).cast("string"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\0")))).mapInArrow(words.freeing(run), "line long, site long")


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line): hashes of lines that stand on at least min_sites sites."""
    spark = docs.sparkSession
    pairs = scratch.Scratch(spark, "lines").table(line_sites(docs, text_col, site_col), "pairs")
    often = pairs.groupBy("line").agg(F.count("*").alias("pairs")).filter(F.col("pairs") >= min_sites).select("line")
    sketched = pairs.join(often, "line").groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("about"))
    low, high = min_sites * (1 - ERROR) - 1, min_sites * (1 + ERROR) + 1
    judged = sketched.filter(F.col("about") >= low)
    near = judged.filter(F.col("about") <= high).select("line")
    exact = pairs.join(near, "line").groupBy("line").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return judged.filter(F.col("about") > high).select("line").unionByName(exact.select("line"))


def _cut(parts: list[str], gone: np.ndarray) -> str:
    return "\n".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g)


def _removed(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, bound: int) -> DataFrame:
    """docs with columns by their places (c0, c1, ...), without boilerplate lines, and n, the number of those that went."""
    spark = docs.sparkSession
    store = scratch.Scratch(spark, "boilerplate")
    plain, names = scratch.positional(docs)
    width, at = len(names), int(names[text_col][1:])
    lines = store.table(boilerplate(plain, names[text_col], names[site_col], min_sites), "lines")
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def cut(batches, known):
        for batch in batches:
            for i, texts, parts, hashes in _lines(batch, at):
                own = batch.slice(i, len(texts))
                gone = known(own, hashes, [len(p) for p in parts])
                ends = np.cumsum([0, *map(len, parts)])
                n = np.diff(np.concatenate([[0], np.cumsum(gone)])[ends])
                out = [_cut(parts[k], gone[ends[k] : ends[k + 1]]) if n[k] else t for k, t in enumerate(texts)]
                cols = [pa.array(out, own.column(c).type) if c == at else own.column(c) for c in range(width)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], [*names.values(), "n"])

    if lines.count() <= bound:

        def packed(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], ["part"])

        raw = b"".join(bytes(r["part"]) for r in lines.mapInArrow(packed, "part binary").collect())
        small = spark.sparkContext.broadcast(np.sort(np.frombuffer(raw, dtype=np.uint64)))

        def run(batches):
            gone = small.value

            def known(own, hashes, sizes):
                return gone[np.minimum(np.searchsorted(gone, hashes), len(gone) - 1)] == hashes if len(gone) else np.zeros(len(hashes), dtype=bool)

            yield from cut(batches, known)

        return plain.mapInArrow(words.freeing(run), f"{kinds}, n long")

    # one row for each document and hash, joined with the lines, back to one row a document
    keyed = plain.withColumn("key", F.xxhash64(F.col(f"c{at}"), F.col(names[id_col])))

    def hashes_of(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, parts, line in _lines(batch, 1):
                key = np.repeat(keys[i : i + len(parts)], [len(p) for p in parts])[line != 0]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(line[line != 0].view(np.int64))], ["key", "line"])

    own = keyed.select("key", F.col(f"c{at}").cast("string")).mapInArrow(words.freeing(hashes_of), "key long, line long").distinct().join(lines, "line").groupBy("key").agg(F.collect_list("line").alias("gone"))
    joined = keyed.join(own, "key", "left").drop("key")

    def run_joined(batches):
        def known(own, hashes, sizes):
            lists = own.column(width).to_pylist()
            edges = np.cumsum([0, *sizes])
            parts = [np.isin(hashes[edges[k] : edges[k + 1]].view(np.int64), x or []) for k, x in enumerate(lists)]
            return np.concatenate([np.zeros(0, dtype=bool), *parts])

        yield from cut(batches, known)

    return joined.mapInArrow(words.freeing(run_joined), f"{kinds}, n long")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, bound: int = scratch.BROADCAST_ROWS) -> DataFrame:
    """docs without boilerplate lines, and the column n_removed_lines, in place of one of that name.

    Up to bound boilerplate lines are broadcast as a sorted array; beyond it, documents are joined with theirs."""
    docs = docs.drop("n_removed_lines")
    return _removed(docs, id_col, text_col, site_col, min_sites, bound).toDF(*docs.columns, "n_removed_lines")


def op6_lines(spark, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_removed_lines", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def without_boilerplate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of a pipeline: boilerplate lines go, all documents stay, with the columns they had, whatever their names.

    A null text stays null; a text of boilerplate alone becomes empty; a null source is a site of its own; ids play no part, so null
    and repeated ones keep their rows; repeated rows are cut alike; long texts are cut whole; an empty table gives an empty one."""
    return _removed(docs, "doc_id", "text", "source", MIN_SITES, scratch.BROADCAST_ROWS).drop("n").toDF(*docs.columns)


#: White space as str.strip has it.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
OP6_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, text, coalesce(source, chr(1)) AS site FROM documents
), parts AS (
  SELECT k, doc_id, site, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs
), lines AS (
  SELECT *, regexp_replace(part, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line FROM parts
), gone AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), cut AS (
  SELECT k, count(gone.line) AS n, coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (gone.line IS NULL), '') AS kept FROM lines LEFT JOIN gone USING (line) GROUP BY k
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_removed_lines, length(kept)::BIGINT AS n_chars_kept, sha256(kept) AS kept_sha256 FROM docs LEFT JOIN cut USING (k)
"""
