"""Ranked lexical search of all documents for each item, by Fagin's threshold algorithm.

1. Documents are read once. A forward index is written: each document's number of terms, and of the items' terms those it holds, with
   their occurrences. Counts of documents and terms come from that index.
2. Each task reads its part of the index in shards of SHARD postings. For each term of a shard the postings stand in the order of what
   they add to a score (their impact). An item takes entries from the lists of its terms in turn, in growing steps; each
   document met is scored whole by its row of the forward index. The threshold is the sum of the next impacts of all lists: no document that
   hasn't been met can score more. The search of a shard ends when the threshold is strictly below the task's kth score,
   so that ties are still seen; the scores found so far count from shard to shard.
3. The best of each task, TOP rows an item at most, are ranked by Spark.

Items go to the tasks in blocks of PAIRS pairs of item and term, or one item if it has more. Terms are told apart by 64-bit hashes: a term of the corpus
is taken for one of a block of T terms with a probability of T / 2**64.
Defined results: a null text has no terms; documents without terms count for nothing; rows that repeat an id are documents of their own, a null id comes last
in a tie; rows that share an item_id are one item with the terms of them all, a null item_id is an item too; an item without terms, or whose terms are in
no document, has no rows; long texts are taken whole; an empty table gives an empty one; other columns are not read. Ids of documents must be integers (others: TypeError).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scans, scratch, words

#: Documents of an item, pairs of item and term in a block, postings of a shard, entries of each list in the first step.
TOP, PAIRS, SHARD, STEP = 10, 2_000_000, 1_000_000, 8


def _hashed(column: pa.Array):
    """For slices of a column of texts: first row, number of rows, the hashes of their terms and the row of each."""
    bounds, data = words.utf8(column)
    for i, j in words.spans(bounds):
        own, edges = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        starts, ends, first = words.split(own, edges, alnum=True)
        yield i, j - i, words.word_hashes(own, starts, ends, lower=True), np.repeat(np.arange(j - i), np.diff(first))


def _item_terms(items: DataFrame, store: scratch.Scratch) -> DataFrame:
    """(item, item_id, terms): distinct hashes of each item's terms, item from 0; with the number of pairs up to it."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, n, h, row in _hashed(batch.column(1)):
                own = [np.unique(x).view(np.int64) for x in np.split(h, np.searchsorted(row, np.arange(1, n)))] if n else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(own, pa.list_(pa.int64()))], ["item_id", "terms"])

    rows = items.mapInArrow(words.freeing(run), f"item_id {kind}, terms array<long>")
    once = rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms")).withColumn("n", F.size("terms").cast("long"))
    return scans.scan(store.table(once, "once"), ["item_id"], store, "items", sums=("n",))


class Block:
    """Items with the numbers of their terms, for the tasks."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        own = [np.array(r["terms"], dtype=np.int64).view(np.uint64) for r in rows]
        #: Sorted hashes of all terms; of each item the places of its own in them.
        self.terms = np.unique(np.concatenate(own))
        self.own = [np.searchsorted(self.terms, x).astype(np.int32) for x in own]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for one that no item has."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def _forward(docs: DataFrame, block) -> DataFrame:
    """(doc_id, n, terms, tf): n terms in all, and of the block's terms their numbers and occurrences, as little-endian four-byte integers."""

    def run(batches):
        known = block.value
        size = len(known.terms)
        for batch in batches:
            for i, rows, h, row in _hashed(batch.column(1)):
                n = np.bincount(row, minlength=rows)
                at = known.numbers(h)
                some = at >= 0
                pairs, tf = np.unique(row[some] * size + at[some], return_counts=True)
                edges = np.searchsorted(pairs, np.arange(rows + 1) * size).tolist()
                terms, tf = (pairs % size).astype("<u4"), tf.astype("<u4")
                cols = [batch.column(0).slice(i, rows), pa.array(n), *(pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()) for x in (terms, tf))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return docs.mapInArrow(words.freeing(run), "doc_id long, n long, terms binary, tf binary")


def _frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each of size terms."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(words.utf8(batch.column(0))[1].view("<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy() for c in batch.columns]).tobytes()], pa.binary())], ["part"])

    df = forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, dtype=np.int64)
    for r in df.mapInArrow(packed, "part binary").collect():  # two numbers for each term of a block
        term, n = np.frombuffer(r["part"], dtype=np.int64).reshape(2, -1)
        out[term] = n
    return out


class Best:
    """The top rows of one item so far: scores, ids and which of these are null."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id, self.null = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @property
    def least(self) -> int:
        """A score that a new document has to reach."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least
        if keep.any():
            s, i, n = np.concatenate([self.score, score[keep]]), np.concatenate([self.id, ids[keep]]), np.concatenate([self.null, null[keep]])
            order = np.lexsort((i, n, -s))[: self.top]
            self.score, self.id, self.null = s[order], i[order], n[order]


class Shard:
    """Some documents: a forward index by document, and lists by term in the order of impact."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, impact: np.ndarray, edges: np.ndarray, size: int):
        self.ids, self.null, self.terms, self.impact, self.edges = ids, null, terms, impact, edges
        order = np.lexsort((-impact, terms))
        self.docs = np.repeat(np.arange(len(ids)), np.diff(edges))[order]
        self.listed = impact[order]
        self.first = np.searchsorted(terms[order], np.arange(size + 1))
        self.met = np.zeros(len(ids), dtype=bool)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from their rows of the forward index; weight has one entry for each term, 0 for those the item lacks."""
        begin, n = self.edges[docs], self.edges[docs + 1] - self.edges[docs]
        ends = np.cumsum(n)
        at = np.repeat(begin - ends + n, n) + np.arange(ends[-1])
        return np.add.reduceat(weight[self.terms[at]] * self.impact[at], ends - n)

    def search(self, own: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Let best have the documents of this shard for an item; how many were scored."""
        own = own[(weight[own] > 0) & (self.first[own + 1] > self.first[own])]
        at, ends, w = self.first[own].copy(), self.first[own + 1], weight[own]
        step, met = STEP, []
        while len(own) and int((w * self.listed[at]).sum()) >= best.least:
            n = np.minimum(step, ends - at)
            upto = np.cumsum(n)
            docs = np.unique(self.docs[np.repeat(at - upto + n, n) + np.arange(upto[-1])])
            docs = docs[~self.met[docs]]
            if len(docs):
                self.met[docs] = True
                met.append(docs)
                best.add(self.scores(docs, weight), self.ids[docs], self.null[docs])
            at += n
            left = at < ends
            own, at, ends, w, step = own[left], at[left], ends[left], w[left], step * 2
        for docs in met:
            self.met[docs] = False
        return sum(map(len, met))


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 * n + 2) / (2 * df + 1))) of each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def _shards(batches, size: int, n_docs: int, n_terms: int, limit: int):
    """Shards of about limit postings out of rows of the forward index."""
    held, count = [], 0

    def made():
        ids = pa.concat_arrays([b.column(0) for b in held])
        n = np.concatenate([b.column(1).to_numpy() for b in held])
        parts = [words.utf8(b.column(2)) for b in held]
        terms = np.concatenate([d.view("<u4") for _, d in parts]).astype(np.int64)
        tf = np.concatenate([words.utf8(b.column(3))[1].view("<u4") for b in held]).astype(np.int64)
        counts = np.concatenate([np.diff(e) // 4 for e, _ in parts])
        edges = np.concatenate([[0], np.cumsum(counts)])
        m = 10 + (90 * n * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, counts))
        return Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), terms, impact, edges, size)

    for batch in batches:
        batch = batch.filter(pa.array(np.diff(words.utf8(batch.column(2))[0]) > 0))
        if not batch.num_rows:
            continue
        held.append(batch)
        count += len(words.utf8(batch.column(2))[1]) // 4
        if count >= limit:
            yield made()
            held, count = [], 0
    if held:
        yield made()


def _ranked(forward: DataFrame, block, w: np.ndarray, n_docs: int, n_terms: int, kind: str, top: int, shard: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each task."""
    sent = forward.sparkSession.sparkContext.broadcast(w)
    item_type = pa.int64() if kind == "bigint" else None

    def run(batches):
        known, weight = block.value, sent.value
        best = [Best(top) for _ in known.ids]
        own_weight = np.zeros(len(weight), dtype=np.int64)
        for part in _shards(batches, len(weight), n_docs, n_terms, shard):
            for own, b in zip(known.own, best, strict=True):
                own_weight[own] = weight[own]
                part.search(own, own_weight, b)
                own_weight[own] = 0
        for ids, b in zip(known.ids, best, strict=True):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([ids] * len(b.score), item_type), pa.array(b.id, pa.int64(), mask=b.null), pa.array(b.score)], ["item_id", "doc_id", "score"])

    return forward.mapInArrow(words.freeing(run), f"item_id {kind}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, pairs: int = PAIRS, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item with a score above 0, equal scores by ascending id."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    spark = docs.sparkSession
    store = scratch.Scratch(spark, "search")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    listed = store.table(_item_terms(items, store), "listed")
    number = F.floor((F.col("n_upto") - F.col("n")) / pairs).alias("block")
    out = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for (b,) in listed.select(number).distinct().orderBy("block").collect():
        rows = listed.filter(number == b).select("item_id", "terms").collect()  # pairs of them at most, or one item
        known = Block(rows)
        block = spark.sparkContext.broadcast(known)
        forward = store.table(_forward(docs, block), f"forward{b}")
        n, total = forward.agg(F.count("*"), F.sum("n")).first()
        if n:
            found = _ranked(forward, block, weights(n, _frequencies(forward, len(known.terms))), n, total, kind, top, shard)
            out = out.unionByName(store.table(found, f"found{b}"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_search(spark, sf_dir: str) -> DataFrame:
    return search(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (
  SELECT k, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)
), n AS (
  SELECT k, doc_id, count(*) AS n FROM d GROUP BY k, doc_id
), c AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), p AS (
  SELECT k, term, count(*) AS tf FROM d SEMI JOIN q USING (term) GROUP BY k, term
), w AS (
  SELECT term, floor(1000::DOUBLE * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs
), m AS (
  SELECT k, doc_id, 10 + (90 * n * docs) // terms AS m FROM n, c
), s AS (
  SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY item_id, k, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
