"""Benchmark decontamination by latent semantic retrieval, confirmed by common subsequences.

1. Benchmark items are cut into words (letters and digits, ASCII in lower case), their terms; document frequencies of
   the terms are counted over all documents. A randomised SVD of the passages' TF-IDF matrix gives RANK latent
   directions: subspace iteration whose products run as Spark jobs over the passages, with small factors on the driver.
2. Every document is cut into blocks of HOP words; each two neighbours are a window. Windows are projected and compared with all
   passages; a cosine of NEAR or more makes a candidate. No number of candidates is set.
3. For a candidate the longest common subsequence of the item and the window with a margin of the item's length decides:
   SURE of the item's words in order, or LIKELY of them (a paraphrase) if the answer - the item's last sentence - is
   there too: ANSWER of its words, in order. Items of under SHORT words need all words.
4. A cosine can miss: a window is mostly other text where an item is short, and RANK directions hold a part of a large
   benchmark. So pairs of document and item that step 3 left without a match get an exact second search. An item that matches has
   ``need`` words in common with what is looked at; without its need - least most frequent words it still has ``least`` of
   the others. Windows with fewer words of those are left out, and no others: nothing that step 3 would accept is lost, at
   any number and length of items. The column latent says which search found a match.

The benchmark is taken in blocks of about ITEMS items and LETTERS characters (items of over ALONE characters apart from others), and terms are at most 2**BITS buckets, so tables that are
broadcast have a bound at any size of the benchmark; each block makes one pass for frequencies and one for the search. A document
stays in its task: nothing is shuffled but counts.

Defined results: a null text or item matches nothing; items without words are left out; repeated items or rows give repeated
matches; of several places in a document the best counts, ties go to the first; very long texts are searched whole, one at a
time; a null id keeps its matches; an empty table on either side gives an empty one; only the id and text columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

HOP, RANK, OVER, ROUNDS = 32, 128, 16, 2
NEAR, SURE, LIKELY, ANSWER, SHORT = 0.7, 0.75, 0.55, 0.75, 8
ITEMS, LETTERS, BITS, CELLS = 5_000, 1 << 20, 18, 1 << 22
#: Bytes that Python tasks get at once.
BATCH = 4 << 20
#: Words of an item beyond which tables a word are made as they are needed, and letters beyond which items have blocks of their own.
LONG, ALONE = 4096, 1 << 16


class Places:
    """Bits of the places of each word among words; a mask is as long as these, so for more than LONG of them it is made when it is asked for."""

    def __init__(self, own: np.ndarray):
        self.at: dict[int, list[int]] = {}
        for i, w in enumerate(own.tolist()):
            self.at.setdefault(w, []).append(i)
        self.masks = {w: self._mask(p) for w, p in self.at.items()} if len(own) <= LONG else None

    @staticmethod
    def _mask(places: list[int]) -> int:
        if len(places) == 1:
            return 1 << places[0]
        bits = bytearray((places[-1] >> 3) + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    def _made(self, word: int) -> int | None:
        places = self.at.get(word)
        return self._mask(places) if places else None

    @property
    def get(self):
        """A function that gives the mask of a word, or None."""
        return self._made if self.masks is None else self.masks.get


@dataclass
class Item:
    item: object
    words: np.ndarray
    answer: int  # first word of the last sentence

    def __post_init__(self):
        self.whole, self.last = (Places(self.words[i:]) for i in (0, self.answer))


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words.split(data, bounds, alnum=True)
    return words.word_hashes(data, starts, ends, lower=True), first


def _of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return _hashes(raw, np.array([0, len(raw)]))[0]


def parse_item(item: object, text: str | None) -> Item | None:
    """None without words. The answer follows the last end of a sentence that has words after it."""
    own = _of(text or "")
    if not len(own):
        return None
    for m in reversed(list(re.finditer(r"[.?!:\n](?=\s|$)", text))):
        tail = _of(text[m.end() :])
        if 0 < len(tail) < len(own):
            return Item(item, own, len(own) - len(tail))
    return Item(item, own, 0)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(docs: DataFrame, index: np.ndarray, terms: int) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and the number of documents with words. index: term of each bucket or -1."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        at, total, seen = shared.value, np.zeros(terms, dtype=np.int64), 0
        group = max(1, (1 << 24) // max(1, terms))
        for batch in batches:
            bounds, data = words.utf8(batch.column(0))
            for i, j in words.spans(bounds):
                h, first = _hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                seen += int((np.diff(first) > 0).sum())
                term = at[_buckets(h)]
                for k in range(0, j - i, group):
                    m = min(k + group, j - i)
                    own = term[first[k] : first[m]]
                    doc = np.repeat(np.arange(m - k), np.diff(first[k : m + 1]))[own >= 0]
                    mask = np.zeros((m - k, terms), dtype=bool)
                    mask[doc, own[own >= 0]] = True
                    total += mask.sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], seen))], ["term", "n"])

    with scratch.short_batches(docs.sparkSession, BATCH):
        counts = docs.select("text").mapInArrow(words.freeing(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(terms + 1, dtype=np.int64)
    for r in counts:
        df[r["term"]] = r["n"]
    return df[:-1], int(df[-1])


def latent_basis(passages: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """(terms, rank): leading right singular vectors of the matrix of (terms binary: int32 term of each word of a passage)."""
    spark, n = passages.sparkSession, len(weight)
    width = min(n, rank + OVER)

    def product(q: np.ndarray) -> np.ndarray:
        """Transposed matrix times matrix times q: tasks give sums by blocks of terms, Spark adds them up."""
        shared = spark.sparkContext.broadcast(q)

        def run(batches):
            q, out = shared.value, np.zeros((n, width))
            for batch in batches:
                for x in batch.column(0):
                    term, count = np.unique(np.frombuffer(x.as_buffer(), dtype=np.int32), return_counts=True)
                    if len(term):
                        row = count * weight[term]
                        row = row / np.linalg.norm(row)
                        out[term] += row[:, None] * (row @ q[term])[None, :]
            at = np.arange(0, n, 1024)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([out[i : i + 1024].tobytes() for i in at], pa.binary())], ["at", "part"])

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    part = np.frombuffer(x.as_buffer())
                    total[at] = total[at] + part if at in total else part
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["at", "part"])

        rows = passages.mapInArrow(words.freeing(run), "at long, part binary").repartition("at").mapInArrow(words.freeing(add), "at long, part binary").collect()
        out = np.zeros((n, width))
        for r in rows:
            part = np.frombuffer(r["part"]).reshape(-1, width)
            out[r["at"] : r["at"] + len(part)] = part
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    for _ in range(ROUNDS):
        q = np.linalg.qr(product(q))[0]
    values, turn = np.linalg.eigh(q.T @ product(q))
    order = np.argsort(values)[::-1]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-30)][:rank]
    return q @ turn[:, order]


def common(places: Places, n: int, region: list[int]) -> int:
    """Length of the longest common subsequence of n words, given by their places, and region; by bits of an integer."""
    v = full = (1 << n) - 1
    for m in filter(None, map(places.get, region)):
        u = v & m
        v = (v + u | v - u) & full
    return n - v.bit_count()


@dataclass
class Index:
    items: list[Item]
    bucket: np.ndarray  # term of each bucket of word hashes, or -1
    basis: np.ndarray  # (terms, rank), with weights
    latent: np.ndarray  # (rank, passages), of length 1
    owner: np.ndarray  # item of each passage
    begin: np.ndarray  # of each term in posted
    posted: np.ndarray  # items that count a term
    least: np.ndarray  # counted words that a match of each item has


def counted(own: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, int]:
    """(terms that count for an item, words of them that every match has)."""
    n = len(own)
    need = n if n < SHORT else max(1, int(np.ceil(LIKELY * n - 1e-9)))
    least = -(-need // 4)
    return np.unique(own[np.argsort(df[own], kind="stable")][: n - need + least]), least


def build_index(docs: DataFrame, items: list[Item], store: scratch.Scratch, name: str) -> Index:
    """Index of one block of items; docs gives the frequencies."""
    used = np.unique(np.concatenate([_buckets(x.words) for x in items]))
    bucket = np.full(1 << BITS, -1, dtype=np.int32)
    bucket[used] = np.arange(len(used))
    df, total = frequencies(docs, bucket, len(used))
    idf = np.log((1 + total) / (1 + df)) + 0.1
    passages, owner = [], []
    for k, x in enumerate(items):
        term = bucket[_buckets(x.words)]
        for at in range(0, max(1, len(term) - HOP), HOP):
            passages.append(term[at : at + 2 * HOP])
            owner.append(k)
    spark = docs.sparkSession
    rows = store.table(spark.createDataFrame(((p.tobytes(),) for p in passages), "terms binary"), name)
    basis = (latent_basis(rows, idf) * idf[:, None]).astype(np.float32)
    latent = np.array([basis[p].sum(axis=0) for p in passages])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    counts = [counted(bucket[_buckets(x.words)], df) for x in items]
    term, item = np.concatenate([t for t, _ in counts]), np.repeat(np.arange(len(items), dtype=np.int32), [len(t) for t, _ in counts])
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(used) + 1))
    return Index(items, bucket, basis, np.ascontiguousarray(latent.T, dtype=np.float32), np.array(owner), begin, item[order], np.array([n for _, n in counts]))


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block of HOP words: its document, first word, and the document's first block and end; a window is a block and the next."""
    n = np.diff(first)
    blocks = np.maximum(1, -(-n // HOP)) * (n > 0)
    ends = np.cumsum(blocks)
    doc = np.repeat(np.arange(len(n)), blocks)
    begins = (ends - blocks)[doc]
    return doc, (np.arange(len(doc)) - begins) * HOP + first[:-1][doc], begins, ends[doc]


def _retrieved(index: Index, h: np.ndarray, first: np.ndarray):
    """(document, first word, item, cosine) of windows near a passage of the item in the latent space, in order."""
    doc, at, _, _ = _blocks(first)
    term = index.bucket[_buckets(h)]
    step = max(1, min(1 << 11, CELLS // len(index.owner)))
    for i in range(0, len(doc), step):
        j = min(i + step, len(doc))
        more = min(j + 1, len(doc))  # the block after the last window
        lo, hi = at[i], at[more] if more < len(at) else len(h)
        own = np.flatnonzero(term[lo:hi] >= 0)
        edges = np.searchsorted(own, at[i:more] - lo)
        sums = np.zeros((more - i + 1, index.basis.shape[1]), dtype=np.float32)
        full = np.flatnonzero(np.diff(np.append(edges, len(own))))
        if len(full):
            sums[full] = np.add.reduceat(index.basis[term[lo:hi][own]], edges[full], axis=0)
        z = sums[: j - i]
        z = z + sums[1 : j - i + 1] * (np.append(doc[i + 1 : j + 1], -1)[: j - i] == doc[i:j])[:, None]
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        cosine = z @ index.latent
        w, passage = np.nonzero(cosine >= NEAR)
        value, k = cosine[w, passage], index.owner[passage]
        # of the passages of an item, which are neighbours, the nearest
        lead = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (k[1:] != k[:-1])])) if len(w) else w
        yield doc[i + w[lead]], at[i + w[lead]], k[lead], np.maximum.reduceat(value, lead) if len(w) else value


def _counted(index: Index, h: np.ndarray, first: np.ndarray):
    """(document, first word, item) of windows that have the words which a match needs, in order."""
    doc, at, begins, ends = _blocks(first)
    term = index.bucket[_buckets(h)]
    items = len(index.items)
    margin = -(-np.array([len(x.words) for x in index.items]) // HOP)
    reach = int(margin.max()) + 2
    step = max(reach, CELLS // items)
    for i in range(0, len(doc), step):
        j = min(i + step, len(doc))
        a, b = max(0, i - reach), min(len(doc), j + reach)
        lo, hi = at[a], at[b] if b < len(at) else len(h)
        own = np.flatnonzero(term[lo:hi] >= 0)
        block = np.searchsorted(at[a:b], own + lo, side="right") - 1
        own = term[lo:hi][own]
        many = index.begin[own + 1] - index.begin[own]
        cell = np.repeat(index.begin[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = np.repeat(block * items, many) + index.posted[cell]
        # words of each item before each block
        hits = np.zeros((b - a + 1, items), dtype=np.int32)
        np.cumsum(np.bincount(cell, minlength=(b - a) * items).reshape(b - a, items), axis=0, out=hits[1:])
        window = np.arange(i, j)
        found = []
        for m in np.unique(margin).tolist():
            some = np.flatnonzero(margin == m)
            up = np.minimum(ends[i:j], window + 2 + m) - a
            down = np.maximum(begins[i:j], window - m) - a
            part = hits if len(some) == items else hits[:, some]
            w, k = np.nonzero(part[up] - part[down] >= index.least[some])
            found.append((w + i, some[k]))
        w, k = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((k, w))
        w, k = w[order], k[order]
        yield doc[w], at[w], k


def _cosine(index: Index, h: np.ndarray, item: int) -> float:
    """Of the words of a window and the nearest passage of an item."""
    term = index.bucket[_buckets(h)]
    z = index.basis[term[term >= 0]].sum(axis=0)
    return float((z @ index.latent[:, slice(*np.searchsorted(index.owner, (item, item + 1)))]).max() / max(np.linalg.norm(z), 1e-12))


def _judge(index: Index, own: list[int], lo: int, hi: int, item: Item) -> tuple[int, bool] | None:
    """(words in common, sure) of an item and a region if they match."""
    n, region = len(item.words), own[lo:hi]
    # no more words than places whose word is there can be common
    there = 0
    for m in map(item.whole.get, set(region)) if item.whole.masks is None else set(map(item.whole.get, region)):
        there |= m or 0
    least = 1 if n < SHORT else LIKELY
    if there.bit_count() / n < least:
        return None
    same = common(item.whole, n, region)
    if same / n < least:
        return None
    sure = same / n >= SURE
    if not sure and common(item.last, n - item.answer, region) < ANSWER * (n - item.answer):
        return None
    return same, sure


def _matches(index: Index, h: np.ndarray, first: np.ndarray):
    """(document, item, first word, end, common, sure, cosine, latent): the best place of each document and item that matches."""
    own = h.tolist()

    def search(candidates, taken: dict) -> dict[tuple[int, int], tuple]:
        best: dict[tuple[int, int], tuple] = {}
        last: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, at, items, *cosine in candidates:
            for d, a, p, *c in zip(doc.tolist(), at.tolist(), items.tolist(), *(x.tolist() for x in cosine), strict=True):
                n = len(index.items[p].words)
                if (d, p) in taken or (d, p) in best and best[d, p][4] == n:  # no place is better
                    continue
                lo, hi = max(int(first[d]), a - n), min(int(first[d + 1]), a + 2 * HOP + n)
                if last.get((d, p)) == (lo, hi):  # neighbouring windows of a long item may look at the same words
                    continue
                last[d, p] = lo, hi
                got = _judge(index, own, lo, hi, index.items[p])
                if got and ((d, p) not in best or got[0] > best[d, p][4]):
                    best[d, p] = (d, p, lo - int(first[d]), hi - int(first[d]), *got, c[0] if c else _cosine(index, h[a : min(a + 2 * HOP, int(first[d + 1]))], p), bool(c))
        return best

    near = search(_retrieved(index, h, first), {})
    return sorted((near | search(_counted(index, h, first), near)).values())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, word_from, word_to, n_common, share, paraphrase, cosine, latent): matching pairs, and the words looked at."""
    spark = docs.sparkSession
    store = scratch.Scratch(spark, "latent")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    # items are searched with those of about their length: a long one widens what is held for all of its block
    alone = F.length("text") > ALONE
    sizes = {r["alone"]: r for r in bench.groupBy(alone.alias("alone")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters")).collect()}
    blocks = []
    for kind in sorted(sizes):
        many = max(-(-sizes[kind]["n"] // items), -(-sizes[kind]["letters"] // LETTERS), 1)
        part = bench.filter(alone == kind)
        blocks += [part.filter(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k) if many > 1 else part for k in range(many)]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), bench.schema["item"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, word_from long, word_to long, n_common long, share double, paraphrase boolean, cosine double, latent boolean"
    out = spark.createDataFrame([], schema)
    for block, own in enumerate(blocks):
        parsed = sorted((x for r in own.collect() if (x := parse_item(r["item"], r["text"])) is not None), key=lambda x: (str(x.item), x.words.tobytes()))
        if not parsed:
            continue
        shared = spark.sparkContext.broadcast(build_index(docs, parsed, store, f"passages-{block}"))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                bounds, data = words.utf8(batch.column(1))
                for i, j in words.spans(bounds):
                    h, first = _hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    rows = _matches(index, h, first)
                    d, p, lo, hi, same, sure, cosine, latent = zip(*rows, strict=True) if rows else ((),) * 8
                    share = [s / len(index.items[k].words) for s, k in zip(same, p, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i + x for x in d], pa.int64())), pa.array([index.items[k].item for k in p], item_kind), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(same, pa.int64()), pa.array(share, pa.float64()), pa.array([not s for s in sure], pa.bool_()), pa.array(cosine, pa.float64()), pa.array(latent, pa.bool_())],
                        ["doc_id", "item_id", "word_from", "word_to", "n_common", "share", "paraphrase", "cosine", "latent"],
                    )

        item_kind = pa.int64() if kinds[1] in ("bigint", "int", "smallint", "tinyint") else pa.string()
        found = docs.mapInArrow(words.freeing(run), schema.replace(f"item_id {kinds[1]}", "item_id long" if item_kind == pa.int64() else "item_id string"))
        out = out.unionByName(found.withColumn("item_id", F.col("item_id").cast(kinds[1])))
    return out


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of a pipeline: documents that hold a benchmark item go; columns stay as they are, whatever their names.

    A row is judged by its text, so rows with a null id go too, and other texts under one id stay; repeated rows go together. A
    null or empty text stays; texts of any length are searched whole; an empty table gives an empty one."""
    store = scratch.Scratch(spark, "decontaminated", BATCH)
    rows, at = scratch.positional(docs)
    text = F.col(at["text"]).cast("string")
    rows = rows.withColumn("key", F.struct(F.xxhash64(text).alias("a"), F.crc32(text).alias("b"), F.length(text).alias("n")))
    found = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key", at["text"]).select(F.col("doc_id").alias("gone")).distinct()
    return rows.join(store.small(store.table(found, "gone")), F.col("key") == F.col("gone"), "left_anti").drop("key").toDF(*docs.columns)
