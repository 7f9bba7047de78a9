"""BPE encoding and decoding with reuse of content-defined chunks.

1. A rolling hash cuts each text into chunks; their digests are counted over all documents.
2. Each chunk that occurs more than once is encoded once, by itself, at its first place. It is used only if its ids spell its bytes.
3. Each document joins the ids of its shared chunks. Every join is repaired: the last ids of the chunk on its left, the text that
   isn't shared, and the first ids of the chunk on its right are encoded anew as one seam. A seam holds once its first
   and last MATCH ids are those of the chunks; else its margin there is doubled, until both sides agree or a whole chunk has
   become part of the seam. Where the file has cuts that hold in every context (see ``tokens``), margins start and end at them.

Only digests are shuffled to count chunks; texts move compressed, keyed by document.
Defined results: a null text is empty and has no ids; repeated rows and documents with one id
are each encoded; a text without shared chunks is one seam; very long texts are encoded whole, one at a time; an empty
table gives an empty one; only the id and the text column are read. A hot chunk has one row for each document that holds
it, spread by adaptive skew joins over tables that were written before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens, words

#: Bytes of a chunk: on average, at least and at most. Ids of a margin at first, and of them those that must agree.
MEAN, LEAST, MOST, MARGIN, MATCH = 2048, 512, 65536, 16, 6


def _chunks(data: np.ndarray) -> list[bytes]:
    ends = tokens.cut_points(data, MEAN, LEAST, MOST)
    out, at = [], 0
    for e in ends:
        while e < len(data) and data[e] & 0xC0 == 0x80:  # not within a character
            e += 1
        if e > at:
            out.append(data[at:e].tobytes())
            at = e
    return out


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray]]:
    bounds, data = words.utf8(batch.column(at))
    for i in range(len(bounds) - 1):
        yield i, data[bounds[i] : bounds[i + 1]]


def _groups(sizes: list[int], limit: int = words.SLICE) -> Iterator[tuple[int, int]]:
    return words.spans(np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int64), limit) if sizes else iter(())


class Known:
    """A chunk with its own ids, of which head come before and tail after what is kept."""

    def __init__(self, enc: tokens.Encoder, raw: bytes, ids: np.ndarray):
        self.raw, self.ids, self.n = raw, ids, len(ids)
        self.ends = np.concatenate([[0], np.cumsum(enc.lengths()[ids])])
        at, data = np.arange(self.n + 1), np.frombuffer(raw, dtype=np.uint8)
        if enc.level:
            at = at[np.isin(self.ends, enc.cuts(data))]
        else:  # an id may end within a character
            at = at[:-1][data[np.minimum(self.ends[:-1], len(raw) - 1)] & 0xC0 != 0x80]
        #: Numbers of ids after which a margin may end: where it does, a character does too.
        self.stops = at[(at > 0) & (at < self.n)]
        self.head = self.tail = 0
        self.usable = self.widen(0) and self.widen(1)

    def widen(self, side: int) -> bool:
        """Double the margin at the head (0) or tail (1); False once nothing would be left of the chunk."""
        if side == 0:
            more = self.stops[self.stops >= max(MARGIN, 2 * self.head)]
            self.head = int(more[0]) if len(more) else self.n
        else:
            more = self.stops[self.stops <= self.n - max(MARGIN, 2 * self.tail)]
            self.tail = self.n - int(more[-1]) if len(more) else self.n
        return self.head + self.tail < self.n

    def begin(self) -> bytes:
        return self.raw[: self.ends[self.head]]

    def end(self) -> bytes:
        return self.raw[self.ends[self.n - self.tail] :]


def join(enc: tokens.Encoder, docs: list[list[bytes | Known]]) -> list[np.ndarray]:
    """Ids of texts that are given as runs of bytes and known chunks, in order."""
    docs = [[p for p in own if not isinstance(p, Known) or p.usable or not p.raw] for own in ([p if not isinstance(p, Known) or p.usable else p.raw for p in own] for own in docs)]
    done: dict[int, list] = {}
    todo = list(range(len(docs)))
    while todo:
        texts, spans = [], []
        for d in todo:
            seam, seams, chunks = [], [], []
            for p in docs[d]:
                if isinstance(p, Known):
                    seams.append(b"".join([*seam, p.begin()]))
                    chunks.append(p)
                    seam = [p.end()]
                else:
                    seam.append(p)
            seams.append(b"".join(seam))
            spans.append((len(texts), chunks))
            texts += seams
        bounds = np.cumsum([0, *map(len, texts)])
        ids, edges = enc.encode_bytes(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
        again = []
        for d, (at, chunks) in zip(todo, spans, strict=True):
            own = [ids[edges[k] : edges[k + 1]] for k in range(at, at + len(chunks) + 1)]
            wrong = False
            for k, c in enumerate(chunks):
                left, right = own[k], own[k + 1]
                if not np.array_equal(left[-min(MATCH, c.head) :], c.ids[max(0, c.head - MATCH) : c.head]):
                    wrong, c.usable = True, c.widen(0)
                if not np.array_equal(right[: min(MATCH, c.tail)], c.ids[c.n - c.tail : c.n - c.tail + MATCH][: c.tail]):
                    wrong, c.usable = True, c.widen(1) and c.usable
            if wrong:
                docs[d] = [p.raw if isinstance(p, Known) and not p.usable else p for p in docs[d]]
                again.append(d)
                continue
            parts = [own[0]]
            for c, right in zip(chunks, own[1:], strict=True):
                parts += [c.ids[c.head : c.n - c.tail], right]
            done[d] = np.concatenate(parts)
        todo = again
    return [done[d] for d in range(len(docs))]


def reusable(enc: tokens.Encoder, raw: list[bytes]) -> dict[int, bytes]:
    """Ids of those chunks that their own ids spell, by their places in raw."""
    ids, edges = enc.encode_bytes(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    return {k: ids[edges[k] : edges[k + 1]].tobytes() for k, x in enumerate(enc.spelled(ids, edges)) if x == raw[k]}


def _facts(enc: tokens.Encoder, ids: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256 of each text; the text is decoded from the ids."""
    listed = [hashlib.sha256(x[:-1]).hexdigest() for x in enc.listed(ids, edges)]
    decoded = [hashlib.sha256(x).hexdigest() for x in enc.decoded(ids, edges)]
    return [pa.array(np.diff(edges)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]


_FACTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, facts: bool = False) -> DataFrame:
    """(doc_id, ids), and n_tokens, ids_sha256, decoded_sha256 if asked for.

    ids are little-endian unsigned integers, two bytes each where the vocabulary fits, else four."""
    spark = docs.sparkSession
    path = path or tokens.default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    store = scratch.Scratch(spark, "bpe")

    def list_chunks(batches):
        for batch in batches:
            digests, keys, seqs = [], [], []
            ids = batch.column(0)
            for i, data in _texts(batch, 1):
                if len(data) <= LEAST:
                    continue
                key = _digest(str(ids[i].as_py()).encode() + b"\0" + data.tobytes())
                for s, c in enumerate(_chunks(data)):
                    digests.append(_digest(c))
                    keys.append(key)
                    seqs.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(keys, pa.binary()), pa.array(seqs, pa.int32())], ["digest", "key", "seq"])

    places = docs.mapInArrow(words.freeing(list_chunks), "digest binary, key binary, seq int")
    places = store.table(places, "places")
    shared = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "seq")).alias("own")).filter("n > 1")
    shared = store.table(shared.select("digest", "own.key", "own.seq"), "shared")

    def keyed(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            rows = [(_digest(str(ids[i].as_py()).encode() + b"\0" + (raw := data.tobytes())), pack.compress(raw)) for i, data in _texts(batch, 1)]
            keys, packed = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "key", "packed"])

    texts = docs.mapInArrow(words.freeing(keyed), f"doc_id {kind}, key binary, packed binary")

    def encode_shared(batches):
        enc, unpack = tokens.encoder(path), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = batch.to_pydict()
            for i, j in _groups([len(x) * 4 for x in rows["packed"]]):
                digests, raw = [], []
                for packed, own in zip(rows["packed"][i:j], rows["own"][i:j], strict=True):
                    chunks = _chunks(np.frombuffer(unpack.decompress(packed), dtype=np.uint8))
                    for o in own:
                        digests.append(o["digest"])
                        raw.append(chunks[o["seq"]])
                kept = reusable(enc, raw)
                yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in kept], pa.binary()), pa.array(kept.values(), pa.binary())], ["digest", "ids"])
        enc.forget()  # the worker may go on to other work

    owners = shared.groupBy("key").agg(F.collect_list(F.struct("seq", "digest")).alias("own"))
    first = texts.select("key", "packed").join(owners.hint("shuffle_hash"), "key")
    # one row for each digest: documents that are repeated row by row have encoded theirs more than once
    once = first.mapInArrow(words.freeing(encode_shared), "digest binary, ids binary").groupBy("digest").agg(F.min("ids").alias("ids"))
    parts = places.join(store.table(once, "once"), "digest").groupBy("key").agg(F.collect_set(F.struct("seq", "ids")).alias("parts"))

    def assemble(batches):
        enc, unpack = tokens.encoder(path), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = batch.select(["packed", "parts"]).to_pydict()
            for i, j in _groups([len(x) * 4 for x in rows["packed"]], tokens.SLICE):
                plan: list[list[bytes | Known]] = []
                for packed, parts in zip(rows["packed"][i:j], rows["parts"][i:j], strict=True):
                    raw = unpack.decompress(packed)
                    known = {p["seq"]: p["ids"] for p in parts or ()}
                    chunks = _chunks(np.frombuffer(raw, dtype=np.uint8)) if known else [raw]
                    plan.append([Known(enc, c, np.frombuffer(known[s], dtype=enc.dtype)) if s in known else c for s, c in enumerate(chunks)])
                ids = join(enc, plan)
                more = _facts(enc, np.concatenate(ids), np.cumsum([0, *map(len, ids)])) if facts else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in ids], pa.binary()), *more], list(kinds))
        enc.forget()

    kinds = {"doc_id": kind, "ids": "binary"} | (_FACTS if facts else {})

    whole = texts.join(parts.hint("shuffle_hash"), "key", "left").select("doc_id", "packed", "parts")
    return whole.mapInArrow(words.freeing(assemble), ", ".join(f"{c} {k}" for c, k in kinds.items()))


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids)."""
    path = path or tokens.default_path()

    def read(batches):
        enc = tokens.encoder(path)
        for batch in batches:
            at, raw = words.utf8(batch.column(1))
            for i, j in words.spans(at):
                ids, edges = raw[at[i] : at[j]].view(enc.dtype), (at[i : j + 1] - at[i]) // enc.dtype.itemsize
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_facts(enc, ids, edges)], ["doc_id", *_FACTS])

    kinds = {"doc_id": encoded.schema["doc_id"].dataType.simpleString()} | _FACTS
    return encoded.select("doc_id", "ids").mapInArrow(words.freeing(read), ", ".join(f"{c} {k}" for c, k in kinds.items()))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), facts=True).drop("ids")


def encode_texts(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of a pipeline: (doc_id, n_tokens, ids, ids_sha256, decoded_sha256), one row for each row of docs.

    A null or empty text has no ids; null and repeated ids keep their rows; texts of any length are encoded whole; other columns,
    whatever their names, are not read; an empty table gives an empty one."""
    return encode(docs, facts=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")
