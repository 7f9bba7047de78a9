"""Near-duplicate documents: a chosen-path set similarity join over 5-word shingles, then components.

1. Each text becomes the set of its shingles; equal sets are one vertex. A vertex has TOKENS
   minwise values of its set.
2. TREES independent trees start at a minwise position each. A node stands for a path of positions and the values found
   there; a vertex goes on to the two children that its own values at the node's next two positions name. A node draws these
   positions by its own hash from those set apart for its depth, so a vertex finds its way down from its values
   alone. Two sets of similarity s stay together at a position with probability s.
3. A node's leader is the vertex in it that shares most places of its nodes with others: the text that copies were made
   of rather than one of them. Vertices are compared with their leaders first, on a byte of each minwise value and then on full
   sets; linked vertices share a label. A node under one label has nothing more to give and ends; so a large group of copies
   is linked by stars and never by its pairs. Nodes of up to SMALL vertices and WEIGHT shingles end too: after the last
   round, their pairs across labels are compared exhaustively, first by sizes and parity maps of a few bits a shingle. These bound what two
   sets have in common from above, so what they leave out is no link. Vertices that stay in a node are compared by halves of all their
   hashes, and a node passes on as many pairs as join its labels.
   Larger nodes go down one to three levels in a round, by their size.
4. Every link is confirmed on full sets; components are merged by alternating large and small stars.

Recall: a pair at the threshold is apart in all nodes of a tree with probability ``loss(depth)``, which is below 1/3 at every
depth as each node branches twice; over all trees a pair is missed with probability below 5e-7 whatever the depth. The byte sketch
only saves comparisons with leaders. Vertices are 64-bit digests: n different sets have about n * n / 2**65 collisions.

Defined results: a text that is null or has no words is an empty set, alone in its component; fewer words than
SHINGLE are one shingle; a null id keeps its row, out of all groups, with a null component; rows
that share an id and a text are one document and stay or go together; very long texts are hashed whole, one at a time; a set
similar to several groups joins them; an empty table gives an empty one; only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

SHINGLE, THRESHOLD = 5, 75
TOKENS, TREES, SMALL, WEIGHT, AGREE, JUMP = 128, 15, 2048, 1 << 21, 72, 3
#: Positions that are set apart for each depth below the roots, and the depth at which they are used up.
CHOICES = 8
DEPTH = 1 + (TOKENS - TREES) // CHOICES
#: Bytes that Python tasks get at once.
BATCH = 4 << 20
#: Numbers in a block of a node's matrix of shingles.
CELLS = 1 << 21
_R = np.random.Generator(np.random.PCG64(4711))
_XOR = _R.integers(0, 2**32, TOKENS, dtype=np.uint32)
_MUL = _R.integers(0, 2**32, TOKENS, dtype=np.uint32) | np.uint32(1)
_SPREAD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def loss(depth: int, similarity: float = THRESHOLD / 100) -> float:
    """Probability that a pair of that similarity is apart in all nodes of one tree at a depth; roots are at depth 1."""
    x = 1 - similarity
    for _ in range(depth - 1):
        x = 1 - similarity + similarity * x * x
    return x


def _sets(batch: pa.RecordBatch, at: int):
    """(first document, bounds, hashes) for slices of a batch."""
    bounds, data = words.utf8(batch.column(at))
    for i, j in words.spans(bounds):
        own = bounds[i : j + 1] - bounds[i]
        hashes, edges = words.shingles(data[bounds[i] : bounds[j]], own, SHINGLE)
        yield i, edges, hashes


def _digest(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _matrix(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    """Rows of a binary column of TOKENS values each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), TOKENS)


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n, vertex, tokens) of (id, text); vertex is null for an empty set or a null id."""

    def run(batches):
        for batch in batches:
            for i, edges, hashes in _sets(batch, 1):
                n = np.diff(edges)
                some = np.flatnonzero(n)
                least = np.zeros((len(n), TOKENS), dtype=np.uint32)
                if len(some):
                    x = (hashes >> np.uint64(32)).astype(np.uint32)
                    starts = edges[:-1][some]
                    for t in range(TOKENS):
                        least[some, t] = np.minimum.reduceat((x ^ _XOR[t]) * _MUL[t], starts)
                ids = batch.column(0).slice(i, len(n))
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                vertex = [_digest(hashes[edges[k] : edges[k + 1]]) if n[k] and known[k] else None for k in range(len(n))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(vertex, pa.int64()), pa.array([r.tobytes() for r in least], pa.binary())], ["id", "n", "vertex", "tokens"])

    return docs.mapInArrow(words.freeing(run), f"id {_kind(docs)}, n long, vertex long, tokens binary")


def _kind(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def _with_bytes(vertices: DataFrame) -> DataFrame:
    """Adds one byte of each minwise value to (vertex, id, n, many, tokens)."""

    def run(batches):
        for batch in batches:
            small = ((_matrix(batch.column(4), np.uint32) * np.uint32(2654435769)) >> np.uint32(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in small], pa.binary())], [*batch.schema.names, "bytes"])

    return vertices.mapInArrow(words.freeing(run), f"vertex long, id {_kind(vertices)}, n long, many long, tokens binary, bytes binary")


def _child(node: np.ndarray, position: np.ndarray, token: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(node * _SPREAD + position.astype(np.uint64) + np.uint64(1)) ^ (token.astype(np.uint64) + np.uint64(1)) * _TURN)


def chosen(node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The two positions on which each node of a depth branches: never any of its own path."""
    first = (node >> np.uint64(7)).astype(np.int64) % CHOICES
    second = (first + 1 + (node >> np.uint64(17)).astype(np.int64) % (CHOICES - 1)) % CHOICES
    base = TREES + (depth - 1) * CHOICES
    return base + first, base + second


def _roots(vertices: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            tokens = _matrix(batch.column(2), np.uint32)
            for tree in range(TREES):
                at = np.full(len(tokens), tree, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_child(at, at, tokens[:, tree]).view(np.int64))], ["vertex", "n", "node"])

    return vertices.select("vertex", "n", "tokens").mapInArrow(words.freeing(run), "vertex long, n long, node long")


def _branches(rows: DataFrame, depth: int, levels: int) -> DataFrame:
    """(vertex, n, node) so many levels below (vertex, n, node, tokens) of a depth."""

    def run(batches):
        for batch in batches:
            tokens, here = _matrix(batch.column(3), np.uint32), np.arange(len(batch))
            nodes = [batch.column(2).to_numpy().view(np.uint64)]
            for d in range(depth, depth + levels):
                nodes = [_child(h, p, tokens[here, p]) for h in nodes for p in chosen(h, d)]
            for h in nodes:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h.view(np.int64))], ["vertex", "n", "node"])

    return rows.select("vertex", "n", "node", "tokens").mapInArrow(words.freeing(run), "vertex long, n long, node long").distinct()


_PAIR = "a long, b long, ia {0}, ib {0}"


def _alike(stars: DataFrame, sketch: DataFrame) -> DataFrame:
    """(a, b, ia, ib) of the pairs (a, b) that sizes and bytes allow, with the vertices' ids."""
    pairs = stars
    for k in "ba":
        pairs = pairs.join(sketch.select(F.col("vertex").alias(k), F.col("id").alias(f"i{k}"), F.col("n").alias(f"n{k}"), F.col("bytes").alias(f"bytes_{k}")), k)
    pairs = pairs.filter(f"100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            keep = pa.array((_matrix(batch.column(4)) == _matrix(batch.column(5))).sum(axis=1) >= AGREE, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], ["a", "b", "ia", "ib"])

    return pairs.select("a", "b", "ia", "ib", "bytes_a", "bytes_b").mapInArrow(words.freeing(run), _PAIR.format(_kind(sketch)))


def _in_common(own: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each two sets have in common, above the diagonal."""
    m, n = len(own), np.array([len(x) for x in own])
    if m == 2:
        return np.array([[0, len(np.intersect1d(own[0], own[1], assume_unique=True))], [0, 0]])
    # a column is a shingle that two sets have at least, with the rows of its sets side by side
    _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), n)[np.argsort(column, kind="stable")]
    first = np.cumsum(times) - times
    common, few = np.zeros(m * m, dtype=np.float32), m // 10 if m > 64 else 1
    held, size = [], 0
    for f in np.unique(times[(times > 1) & (times <= few)]).tolist():
        starts = first[times == f]
        a, b = np.triu_indices(f, 1)
        step = max(1, CELLS // len(a))
        for k in range(0, len(starts), step):
            rows = row[starts[k : k + step, None] + np.arange(f)]
            held.append((rows[:, a] * m + rows[:, b]).ravel())
            size += len(held[-1])
            if size >= CELLS:
                common += np.bincount(np.concatenate(held), minlength=m * m)
                held, size = [], 0
    if held:
        common += np.bincount(np.concatenate(held), minlength=m * m)
    common = common.reshape(m, m)
    # columns of many rows: products of 0 and 1 count what is common
    dense = np.flatnonzero(times > few) if few > 1 else np.flatnonzero(times > 1)
    width = max(1, CELLS // m)
    for k in range(0, len(dense), width):
        cols = dense[k : k + width]
        part = np.zeros((m, len(cols)), dtype=np.float32)
        place = np.repeat(first[cols] - np.cumsum(times[cols]) + times[cols], times[cols]) + np.arange(times[cols].sum())
        part[row[place], np.repeat(np.arange(len(cols)), times[cols])] = 1
        common += part @ part.T
    return common


def _linked(own: list[np.ndarray], n: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Places of pairs of one node that may be similar enough by halves of their hashes, as many as join its labels.

    n has the full sizes. Halves that meet within a set are known from its size and can hide as much of what is common; halves of two
    sets that meet by chance add to it, once or not at all in sets of usual length. Pairs that such a chance would carry over
    the threshold all go on, to be confirmed, and join nothing here."""
    common, lost = _in_common(own), n - np.array([len(x) for x in own])
    both, hidden = n[:, None] + n[None, :], np.minimum(lost[:, None], lost[None, :])
    i, j = np.nonzero(np.triu(100 * (common + hidden) >= THRESHOLD * (both - common - hidden), 1))
    some = comp[i] != comp[j]
    i, j = i[some], j[some]
    least = common[i, j] - 1 - (n[i] * n[j] >> 28)
    sure = 100 * least >= THRESHOLD * (both[i, j] - least)
    out, root = list(zip(i[~sure].tolist(), j[~sure].tolist(), strict=True)), {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for x, y in zip(i[sure].tolist(), j[sure].tolist(), strict=True):
        a, b = top(int(comp[x])), top(int(comp[y]))
        if a != b:
            root[a] = b
            out.append((x, y))
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole nodes out of rows that are sorted by their first column, the node."""
    held = None  # rows of a node that may go on in the next batch
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        node = batch.column(0).to_numpy()
        cut = int(np.argmax(node == node[-1]))
        held = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut)
    if held is not None:
        yield held


def _bounds(node: np.ndarray) -> list[tuple[int, int]]:
    """First and last place, the latter exclusive, of each node in a batch of _nodes()."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]]).tolist()
    return list(itertools.pairwise(edges))


def _parity(own: np.ndarray) -> np.ndarray:
    """Parity map of a set: whether the number of its hashes with these low bits is odd. Its width is a power of two, from two bits a hash on.

    Two maps of one width differ in as many bits at most as their sets in hashes; halves of a map laid upon each other are the map of half its width."""
    width = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _partnered(maps: list[bytes], n: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Of each set of one node, whether sizes and maps allow it a link with one under another label."""
    keep, size = np.zeros(len(n), dtype=bool), np.array([len(x) for x in maps])
    for width in np.unique(size).tolist():
        # sizes that allow a link have the same width or the next
        own, wide = np.flatnonzero(size == width), np.flatnonzero(size == 2 * width)
        at, cells = np.concatenate([own, wide]), width // 8
        bits = np.frombuffer(b"".join(maps[k] for k in own.tolist()), dtype=np.uint64).reshape(-1, cells)
        if len(wide):
            two = np.frombuffer(b"".join(maps[k] for k in wide.tolist()), dtype=np.uint64).reshape(-1, 2, cells)
            bits = np.concatenate([bits, two[:, 0] ^ two[:, 1]])
        step = max(1, CELLS // (len(at) * max(cells, 8)))
        for k in range(0, len(own), step):
            a, b = at[k : min(k + step, len(own)), None], at[None, k:]
            i, j = np.nonzero((comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b])))
            apart = np.bitwise_count(bits[k + i] ^ bits[k + j]).sum(axis=1, dtype=np.int64)
            i, j = at[k + i], at[k + j]
            some = (100 + THRESHOLD) * apart <= (100 - THRESHOLD) * (n[i] + n[j])
            keep[i[some]] = keep[j[some]] = True
    return keep


def _likely(members: DataFrame) -> DataFrame:
    """(node, vertex, comp) of (node, vertex, comp, n, map) without the vertices that have no link across labels in the node for certain."""

    def run(batches):
        for batch in _nodes(batches):
            node, comp, n = (batch.column(k).to_numpy() for k in (0, 2, 3))
            maps = batch.column(4).to_pylist()
            keep = pa.array(np.concatenate([_partnered(maps[s:e], n[s:e], comp[s:e]) for s, e in _bounds(node)]))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(3)], ["node", "vertex", "comp"])

    ordered = members.select("node", "vertex", "comp", "n", "map").repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(words.freeing(run), "node long, vertex long, comp long").distinct()


def _within(members: DataFrame) -> DataFrame:
    """(a, b, ia, ib) across labels in nodes of (node, vertex, id, n, comp, halves), compared exhaustively node by node."""

    def links(batch):
        node, n, comp = (batch.column(k).to_numpy() for k in (0, 3, 4))
        own = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in batch.column(5)]
        out = [(s + x, s + y) for s, e in _bounds(node) for x, y in _linked(own[s:e], n[s:e], comp[s:e])]
        a, b = (pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ((), ())))
        return pa.RecordBatch.from_arrays([batch.column(c).take(k) for c in (1, 2) for k in (a, b)], ["a", "b", "ia", "ib"])

    def run(batches):
        for batch in _nodes(batches):
            yield links(batch)

    ordered = members.select("node", "vertex", "id", "n", "comp", "halves").repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(words.freeing(run), _PAIR.format(_kind(members))).distinct()


def _labels(links: DataFrame) -> DataFrame:
    """(vertex, comp): a label that linked vertices mostly share, never one across components. Two rounds of smallest neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp"))
    two = both.join(one.withColumnsRenamed({"a": "b", "comp": "next"}), "b").groupBy("a").agg(F.min("next").alias("comp"))
    return two.select(F.col("a").alias("vertex"), "comp")


def _halves(own: np.ndarray) -> np.ndarray:
    return np.unique((own >> np.uint64(32)).astype(np.uint32))


def _full(ids: DataFrame, docs: DataFrame, form: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(vertex, n, words): sets of the texts with these ids, each once a task; other texts under one id weren't asked for.

    words has the hashes in full, or what form makes of them."""

    def make(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, edges, hashes in _sets(batch, 1):
                own = {_digest(x): x for k in range(len(edges) - 1) if len(x := hashes[edges[k] : edges[k + 1]])}
                new = [v for v in own if v not in seen]
                seen.update(new)
                sets = [form(own[v]) if form else own[v] for v in new]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([len(own[v]) for v in new], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["vertex", "n", "words"])

    return docs.join(ids, "id", "left_semi").mapInArrow(words.freeing(make), "vertex long, n long, words binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, store: scratch.Scratch, name: str) -> DataFrame:
    """(a, b) of (a, b, ia, ib) whose full sets are similar enough. Sets are made of the texts of the vertices' ids."""
    ids = store.small(store.table(pairs.select(F.explode(F.array("ia", "ib")).alias("id")).distinct(), f"{name}-ids"))
    # repeated rows give a vertex again: no other links
    sets = store.table(_full(ids, docs), f"{name}-sets")
    heads = store.small(store.table(pairs.select(F.col("a").alias("vertex")).distinct(), f"{name}-heads"))
    heads = sets.join(heads, "vertex", "left_semi").select(F.col("vertex").alias("a"), F.col("words").alias("wa"))
    both = pairs.select("a", "b").join(sets.select(F.col("vertex").alias("b"), F.col("words").alias("wb")), "b").join(heads, "a").select("a", "b", "wa", "wb")

    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                k = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[k] == x).sum())
                keep.append(100 * common >= THRESHOLD * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    links = store.compact(both.mapInArrow(words.freeing(judge), "a long, b long"), f"{name}-links")
    for part in ("ids", "sets", "heads"):
        store.drop(f"{name}-{part}")
    return links


def components(links: DataFrame, store: scratch.Scratch, name: str) -> DataFrame:
    """(vertex, comp) of each vertex in (a, b): comp is the smallest vertex reached. Alternating large and small stars."""
    edges = store.compact(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        step += 1
        edges = store.compact(small.filter("a <> b").distinct(), f"{name}-{step}")
        store.drop(f"{name}-{step - 1}")
        # stars: a vertex below another is below one only, and nothing is below it
        ends = edges.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not ends.filter("down > 1 or (down > 0 and up > 0)").limit(1).count():
            break
    tops = edges.select(F.col("b").alias("vertex"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("comp")).unionByName(tops)


def _shared(rows: DataFrame, comps: DataFrame | None, store: scratch.Scratch, name: str) -> DataFrame:
    """Rows of (vertex, n, node) whose node is under more than one label, with label, size and weight of the node."""
    label = F.col("vertex") if comps is None else F.coalesce("comp", "vertex")
    rows = rows.select("vertex", "n", "node")
    rows = (rows if comps is None else rows.join(comps, "vertex", "left")).select("vertex", "n", "node", label.alias("comp"))
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    nodes = store.table(nodes.filter("low <> high").select("node", "size", "weight"), f"{name}-nodes")
    return store.table(rows.join(store.small(nodes), "node"), name)


def _stars(live: DataFrame) -> DataFrame:
    """(a, b): each vertex b with the leaders a of its nodes. A leader is met in most places of its nodes; a hash breaks ties."""
    weight = live.groupBy("vertex").agg((F.sum("size") * 1024 + F.pmod(F.xxhash64("vertex"), F.lit(1024))).alias("weight"))
    leaders = live.select("vertex", "node").join(weight, "vertex").groupBy("node").agg(F.max_by("vertex", "weight").alias("a"))
    return live.select(F.col("vertex").alias("b"), "node").join(leaders, "node").filter("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each document."""
    spark = docs.sparkSession
    store = scratch.Scratch(spark, "near", BATCH)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = store.table(signatures(docs), "signed")
    vertices = signed.filter("vertex is not null").groupBy("vertex").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count("*").alias("many"), F.min("tokens").alias("tokens"))
    vertices = store.table(_with_bytes(vertices), "vertices")
    sketch = vertices.select("vertex", "id", "n", "bytes")
    rows, comps, links, ended, d = _roots(vertices), None, None, [], 1
    while True:
        live = _shared(rows, comps, store, f"live-{d}")
        new = _confirmed(store.compact(_alike(_stars(live), sketch), f"star-{d}"), docs, store, f"star-{d}")
        links = new if links is None else store.compact(links.unionByName(new), f"links-{d}")
        comps = store.small(store.table(_labels(links), f"labels-{d}"))
        alive = _shared(live, comps, store, f"alive-{d}")
        store.drop(f"live-{d}")
        fits = F.col("size").between(0, small) & ((F.col("weight") <= WEIGHT) | (F.col("size") <= 8))
        ended.append(alive.filter(fits).select("vertex", "node", "comp"))
        large = alive.filter(~fits)
        if d >= depth or not large.limit(1).count():
            break
        # each level leaves a quarter or so of a node that a passage holds together; what resists goes on in longer steps
        levels = min(JUMP, depth - d, max(len(ended), math.ceil(math.log(max(1.0, large.agg(F.max("size")).first()[0] / small), 4))))
        rows = store.table(_branches(large.select("vertex", "n", "node").join(vertices.select("vertex", "tokens"), "vertex"), d, levels), f"branches-{d}")
        d += levels

    # nodes that are large when all positions are used up are compared block with block
    blocks = F.greatest(F.ceil(F.col("size") * 2 / small), F.ceil(F.col("weight") * 2 / WEIGHT)).cast("int")
    own = F.pmod(F.xxhash64("vertex", F.lit(99)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    halves = large.select("vertex", "node", "comp", own.alias("own"), other).withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    rest = halves.select("vertex", "node", "comp")
    for more in ended:
        rest = rest.unionByName(more)

    def formed(rows: DataFrame, form: Callable, name: str) -> DataFrame:
        used = store.table(rows.select("vertex").distinct().join(vertices.select("vertex", "id"), "vertex"), name)
        sets = _full(store.small(used.select("id")), docs, form).join(store.small(used), "vertex").select("vertex", "id", "n", "words")
        return rows.join(sets, "vertex")

    likely = store.table(_likely(formed(rest, _parity, "used").withColumnRenamed("words", "map")), "likely")
    members = formed(likely, _halves, "left").withColumnRenamed("words", "halves")
    comps = components(links.unionByName(_confirmed(store.compact(_within(members), "pairs"), docs, store, "within")), store, "final")

    named = store.table(vertices.select("vertex", "id", "many").join(comps, "vertex", "left").filter("comp is not null or many > 1"), "named")
    least = named.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    known = store.table(named.join(least, "comp", "left").select("vertex", F.coalesce("least", "id").alias("component_id")), "known")
    out = signed.select("id", "n", "vertex").join(store.small(known), "vertex", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of a pipeline: of each component the document with the smallest id stays, columns as they were.

    A document is an id and a text: rows that repeat both stay or go together, other texts under one id are judged by themselves, the
    one with the smaller hash first. Rows with a null id, a null text or no words stay. An empty table gives an empty one. Texts of any
    length count whole. Columns may have any name."""
    store = scratch.Scratch(spark, "one-of-each")
    rows, at = scratch.positional(docs)
    key = F.when(F.col(at["doc_id"]).isNotNull(), F.struct(F.col(at["doc_id"]).alias("id"), F.xxhash64(F.col(at["text"]).cast("string")).alias("text")))
    rows = rows.withColumn("key", key)
    gone = store.table(near_duplicates(rows, "key", at["text"]).filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return rows.join(store.small(gone), F.col("key") == F.col("gone"), "left_anti").drop("key").toDF(*docs.columns)
