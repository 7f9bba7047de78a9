"""Nearest neighbours by largest inner product: a robust-pruned directed graph for each shard, searched by beams.

1. Vectors that are equal bit by bit become one point with the smallest TOP + 1 of its ids: no query needs more of them.
2. Points are dealt into shards of about SHARD by a hash; one task builds a shard's graph. Vectors get one more component that makes all
   norms alike, so that the largest inner product is the least distance. Points join the graph in growing batches: a
   greedy search proposes neighbours; of these the nearest stays, and those go that are ALPHA times nearer to one that stayed than to the
   point, until DEGREE are chosen; edges back are added and pruned alike. Points that can't be reached from the start get an edge from their nearest reachable one.
3. Graphs are written, one row a shard. Distinct query vectors go to all tasks in blocks of QUERIES; each shard is searched by a beam of BEAM points.
   Inner products of what the beam holds are computed anew, in double precision, component by component. Each task passes on its best; Spark merges them.

Every vector is in the index; nothing is fitted on a sample. Defined results: vectors that are null, empty, zero, or that hold null or non-finite components
take no part, nor do rows with a null id; vectors meet only those with as many components; equal scores go by smaller id; rows that repeat id and vector are
one, rows that share an id are no partners of each other; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, words

#: Neighbours of a query, points of a shard, query vectors of a block (and bytes of them), points of a beam.
TOP, SHARD, QUERIES, QUERY_BYTES, BEAM = 20, 16_384, 65_536, 64 << 20, 160
#: Edges of a point, points of a beam while building, relaxation of distances, points that join at once.
DEGREE, BUILD_BEAM, ALPHA, BATCH = 48, 64, 1.2, 512
#: Points that a beam expands in one step, searches that run side by side, edges of a point to further ones that could not be reached.
WIDTH, TOGETHER, FAN = 4, 512, 8


class Graph:
    """A directed graph of points (rows of at, with equal norms); edges has DEGREE places a row, -1 where there is none, and extra further edges."""

    def __init__(self, at: np.ndarray, start: int, edges: np.ndarray):
        self.at, self.start, self.edges = at, start, edges
        self.norm = np.einsum("ij,ij->i", at, at)

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, squared distances) of the nearest width points that greedy searches meet, nearest first; -1 and inf where there are fewer."""
        n = len(queries)
        ids = np.full((n, width), -1, dtype=np.int64)
        far = np.full((n, width), np.inf, dtype=np.float32)
        done = np.ones((n, width), dtype=bool)
        seen = np.zeros((n, len(self.at) + 1), dtype=bool)
        seen[:, -1] = seen[:, self.start] = True  # the last stands for no point
        square = np.einsum("ij,ij->i", queries, queries)
        ids[:, 0], done[:, 0] = self.start, False
        far[:, 0] = square + self.norm[self.start] - 2 * (queries @ self.at[self.start])
        live = np.arange(n)
        while len(live):
            # the nearest points of each beam that haven't been expanded
            open_ = ~done[live]
            take = open_ & (np.cumsum(open_, axis=1) <= WIDTH)
            row, col = np.nonzero(take)
            done[live[row], col] = True
            to = self.edges[ids[live[row], col]]
            who = np.repeat(live[row], to.shape[1])
            to = to.ravel()
            new = ~seen[who, to]
            pair = np.unique(who[new] * np.int64(len(self.at) + 1) + to[new])
            who, to = np.divmod(pair, len(self.at) + 1)
            seen[who, to] = True
            # as a matrix of what each search has met
            count = np.bincount(who, minlength=n)[live]
            most = int(count.max(initial=0))
            if most:
                place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                line = np.searchsorted(live, who)
                fresh = np.full((len(live), most), -1, dtype=np.int64)
                away = np.full((len(live), most), np.inf, dtype=np.float32)
                fresh[line, place] = to
                away[line, place] = square[who] + self.norm[to] - 2 * np.einsum("ij,ij->i", queries[who], self.at[to])
                all_ids, all_far = np.hstack([ids[live], fresh]), np.hstack([far[live], away])
                all_done = np.hstack([done[live], fresh < 0])
                order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
                ids[live], far[live], done[live] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_far, all_done))
            live = live[(~done[live]).any(axis=1)]
        return ids, far


def prune(at: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Edges of points out of candidates (-1: none): the nearest that is left stays, and those nearer to it by alpha than to the point go."""
    n, m = candidates.shape
    own = at[candidates]
    to = np.einsum("ijk,ijk->ij", own - at[points][:, None], own - at[points][:, None])
    to[(candidates < 0) | (candidates == points[:, None])] = np.inf
    order = np.argsort(to, axis=1, kind="stable")
    candidates, to = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(to, order, axis=1)
    own = np.take_along_axis(own, order[:, :, None], axis=1)
    norm = np.einsum("ijk,ijk->ij", own, own)
    between = np.matmul(own, own.transpose(0, 2, 1))
    between *= -2
    between += norm[:, :, None]
    between += norm[:, None, :]
    np.maximum(between, 0, out=between)
    between *= np.float32(alpha * alpha)
    # a candidate that stands twice is next to itself
    left = np.isfinite(to)
    out = np.full((n, degree), -1, dtype=np.int64)
    rows = np.arange(n)
    for k in range(degree):
        some = left.any(axis=1)
        if not some.any():
            break
        best = left.argmax(axis=1)
        out[some, k] = candidates[some, best[some]]
        left &= (between[rows, best] > to) & (candidates != candidates[rows, best][:, None])
    return out


def _add_back(at: np.ndarray, edges: np.ndarray, batch: np.ndarray) -> None:
    """Edges back to the points of a batch; rows that overflow are pruned."""
    source = np.repeat(batch, edges.shape[1])
    target = edges[batch].ravel()
    some = target >= 0
    source, target = source[some], target[some]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    each, first, count = np.unique(target, return_index=True, return_counts=True)
    for i in range(0, len(each), BATCH):
        points, size = each[i : i + BATCH], count[i : i + BATCH]
        more = np.full((len(points), int(size.max())), -1, dtype=np.int64)
        line = np.repeat(np.arange(len(points)), size)
        span = slice(first[i], first[i] + int(size.sum()))
        more[line, np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)] = source[span]
        both = np.hstack([edges[points], more])
        both[:, edges.shape[1] :][(more[:, :, None] == edges[points][:, None]).any(axis=2)] = -1  # known already
        over = (both >= 0).sum(axis=1) > edges.shape[1]
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        edges[points] = packed[:, : edges.shape[1]]
        if over.any():
            edges[points[over]] = prune(at, points[over], both[over], edges.shape[1])


def build(at: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> Graph:
    """A graph of all points, each of which can be reached from the start."""
    n = len(at)
    mean = at.mean(axis=0)
    start = int(np.argmin(((at - mean) ** 2).sum(axis=1)))
    graph = Graph(at, start, np.full((n, degree), -1, dtype=np.int64))
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    order = order[order != start]
    done = 0
    while done < len(order):
        batch = order[done : done + min(max(1, done // 8), BATCH)]
        got, _ = graph.beam(at[batch], min(beam, max(1, done + 1)))
        # those of one batch don't see each other in the graph yet
        graph.edges[batch] = prune(at, batch, got, degree)
        _add_back(at, graph.edges, batch)
        done += len(batch)
    while True:
        reached = np.zeros(n + 1, dtype=bool)
        front = np.array([start])
        reached[[start, n]] = True
        while len(front):
            front = np.unique(graph.edges[front].ravel())
            front = front[~reached[front]]
            reached[front] = True
        lost = np.flatnonzero(~reached[:-1])
        if not len(lost):
            return graph
        some = lost[:TOGETHER]
        near = graph.beam(at[some], 1)[0][:, 0]
        for q in np.unique(near).tolist():
            own = some[near == q]
            free = np.flatnonzero(graph.edges[q] < 0)
            if not len(free):  # one more place for all
                graph.edges = np.hstack([graph.edges, np.full((n, 1), -1, dtype=np.int64)])
                free = [graph.edges.shape[1] - 1]
            graph.edges[q, free[0]] = own[0]
            # further ones hang on it as a heap; their edges may go, as none of them was reached by these
            for i in range(len(own)):
                below = own[FAN * i + 1 : FAN * i + FAN + 1]
                graph.edges[own[i], degree - len(below) : degree] = below


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a further component that makes their norms alike, scaled to norm 1: the nearest to (q, 0) has the largest inner product with q."""
    scale = np.abs(vectors).max()
    v = vectors / scale
    square = np.einsum("ij,ij->i", v, v)
    most = square.max()
    return (np.hstack([v, np.sqrt(np.maximum(most - square, 0))[:, None]]) / np.sqrt(most)).astype(np.float32)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices in double precision, components added in order."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def points(vectors: DataFrame, id_col: str, vec_col: str, top: int) -> DataFrame:
    """(vec, ids, size): distinct usable vectors as bytes of doubles, the top + 1 smallest ids of each, and the number of components."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            good = (np.diff(bad[edges]) == 0) & (np.diff(some[edges]) > 0)
            raw = [flat[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(good).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    plain = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
    return plain.mapInArrow(words.freeing(run), "vec_id long, vec binary").distinct()


def _indexed(points_: DataFrame, store: scratch.Scratch, top: int, shard: int) -> DataFrame:
    """(shard, size, vecs, ids, counts, start, edges): one row for each shard."""
    first = points_.withColumn("k", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("k") <= top + 1)
    each = store.table(first.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("size", F.length("vec")), "points")
    sizes = {r["size"]: -(-r["n"] // shard) for r in each.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row for each number of components
    if not sizes:
        return each.sparkSession.createDataFrame([], "size int, vecs binary, ids binary, counts binary, start int, edges binary")
    many = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("vec"), many[F.col("size")]))

    def run(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py() // 8
        own = table.combine_chunks()
        vecs = np.frombuffer(b"".join(own["vec"].to_pylist()), dtype=np.float64).reshape(-1, size)
        with np.errstate(over="ignore", invalid="ignore"):
            g = build(lifted(vecs))
        ids = own["ids"].combine_chunks()
        flat = ids.flatten().to_numpy().astype("<i8").tobytes()
        row = [[table["size"][0].as_py()], [vecs.tobytes()], [flat], [ids.value_lengths().to_numpy().astype("<i4").tobytes()], [g.start], [g.edges.astype("<i4").tobytes()]]
        return pa.table([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.large_binary(), pa.large_binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["size", "vecs", "ids", "counts", "start", "edges"]).cast(
            pa.schema([("size", pa.int32()), ("vecs", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("start", pa.int32()), ("edges", pa.binary())])
        )

    built = dealt.groupBy("size", "shard").applyInArrow(run, "size int, vecs binary, ids binary, counts binary, start int, edges binary")
    return store.table(built, "graphs")


def _searched(graphs: DataFrame, queries: np.ndarray, size: int, top: int, beam: int) -> DataFrame:
    """(query, vec_id, score): for each query its best points of each task; query is the row in queries."""
    sent = graphs.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q = sent.value
        best_score = np.full((len(q), top + 1), -np.inf)
        best_id = np.full((len(q), top + 1), np.iinfo(np.int64).max)
        with np.errstate(over="ignore", invalid="ignore"):
            asked = np.hstack([q / np.abs(q).max(axis=1)[:, None], np.zeros((len(q), 1))])
            asked = (asked / np.sqrt(np.einsum("ij,ij->i", asked, asked))[:, None]).astype(np.float32)
            for batch in batches:
                for r in batch.to_pylist():
                    vecs = np.frombuffer(r["vecs"], dtype=np.float64).reshape(-1, size)
                    counts = np.frombuffer(r["counts"], dtype="<i4")
                    ids, first = np.frombuffer(r["ids"], dtype="<i8"), np.concatenate([[0], np.cumsum(counts)])
                    g = Graph(lifted(vecs), r["start"], np.frombuffer(r["edges"], dtype="<i4").astype(np.int64).reshape(len(vecs), -1))
                    for i in range(0, len(q), TOGETHER):
                        got, _ = g.beam(asked[i : i + TOGETHER], min(beam, len(vecs)))
                        row, col = np.nonzero(got >= 0)
                        point = got[row, col]
                        score = inner(q[i + row], vecs[point])
                        # a point stands for several ids
                        n = counts[point]
                        each = np.repeat(first[point] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                        who, s, v = np.repeat(row + i, n), np.repeat(score, n), ids[each]
                        mine = np.arange(i, min(i + TOGETHER, len(q)))
                        who = np.concatenate([np.repeat(mine, top + 1), who])
                        s, v = np.concatenate([best_score[mine].ravel(), s]), np.concatenate([best_id[mine].ravel(), v])
                        order = np.lexsort((v, -s, who))
                        rank = np.arange(len(who)) - np.searchsorted(who[order], who[order])
                        keep = order[rank <= top]
                        best_score[mine], best_id[mine] = s[keep].reshape(len(mine), -1), v[keep].reshape(len(mine), -1)
        row, col = np.nonzero(best_score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(best_id[row, col]), pa.array(best_score[row, col])], ["query", "vec_id", "score"])

    return graphs.filter(F.col("size") == size * 8).mapInArrow(words.freeing(run), "query long, vec_id long, score double")


def neighbours(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, shard: int = SHARD, beam: int = BEAM, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the top vectors of other ids with the largest inner product, as the graphs find them."""
    spark = vectors.sparkSession
    store = scratch.Scratch(spark, "graphs")
    graphs = _indexed(store.table(points(vectors, id_col, vec_col, top), "all"), store, top, shard)
    asked = store.table(points(queries, id_col, vec_col, top), "asked")
    distinct = asked.select("vec").distinct().withColumn("size", F.length("vec"))
    sizes = {r["size"]: r["n"] for r in distinct.groupBy("size").agg(F.count("*").alias("n")).collect()}
    out = spark.createDataFrame([], "vec binary, vec_id long, score double")
    for size, n in sorted(sizes.items()):
        blocks = -(-n // min(block, max(1, QUERY_BYTES // size)))
        for b in range(blocks):
            own = distinct.filter((F.col("size") == size) & (F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(blocks)) == b)).select("vec")
            raw = [bytes(r["vec"]) for r in own.orderBy("vec").collect()]
            found = _searched(graphs, np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1), size // 8, top, beam)
            named = spark.createDataFrame(list(enumerate(raw)), "query long, vec binary")
            best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
            merged = found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= top + 1)
            out = out.unionByName(store.table(merged.join(F.broadcast(named), "query").select("vec", "vec_id", "score"), f"found{size}-{b}"))
    lists = out.groupBy("vec").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))
    near = asked.withColumnRenamed("vec_id", "query_id").join(lists, "vec")
    # its own id is one of top + 1 at most
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    ranked = F.slice(F.array_sort(F.transform(others, lambda x: F.struct((-x["score"]).alias("away"), x["vec_id"].alias("vec_id"), x["score"].alias("score")))), 1, top)
    return near.select("query_id", F.posexplode(ranked).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


#: Exact search of all rows: what the graphs find on tables whose shards a beam covers largely. Components are added in order.
OP12_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b, 0::DOUBLE) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP}
"""
