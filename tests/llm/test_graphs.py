"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from gridlace.llm import graphs

COLS = ["query_id", "rank", "vec_id", "score"]
SCHEMA = "vec_id long, embedding array<float>, vec string, size string, shard string, score string"


def brute(rows, is_query, top=20):
    rows = [(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    rows = sorted(set(rows))
    out = []
    for q, v in rows:
        if is_query(q):
            scored = []
            for i, w in rows:
                if i != q and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v, w, strict=True):
                        s += a * b
                    scored.append((-s, i))
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "v", "s", "h", "c") for r in rows], SCHEMA).repartition(4)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def found(spark, rows, **more):
    df = table(spark, rows)
    return got(graphs.neighbours(df, df.filter("vec_id % 20 = 0"), **more))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    own = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 30])).tolist()) for i in range(150)]
    own += [(200 + i, own[20][1]) for i in range(60)]  # a group of copies, some of which are queries
    own += [(300 + i, rng.normal(size=3).tolist()) for i in range(25)]  # of other sizes
    own += [(400, None), (401, []), (402, [0.0] * 8), (420, [1.0, None] + [0.0] * 6), (440, [math.inf] + [0.0] * 7), (460, [math.nan] * 8), (None, own[0][1]), (480, [5.0])]
    return [*own, own[40], own[40]]  # rows that are repeated


def test_small_tables_are_exact(spark, rows):
    want = brute(rows, lambda i: i % 20 == 0)
    assert found(spark, rows) == want
    assert found(spark, rows, shard=40, block=3) == want  # several shards, several blocks of queries
    assert found(spark, rows, top=3) == brute(rows, lambda i: i % 20 == 0, 3)
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(20, [1.0])]) == []


def test_recall(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 24))
    near = centres[0] + 1e-3 * rng.normal(size=(600, 24))  # a large group of near copies
    vectors = np.vstack([centres[rng.integers(0, 12, 3000)] + 0.7 * rng.normal(size=(3000, 24)), near]) * rng.uniform(0.5, 2, (3600, 1))
    rows = [(i, v) for i, v in enumerate(vectors.astype(np.float32).astype(float).tolist())]
    want = brute(rows, lambda i: i % 20 == 0)
    out = found(spark, rows, shard=2000)
    assert len(out) == len(want) == 180 * 20
    ids = lambda r: {(q, i) for q, _, i, _ in r}
    assert len(ids(out) & ids(want)) >= 0.95 * len(want)
    exact = {}
    for q, _, i, s in out:  # scores are exact whatever was found
        if (q, i) not in exact:
            exact[q, i] = s
            total = 0.0
            for a, b in zip(rows[q][1], rows[i][1], strict=True):
                total += a * b
            assert s == total


@pytest.mark.parametrize("copies", [0, 700])
def test_every_point_is_reached(copies):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1000, 6))
    v[:copies] = v[0] + 1e-6 * rng.normal(size=(copies, 6))
    g = graphs.build(graphs.lifted(v), degree=8, beam=16)
    reached, front = {g.start}, [g.start]
    while front:
        front = [int(t) for p in front for t in g.edges[p] if t >= 0]
        front = [t for t in dict.fromkeys(front) if t not in reached]
        reached.update(front)
    assert len(reached) == len(v)
    for p in range(0, 1000, 50):
        own = [t for t in g.edges[p].tolist() if t >= 0]
        assert len(own) == len(set(own)) and p not in own


def test_pruning_keeps_diverse_edges():
    at = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [0, 2.2], [-3, 0]], dtype=np.float32)
    got_ = graphs.prune(at, np.array([0]), np.array([[5, 2, 4, 1, 3, -1, 0, 1]]), 4)
    assert got_.tolist() == [[1, 3, 5, -1]]


def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert got(graphs.op12_neighbours(spark, "/root/testdata/sf0.001")) == sorted(con.sql(graphs.OP12_SQL).select(*COLS).fetchall())
