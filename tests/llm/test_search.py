"""Ranked search against a plain form and against DuckDB."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridlace.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
COLS = ["item_id", "rank", "doc_id", "score"]
CLASH = "doc_id long, text string, n long, terms string, item_id string, rank string, score string"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n, total = len(own), sum(x for *_, x in own)
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in wanted.items():
        scored = []
        for d, c, x in own:
            m = 10 + (90 * x * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeéß9") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab[: rng.choice([10, 400])]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "... !"), (303, text(20000)), (None, docs[5][1]), (5, docs[5][1]), (5, text(9)), (304, "ÉA éa Éa"), (305, "x_y\x7fz")]
    docs += [(400 + i, docs[7][1]) for i in range(200)]  # ties
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(31, docs[7][1]), (32, None), (33, "."), (34, "nowhere"), (None, docs[5][1]), (35, "éA x y"), (35, "Z z z")]
    return docs, items


def tables(spark, data):
    docs = spark.createDataFrame([(*d, 1, "t", "i", "r", "s") for d in data[0]], CLASH).repartition(5)
    return docs, spark.createDataFrame([(*i, "d", "n") for i in data[1]], "item_id long, text string, doc_id string, terms string")


def got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


@pytest.mark.parametrize(("pairs", "shard"), [(search.PAIRS, search.SHARD), (100, 500)])
def test_search(spark, data, pairs, shard):
    assert got(search.search(*tables(spark, data), pairs=pairs, shard=shard)) == brute(*data)


def test_other_tops_and_empty_tables(spark, data):
    docs, items = tables(spark, data)
    assert got(search.search(docs, items, top=3)) == brute(*data, top=3)
    assert search.search(docs.filter("false"), items).count() == 0
    assert search.search(docs, items.filter("false")).count() == 0
    assert search.search(docs.filter("doc_id in (300, 301, 302)"), items).count() == 0
    with pytest.raises(TypeError):
        search.search(docs, items, id_col="text")


def test_threshold_ends_a_search_early():
    rng = np.random.default_rng(3)
    n, size = 5000, 50
    terms_, edges = [], [0]
    for _ in range(n):
        own = np.unique(rng.integers(0, size, 8))
        terms_.append(own)
        edges.append(edges[-1] + len(own))
    flat = np.concatenate(terms_)
    impact = (rng.pareto(2, len(flat)) * 1000).astype(np.int64)
    shard = search.Shard(np.arange(n), np.zeros(n, dtype=bool), flat, impact, np.array(edges), size)
    weight, own, best = np.zeros(size, dtype=np.int64), np.array([3, 7, 11]), search.Best(10)
    weight[own] = [5, 9, 2]
    seen = shard.search(own, weight, best)
    all_ = [sum(int(weight[t]) * int(v) for t, v in zip(flat[a:b], impact[a:b], strict=True)) for a, b in zip(edges, edges[1:], strict=False)]
    want = sorted((-s, d) for d, s in enumerate(all_))[:10]
    assert [(-s, d) for s, d in zip(best.score.tolist(), best.id.tolist(), strict=True)] == want
    assert seen < sum(1 for s in all_ if s) / 4 and not shard.met.any()


def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert got(search.op13_search(spark, "/root/testdata/sf0.001")) == sorted(con.sql(search.OP13_SQL).select(*COLS).fetchall(), key=str)
