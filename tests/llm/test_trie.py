"""The trie of conversations against a plain form and against DuckDB."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridlace.llm import scans, scratch, trie

SCHEMA = "conv_id long, turn int, role string, text string, node string, seq string, digest string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(seqs):
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    count = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode()))
    own = {n: (len(m) - 1) * (count(n[-1][1]) if n else 0) for n, m in nodes.items()}
    kids = defaultdict(int)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in nodes:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += own[n]
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(n)))).encode()).hexdigest())
        for n, m in nodes.items()
    )


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", "s", "d") for r in rows], SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def made(spark, rows):
    store = scratch.Scratch(spark, "trie")
    return trie.build(trie.with_shared_heads(trie.ordered_turns(table(spark, rows), store)), store)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", " ", "", None, "é  ü\t x"])) for c in range(60) for t in range(rng.randint(1, 6))]
    out += [(100 + c, t, "user", "same words here") for c in range(30) for t in range(3)]  # a group of copies
    out += [(7, 1, "user", "c")] * 5 + [(None, 1, "user", "no conversation")]  # rows that are repeated, and a null id
    out += [(41, t, "bot", f"long {t % 3}") for t in range(300)] + [(57, t, "bot", f"long {t % 3}") for t in range(280)]
    return out + [(500, 0, "user", "x " * 20000)]


@pytest.mark.parametrize("block", [64, 3])
def test_trie(spark, rows, block, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PACK", 16)
    out = made(spark, rows)
    assert got(out) == brute(rebuilt(rows))
    # the interval of a node holds those of its subtree, and no others begin in it
    spans = {(r.conv_id, r.depth): (r.node, r.last) for r in out.collect()}
    assert sorted(n for n, _ in spans.values()) == list(range(len(spans)))
    seqs = rebuilt(rows)
    for (c, d), (node, last) in random.Random(1).sample(sorted(spans.items()), 30):
        inside = {k for k, (n, _) in spans.items() if node <= n <= last}
        assert inside == {k for k in spans if k[1] >= d and seqs[k[0]][:d] == seqs[c][:d]}


def test_plain_trie(spark, rows):
    own = [(c, t, r, x) for c, t, r, x in rows if c is not None and t is not None][:150]
    seqs = defaultdict(list)
    for c, t, r, x in sorted(own, key=lambda o: (o[0], o[1])):
        seqs[c].append((r or "", x or ""))
    assert len({(c, t) for c, t, *_ in own}) == len(own)
    assert got(trie.prefix_trie(table(spark, own))) == brute(seqs)


def test_empty_and_turnless(spark):
    assert made(spark, []).count() == 0
    # crc32 of these ids asks for more turns than they have, and there is no conversation to take them from
    ids = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, t, "user", "w") for c in ids for t in range(2)]
    assert got(made(spark, rows)) == brute(rebuilt(rows)) and len(brute(rebuilt(rows))) == 1


def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(trie.OP11_SQL).select(*COLS).fetchall()
    assert got(trie.op11_trie(spark, "/root/testdata/sf0.001")) == sorted(want)


def test_scan(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), i, rng.randint(-9, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i long, v long").repartition(5)
    df = df.withColumn("x", df.v)
    out = scans.scan(df, ["k", "i"], scratch.Scratch(spark, "scan"), "s", sums=("v",), xors=("x",)).orderBy("rank").collect()
    total = both = 0
    for n, (r, w) in enumerate(zip(out, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), strict=True)):
        total, both = total + w[2], both ^ w[2]
        assert (r["rank"], r["k"], r["i"], r["v_upto"], r["x_upto"]) == (n, w[0], w[1], total, both)
    none = scans.scan(df.filter("i < 0"), ["k", "i"], scratch.Scratch(spark, "scan"), "s", sums=("v",))
    assert none.columns == ["k", "i", "v", "x", "rank", "v_upto"] and none.count() == 0
