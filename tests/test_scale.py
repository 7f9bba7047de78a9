"""Parts that are there for size: crowded cells, ids without a shared folder, samples, fixed dictionaries, random numbers."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridlace.functions import random as rnd
from gridlace.operators import graph, matrix, summary
from gridlace.sources import shared, synthetic

NODE = "node long, cx double, cy double"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def all_pairs(pts, r):
    return sorted((a[0], b[0]) for i, a in enumerate(pts) for b in pts[i + 1 :] if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= r * r)


@pytest.fixture(params=[True, False], ids=["shared", "unshared"])
def folder(request, monkeypatch):
    if not request.param:
        monkeypatch.setattr(shared, "folder", lambda spark: None)


def test_crowded_cells(spark, folder):
    """A cell with most nodes, many of them in one place, beside cells with few: the same edges as of all pairs."""
    rng = random.Random(4)
    pts = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(150)] + [(3.25, 3.25)] * 60 + [(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(120)] + [(10.0 * i, 0.0) for i in range(-3, 4)]
    pts = [(i, *p) for i, p in enumerate(pts)]
    nodes = spark.createDataFrame(pts, NODE).repartition(4)
    for r in (10.0, 2.0):
        want = all_pairs(pts, r)
        assert rows(graph.neighbours(nodes, r, crowd=25), "src", "dst") == want
    assert rows(graph.neighbours(nodes, 10.0), "src", "dst") == all_pairs(pts, 10.0)


def test_crowded_cells_of_bins(spark, folder):
    """Nodes that are named by pairs, as bins are."""
    rng = random.Random(8)
    pts = [(i, rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(90)]
    nodes = spark.createDataFrame(pts, NODE).select(F.struct((F.col("node") % 7).alias("bx"), F.col("node").alias("by")).alias("node"), "cx", "cy")
    got = graph.neighbours(nodes, 2.0, crowd=20).select(F.least("src.by", "dst.by").alias("a"), F.greatest("src.by", "dst.by").alias("b"))
    assert rows(got, "a", "b") == all_pairs(pts, 2.0)


def test_no_key_has_more_than_a_block(spark, monkeypatch):
    """Largest number of nodes on either side of a key, in a cell that holds all of them."""
    rng = random.Random(5)
    nodes = spark.createDataFrame([(i, rng.gauss(0.5, 0.1), rng.gauss(0.5, 0.1)) for i in range(3000)], NODE)
    seen = []

    def met(left, right, keys, r):
        seen.append(max((df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) for df in (left, right)))
        return own(left, right, keys, r)

    own = graph._met
    monkeypatch.setattr(graph, "_met", met)
    far = graph.neighbours(nodes, 3.0, crowd=200)  # one cell or four, all within reach
    assert far.count() == 3000 * 2999 // 2
    assert max(seen) <= 200


def test_a_lattice_stays_within_its_bound():
    for r, s in ((15.0, 10.0), (30.0, 20.0), (100.0, 3.0), (1.0, 5.0)):
        side = r * graph._SLACK
        most = max(sum(1 for i in range(int(side / s) + 2) if 0 <= i * s + o < side) for o in (0.0, s / 3, s / 2)) ** 2
        assert most * 1.16 <= graph.lattice_bound(s, r)


def test_ids_with_one_hot_value(spark, folder):
    rng = random.Random(6)
    keys = list({(7, rng.randint(-999, 999)) for _ in range(700)} | {(rng.randint(-9, 9), i) for i in range(60)})
    rng.shuffle(keys)
    df = spark.createDataFrame(keys, "a long, b long").repartition(3)
    assert [(r.a, r.b) for r in matrix.dense_ids(df, "a", "b", "id").orderBy("id").collect()] == sorted(keys)
    sizes = [r["count"] for r in matrix._ranged(df, "a", "b").groupBy("__part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.7 * len(keys)  # the hot value is in several ranges
    assert matrix.dense_ids(df.filter("a > 99"), "a", "b", "id").count() == 0
    texts = df.select(F.col("a").cast("string").alias("a"), F.when(F.col("b") > 0, F.col("b").cast("string")).alias("b")).distinct()
    got = [(r.a, r.b) for r in matrix.dense_ids(texts, "a", "b", "id").orderBy("id").collect()]
    assert got == sorted(got, key=lambda k: (k[0], k[1] is not None, k[1] or ""))


def test_unknown_genes(spark):
    df = spark.createDataFrame([(0.5, 0.5, "A"), (0.5, 0.6, "X"), (0.6, 0.5, "Y"), (2.5, 0.5, "B"), (2.5, 0.5, "X")], "x double, y double, gene string")
    known = spark.createDataFrame([("B",), ("A",), ("C",)], "gene string")
    m = matrix.compute_square_bins(df, 1.0, known)
    assert rows(m.cells, "bin_id", "gene_id", "n") == [(0, -1, 2), (0, 0, 1), (1, -1, 1), (1, 1, 1)]
    assert rows(m.genes, "gene", "gene_id") == [("A", 0), ("B", 1), ("C", 2)]
    # ids of a dictionary that several data sets share stay
    given = spark.createDataFrame([("A", 40), ("B", 7)], "gene string, gene_id int")
    assert rows(matrix.compute_square_bins(df, 1.0, given).cells, "bin_id", "gene_id", "n") == [(0, -1, 2), (0, 40, 1), (1, -1, 1), (1, 7, 1)]
    assert rows(matrix.compute_square_bins(df, 1.0).cells, "gene_id", "n") == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 1)]


def test_sample_is_exact_for_any_partitioning(spark):
    own = [(i, None if i % 50 == 0 else i / 7, "g") for i in range(2000)] + [(5, 0.25, "same")] * 40
    df = spark.createDataFrame(own, "id long, x double, gene string")
    draws = [sorted(map(str, summary.sample(df.repartition(n), 300).collect())) for n in (1, 7)]
    assert draws[0] == draws[1] and len(draws[0]) == 300
    by_id = [r.id for r in summary.sample(df.filter("gene = 'g'"), 250, seed=9, keys=["id"]).collect()]
    want = sorted(range(2000), key=lambda i: hashlib.md5(f"9:sample:{i}".encode()).hexdigest())[:250]
    assert sorted(by_id) == sorted(want)
    assert summary.sample(df, 0).count() == 0 and summary.sample(df, 5000).count() == 2040 and summary.sample(df.filter("false"), 5).count() == 0
    # more copies of one row than are asked for
    assert summary.sample(df.filter("gene = 'same'"), 15).count() == 15


def test_random_numbers_do_not_follow_partitions(spark):
    ids = spark.range(4000)
    one, eight = (rows(synthetic.molecules_of(ids.repartition(n), 2000), "id", "x", "y", "gene") for n in (1, 8))
    assert one == eight
    assert rows(synthetic.molecules_of(ids, 2000, seed=43), "id", "x") != [r[:2] for r in one]
    drawn = ids.select(rnd.uniform(1, "u", F.col("id")).alias("u"), rnd.normal(1, "n", F.col("id")).alias("n"), rnd.choice(1, "c", ("a", "b", "c"), F.col("id"), shares=[0.5, 0.2, 0.3]).alias("c")).collect()
    u, n = [r.u for r in drawn], [r.n for r in drawn]
    assert all(0 <= x < 1 for x in u) and abs(statistics.fmean(u) - 0.5) < 0.02 and abs(statistics.pvariance(u) - 1 / 12) < 0.005
    assert abs(statistics.fmean(n)) < 0.06 and abs(statistics.pstdev(n) - 1) < 0.05 and abs(sum(abs(x) < 1 for x in n) / 4000 - 0.6827) < 0.03
    # Kolmogorov's distance to both distributions
    for values, cdf in ((u, lambda x: x), (n, lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))))):
        assert max(abs(cdf(x) - (i + 0.5) / 4000) for i, x in enumerate(sorted(values))) < 0.03
    shares = {c: sum(r.c == c for r in drawn) / 4000 for c in "abc"}
    assert abs(shares["a"] - 0.5) < 0.04 and abs(shares["b"] - 0.2) < 0.04 and abs(shares["c"] - 0.3) < 0.04
    genes = [g for *_, g in one]
    assert all(abs(genes.count(g) / 4000 - 0.2) < 0.03 for g in synthetic.CLI_GENES)
