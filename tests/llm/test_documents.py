"""Operators over documents against their plain forms: nulls, empties, long texts, ties, repeats, empty tables, clashing columns."""

import json
import math
import random
import re
import statistics
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlace.llm import bpe, lines, media, near, pii, store, substring, tokens, words

from . import brute

CLASH = "doc_id long, text string, site string, vertex string, node string, packed string, comp string, part string, digest string"


def vocabulary(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def make_rows():
    rng = random.Random(7)
    vocab = vocabulary(1)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = text(60)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "One"), (5, "one two three four five"), (6, shared)]
    base = text(120)
    for i in range(7, 20):  # near copies: some words changed
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(i, text(40) + "\n" + shared + ".\n" + text(rng.randint(0, 80))) for i in range(20, 32)]
    rows += [(32, base), (33, base), (34, "a" * 5000), (35, text(6000)), (36, "x  y 　 z\x85 end\n"), (37, "mail a.b@c.de, +49 (30) 1234567, 4111 1111 1111 1111; 10.0.0.255 300.1.1.1 DE89370400440532013000")]
    rows += [(38, "\U0001f600 ﬁ İ <|endoftext|> don't  stop"), (39, shared + " " + shared), (40, "É a b c d e f")]
    return rows + [(41 + i, text(rng.randint(1, 200))) for i in range(20)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have the names that operators use inside."""
    return spark.createDataFrame([(d, t, f"s{d % 20}", "v", "n", "p", "c", "q", "d") for d, t in rows], CLASH).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def got(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


OP1 = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_substring(docs, none, rows):
    out = substring.remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept_text", 256))
    assert got(out, OP1) == brute.substring(rows)
    assert substring.remove_repeats(none).count() == 0
    narrow = substring.remove_repeats(docs, width=3, buckets=4).withColumn("kept_sha256", F.sha2("kept_text", 256))
    assert got(narrow, OP1) == brute.substring(rows, 3)


def test_substring_in_two_steps(docs, rows, monkeypatch):
    """More buckets than a task deals out at once, in one and in several tasks a range."""
    monkeypatch.setattr(substring, "RANGE_BITS", 3)
    monkeypatch.setattr(substring, "AGAIN", 2000)
    for partitions in ("4", "40"):
        docs.sparkSession.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            out = substring.remove_repeats(docs, buckets=1 << 9).withColumn("kept_sha256", F.sha2("kept_text", 256))
            assert got(out, OP1) == brute.substring(rows)
        finally:
            docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")


def test_substring_payload_is_flat_in_buckets(spark):
    """Bytes that are shuffled, and their work, for 2**6 buckets to 2**23 of them."""
    rng = np.random.default_rng(1)
    vocab = np.array([w.encode() for w in vocabulary(6, 3000)], dtype=object)
    texts = [b" ".join(vocab[rng.integers(0, 3000, 20_000)]).decode() for _ in range(90)]
    size = sum(len(t.encode()) for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    units = spark.createDataFrame(substring._units(df).collect(), "unit long, size long, ids binary, ends binary, packed binary").coalesce(1)
    total, hashes, took = {}, set(), {}
    for bits in (6, 11, 13):
        began = time.perf_counter()
        out = substring._buckets(units, substring.WIDTH, 1 << bits).select(sum(F.length(c) for c in ("hashes", "units", "low", "more")).alias("n"), F.length("hashes").alias("h"))
        total[bits], h = out.agg(F.sum("n"), F.sum("h")).first()
        hashes.add(h)
        took[bits] = time.perf_counter() - began
    assert len(hashes) == 1 and max(total.values()) <= 1.35 * size and took[11] < 4 * took[6] + 2
    # the second step of a large corpus: what a task gathers of one range, into the 2**12 buckets that 2**23 are to it
    n, tasks = 1 << 21, 40
    h = rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(11) | np.uint64(5 << 53)
    unit = np.repeat(np.arange(tasks) << 32, n // tasks + 1)[:n]
    low = np.sort(rng.integers(0, 10**9, n // 500)).repeat(500)[:n]
    low = np.concatenate([low, np.full(n - len(low), low[-1])])
    began = time.perf_counter()
    made = list(substring._blocks([(h, unit, low, np.zeros(n, dtype=np.int64))], 64 - 23, 12))
    assert sum(b.num_rows for b in made) == 1 << 12 and {x >> 12 for b in made for x in b.column(0).to_pylist()} == {5}
    assert sum(b.get_total_buffer_size() for b in made) <= 1.5 * 8 * n and time.perf_counter() - began < 20


def test_substring_intervals(spark):
    vocab = vocabulary(3)
    a, b = " ".join(vocab[:70]), " ".join(vocab[100:160])
    df = spark.createDataFrame([(1, a), (2, f"x {a} y {b}"), (3, f"{b} {a}")], "doc_id long, text string")
    cut = {r.doc_id: (r.removed, r.kept_text) for r in substring.remove_repeats(df).collect()}
    assert cut == {1: ([], a), 2: ([1, 71], f"x y {b}"), 3: ([0, 130], "")}


def test_substring_repeated_rows(spark):
    text = " ".join(vocabulary(4)[:60])
    df = spark.createDataFrame([(5, text), (5, text), (6, text)], "doc_id long, text string")
    assert got(substring.remove_repeats(df), ["doc_id", "n_removed"]) == [(5, 0), (5, 0), (6, 60)]


def test_substring_null_and_repeated_ids_over_many_units(spark):
    """A third of the rows without an id, a third under one id, negative ids, equal rows, a long text; in any partition."""
    vocab = vocabulary(5)
    draw = random.Random(5)
    texts = [" ".join(vocab[i : i + draw.randrange(1, 90)] * draw.choice([1, 1, 2])) for i in (draw.randrange(40) for _ in range(90))]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i - 45, t) for i, t in enumerate(texts)]
    rows += [(50, " ".join(vocab[:120] * 3000)), (None, None), (51, ""), rows[2], rows[2]]
    last = 2**63 - 1
    want = sorted(brute.substring([(last if d is None else d, t) for d, t in rows]))
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = substring.remove_repeats(df).withColumn("kept_sha256", F.sha2("kept_text", 256)).withColumn("doc_id", F.coalesce("doc_id", F.lit(last)))
        assert got(out, OP1) == want


def test_substring_ids(spark):
    rows = [(1, " ".join(vocabulary(4)[:60]))]
    small = substring.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string"))
    assert small.schema["doc_id"].dataType.simpleString() == "int" and small.first().n_words == 60
    with pytest.raises(TypeError):
        substring.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string").withColumn("doc_id", F.lit("a")))


def test_substring_sees_a_window_once_a_unit():
    h, low, high = substring._once(np.array([9, 4, 9, 4, 1], dtype=np.uint64), np.array([3, 5, 2, 8, 1]))
    assert (h.tolist(), low.tolist(), high.tolist()) == ([9, 4, 1], [2, 5, 1], [3, 8, 1])


def of_kind(k):
    return lambda s: s.kind == k


def test_pii(docs, none, rows, spark):
    out = pii.find_pii(docs)
    line = F.array_join(F.transform(F.filter("spans", lambda s: s["rank"] < 4), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(k) for k in brute.BASE]
    assert sorted(tuple(r) for r in out.select("doc_id", *count, F.sha2(line, 256)).collect()) == brute.pii(rows)
    assert [s.kind for s in out.filter("doc_id = 37").first().spans] == ["email", "phone", "card", "ip", "iban"]
    assert pii.find_pii(none).count() == 0


def test_pii_patterns(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "a@@b.c", "x@y", "@", ".", "1", "12", "255", "256", "1.2.3.4", "+1", "+49", "(0)", "-", " ", "  ", "4111111111111111", "4111 1111-1111 1111", "0000000000000000", "é", "\n", "9" * 25, "..", "a.b+c@d-e.f.g"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(3000)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    line = F.array_join(F.transform(F.filter("spans", lambda s: s["rank"] < 4), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    assert sorted(tuple(r) for r in out.select("doc_id", F.sha2(line, 256)).collect()) == [(r[0], r[-1]) for r in brute.pii(rows)]


def test_pii_many_and_long(spark):
    rows = [(0, "a@b.cd " * 700), (1, "7" * 50_000), (2, "a" * 50_000 + "@"), (3, "+1" + " 2" * 20_000)]
    out = {r.doc_id: len(r.spans) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: 700, 1: 0, 2: 0, 3: 0}


def test_redact(spark):
    df = spark.createDataFrame([(1, "to a@b.cd now"), (2, None)], "doc_id long, text string")
    assert got(pii.redact(df), ["doc_id", "text"]) == [(1, "to [email] now"), (2, None)]


def test_pii_is_native(docs):
    plan = pii.find_pii(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_media(docs, none, rows):
    out = media.media_features(media.to_media(docs))
    assert got(out, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]) == brute.media(rows)
    same = {r.doc_id: (r.media_sha256, r.feature) for r in out.collect()}
    assert same[32] == same[33] and same[0] == same[1]
    assert media.media_features(media.to_media(none)).count() == 0


def test_png_filters_and_errors():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 31), dtype=np.uint8)
    import struct
    import zlib

    for kinds in ([0] * 9, [1] * 9, [2] * 9, [3] * 9, [4] * 9, [0, 1, 2, 3, 4, 4, 3, 2, 1]):
        lines_ = b""
        for r, kind in enumerate(kinds):
            lines_ += bytes([kind])
            for c in range(31):
                x = int(image[r, c])
                a = int(image[r, c - 1]) if c else 0
                b = int(image[r - 1, c]) if r else 0
                d = int(image[r - 1, c - 1]) if r and c else 0
                p = a + b - d
                best = min((abs(p - v), k) for k, v in enumerate((a, b, d)))[1]
                lines_ += bytes([(x - (0, a, b, (a + b) // 2, (a, b, d)[best])[kind]) % 256])
        png = media._SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 31, 9, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(lines_)) + media._chunk(b"IEND", b"")
        assert (media.decode_png(png) == image).all()
    with pytest.raises(ValueError):
        media.decode_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    with pytest.raises(ValueError):
        media.decode_png(png[:-3])


OP8 = ["doc_id", "n_shingles", "component_id", "kept"]


def test_near(docs, none, rows):
    assert got(near.near_duplicates(docs), OP8) == brute.near(rows)
    assert near.near_duplicates(none).count() == 0


def test_near_large_group_branches(spark):
    """Nodes beyond the size for exhaustive comparison, down to the last depth."""
    rng, vocab = random.Random(4), vocabulary(9, 500)
    base = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(150)] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    common = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [(60 + i, common + " " + " ".join(rng.choice(vocab) for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near.near_duplicates(df, small=4, depth=3), OP8) == brute.near(rows)


def test_near_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f"), (None, "a b c d e f"), (9, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect()), key=str)
    assert out == sorted([(3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (None, 2, None, True), (9, 0, 9, True)], key=str)


def test_near_sets_of_unlike_texts_stay_where_they_are(spark, monkeypatch):
    """Texts that share a passage meet in nodes but can't be links: no set of theirs is sent for comparison, only those of the linked pairs."""
    rng, vocab = random.Random(6), vocabulary(10, 500)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    common = text(60)
    rows = [(i, common + " " + text(60)) for i in range(60)]
    rows += [(60 + i, f"{text(3)} {rows[i][1]} {text(10)}") for i in range(5)]
    sent, within = [], near._within
    monkeypatch.setattr(near, "_within", lambda members: sent.extend(r.id for r in members.select("id").collect()) or within(members))
    monkeypatch.setattr(near, "AGREE", near.TOKENS + 1)  # none is linked by stars
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near.near_duplicates(df), OP8) == brute.near(rows)
    assert set(sent) == {*range(5), *range(60, 65)}


def test_parity_maps_leave_no_link_out():
    """Pairs around the threshold and around sizes at which maps grow, in one node and many labels."""
    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    own = []
    for n in (1, 2, 5, 30, 32, 33, 36, 127, 128, 129, 140, 170, 500, 512, 520, 600):
        base = fresh(n)
        for _ in range(8):
            own.append(np.unique(np.concatenate([base[rng.random(n) < rng.uniform(0.85, 1)], fresh(int(rng.integers(0, 1 + n // 5)))])))
    own = [x for x in own if len(x)] + [fresh(300) for _ in range(40)]
    n, comp = np.array([len(x) for x in own]), np.arange(len(own)) // 2
    keep = near._partnered([near._parity(x).tobytes() for x in own], n, comp)
    share = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    best = [max(share(x, y) for j, y in enumerate(own) if comp[i] != comp[j]) for i, x in enumerate(own)]
    assert any(b < 0.75 for b in best[:-40]) and sum(b >= 0.75 for b in best) > 30
    assert all(keep[i] for i, b in enumerate(best) if b >= 0.75)
    assert not any(keep[i] for i, b in enumerate(best) if b < 0.4)


def test_loss_has_one_bound_at_every_depth():
    assert all(near.loss(d) ** near.TREES < 5e-7 for d in range(1, near.DEPTH + 1))


def test_pairs_meet_as_often_as_loss_says():
    """Minwise values that agree with probability 0.75 each: shares of trees in which two sets are apart, measured."""
    rng = np.random.default_rng(12)
    m = 20_000
    x = rng.integers(0, 2**32, (m, near.TOKENS), dtype=np.uint32)
    y = np.where(rng.random(x.shape) < 0.75, x, x + np.uint32(1))
    at, here = np.zeros(m, dtype=np.uint64), np.arange(m)
    one, two = ([near._child(at, at, t[:, 0])] for t in (x, y))
    for d in range(1, 7):
        apart = ~np.any([a == b for a, b in zip(one, two, strict=True)], axis=0)
        assert abs(apart.mean() - near.loss(d)) < 0.02 and apart.mean() ** near.TREES < 5e-7
        one, two = ([near._child(h, p, t[here, p]) for h in nodes for p in near.chosen(h, d)] for nodes, t in ((one, x), (two, y)))


def test_components(spark):
    from gridlace.llm import scratch

    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    out = near.components(spark.createDataFrame(chain, "a long, b long"), scratch.Scratch(spark, "t"), "c")
    want = {(i, 0) for i in range(41)} | {(90, 90), (95, 90), (100, 90)}
    assert {tuple(r) for r in out.collect()} == want


PATH = tokens.default_path()


def test_bpe(docs, none, rows):
    out = bpe.digests(bpe.encode(docs))
    assert got(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == brute.bpe(rows, PATH)
    assert bpe.encode(none).count() == 0


def test_bpe_repeated_rows(spark):
    long = " ".join(vocabulary(2) * 20)
    rows = [(1, long), (1, long), (2, long + " end"), (2, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(bpe.digests(bpe.encode(df)), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == brute.bpe(rows, PATH)


def test_encoder_on_odd_texts():
    rng = random.Random(8)
    signs = ["a", "b", "Ab", "é", ".", ",", " ", "  ", "\n", "\t", "1", "'s", "!", "<|endoftext|>", "\xa0", "　", "\x1c", "\x85", "日", "", "", "\r\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    enc = tokens.encoder(PATH)
    for i in range(0, len(texts), 400):
        for text, ids in zip(texts[i : i + 400], enc.encode(texts[i : i + 400]), strict=True):
            own = np.frombuffer(ids, enc.dtype).tolist()
            assert own == enc.tok.encode(text, add_special_tokens=False).ids, text
            assert enc.decode(np.array(own, dtype=np.int64)).decode() == enc.tok.decode(own, skip_special_tokens=False)


def test_store(spark, docs, none, rows, tmp_path):
    at = str(tmp_path / "store")
    store.write(docs, at)
    store.verify(spark, at)
    assert got(store.checksums(store.read(spark, at)), ["doc_id", "start", "n_tokens", "ids_crc32"]) == brute.token_store(rows, PATH)
    chunks = spark.read.parquet(f"{at}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    other = str(tmp_path / "none")
    store.write(none, other)
    store.verify(spark, other)
    assert store.read(spark, other).count() == 0


def test_store_detects_changes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(5)], "doc_id long, text string")
    at = str(tmp_path / "store")
    store.write(df, at)
    bad = spark.read.parquet(f"{at}/recipes").withColumn("start", F.col("start") + 1)
    changed = str(tmp_path / "changed")
    bad.write.parquet(f"{changed}/recipes")
    for t in ("chunks", "manifest"):
        spark.read.parquet(f"{at}/{t}").write.parquet(f"{changed}/{t}")
    with pytest.raises(ValueError):
        store.verify(spark, changed)
    swapped = str(tmp_path / "swapped")
    spark.read.parquet(f"{at}/recipes").write.parquet(f"{swapped}/recipes")
    first = spark.read.parquet(f"{at}/chunks").first().data
    spark.read.parquet(f"{at}/chunks").withColumn("data", F.lit(bytes(first))).write.parquet(f"{swapped}/chunks")
    with pytest.raises(Exception, match="other bytes|missing"):
        store.read(spark, swapped).collect()


def test_store_tasks_hold_little(spark, tmp_path, monkeypatch):
    """Encoding gets batches of a few MB; reading back loads no tokenizer in its tasks."""
    sizes, encode = spark.sparkContext.accumulator(0), store.encode_chunks
    monkeypatch.setattr(tokens, "SLICE", 20_000)

    def watched(docs, path, end_id):
        def run(batches):
            for batch in batches:
                sizes.add(int(batch.num_rows > 10))
                yield batch

        return encode(docs.mapInArrow(run, docs.schema), path, end_id)

    monkeypatch.setattr(store, "encode_chunks", watched)
    text = "some words of a text " * 400  # 8,400 bytes
    df = spark.createDataFrame([(i, f"{i} {text}") for i in range(60)], "doc_id long, text string").coalesce(1)
    at = str(tmp_path / "store")
    store.write(df, at)
    assert sizes.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "20000"

    def checked(run):
        def wrapped(batches):
            tokens._encoders.clear()
            yield from run(batches)
            if tokens._encoders:
                raise AssertionError("a task that only reads ids loads the tokenizer")

        return wrapped

    monkeypatch.setattr(words, "freeing", checked)
    out = store.checksums(store.read(spark, at))
    assert out.filter("ids_crc32 is not null").count() == 60


def test_chunks_are_content_defined():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50_000, 20_000).astype("<u2")
    b = np.concatenate([rng.integers(0, 50_000, 777).astype("<u2"), a])
    cuts = [tokens.cut_many(x, np.array([0, len(x)]), 1024, 256, 8192)[0] for x in (a, b)]
    parts = [{x[i:j].tobytes() for i, j in zip([0, *c[:-1]], c, strict=True)} for x, c in zip((a, b), cuts, strict=True)]
    assert len(parts[0] & parts[1]) >= len(parts[0]) - 4
    both = tokens.cut_many(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 1024, 256, 8192)
    assert both == cuts
    assert tokens.cut_many(a[:0], np.array([0, 0]), 1024, 256, 8192) == [[]]


def site_rows():
    rng, vocab = random.Random(6), vocabulary(5)
    out = []
    for i in range(80):
        own = [" ".join(rng.choice(vocab) for _ in range(6)) for _ in range(4)]
        extra = [" everywhere \t" if i % 2 else "everywhere", ""] + (["often"] if i % 20 < 12 else ["rare"] if i % 20 < 3 else [])
        out.append((i, "\n".join(own + extra), f"s{i % 20}"))
    return out + [(80, None, "s1"), (81, "", None), (82, "everywhere", None), (83, "everywhere\n\neverywhere", "s0")]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_lines(spark, bound):
    rows = site_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, line string, key string")
    out = lines.remove_boilerplate(df, bound=bound)
    assert out.columns == [*df.columns, "n_removed_lines"]
    assert got(out.select("doc_id", "n_removed_lines", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("h")), ["doc_id", "n_removed_lines", "n", "h"]) == brute.lines(rows, 12)
    assert lines.remove_boilerplate(df.limit(0)).count() == 0


def test_lines_near_the_threshold_are_counted(spark):
    rows = [(i, f"line{n}", f"s{i}") for n in range(6, 19) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert lines.boilerplate(df).count() == 7


def test_common_counts():
    rng = np.random.default_rng(8)
    for m, k, n in ((2, 50, 20), (9, 60, 30), (90, 400, 60), (200, 3000, 40)):
        own = [np.unique(np.concatenate([rng.integers(0, k, n), np.arange(5 * (i % 2))])).astype(np.uint64) for i in range(m)]
        common = near._in_common(own)
        assert all(common[i, j] == len(set(own[i].tolist()) & set(own[j].tolist())) for j in range(m) for i in range(j))


def crossing_file(at):
    """A byte-level BPE file without a pre-tokenizing pattern: tokens run across spaces, and no place is a cut."""
    import json

    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    letters = [chr(c) for c in range(97, 123)] + ["Ġ"]
    vocab = {c: i for i, c in enumerate(letters)}
    merges = [("e", "Ġ"), ("Ġ", "t"), ("eĠ", "t"), ("a", "n"), ("an", "d"), ("d", "Ġ"), ("and", "Ġ"), ("t", "h"), ("eĠt", "h"), ("o", "n"), ("on", "eĠ"), ("Ġ", "a")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    tok = Tokenizer(models.BPE(vocab, merges))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.decoder = decoders.ByteLevel()
    path = str(at / "crossing.json")
    tok.save(path)
    assert json.load(open(path))["pre_tokenizer"]["use_regex"] is False
    return path


def test_bpe_where_no_place_is_a_cut(spark, tmp_path):
    path = crossing_file(tmp_path)
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "and", "one", "tone", "at", "thee", "ad", "on"])
    shared = " ".join(word() for _ in range(3000))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 400))) + shared + " ".join(word() for _ in range(rng.randint(1, 400)))) for i in range(12)] + [(20, None), (21, "e t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert not tokens.encoder(path).level
    assert got(bpe.digests(bpe.encode(df, path=path), path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == brute.bpe(rows, path)


def test_long_pieces_leave_the_cache_alone():
    """Pieces that are too long to hold, with and without a space before them, beside short ones that are held."""
    enc = tokens.Encoder(PATH)
    rng = random.Random(8)
    texts = [" ".join(["字" * rng.choice([1, 2, 90, 200]) + rng.choice("漢語的") * rng.randint(1, 3), "short" + rng.choice("abc"), "x" * rng.choice([1, 300])]) for _ in range(60)]
    want = [e.ids for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(3):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
        rng.shuffle(both := list(zip(texts, want, strict=True)))
        texts, want = map(list, zip(*both, strict=True))


def plain_file(at):
    """The given file without its pattern: no place is a cut, and ids end within characters."""
    with open(PATH, encoding="utf-8") as f:
        own = json.load(f)
    own["pre_tokenizer"]["use_regex"] = False
    path = at / "plain.json"
    path.write_text(json.dumps(own), encoding="utf-8")
    return str(path)


SCRIPTS = {
    "accents": "élève garçon über straße año señor façade naïve čeština žluťoučký",
    "cjk": "統計 資料 日本語 中文 한국어 데이터 漢字 的是不了人我在有他这为之大来以个",
    "emoji": "😀 👍🏽 family 👨‍👩‍👧‍👦 🎉🎉 flags 🇩🇪🇫🇷 text",
    "mixed": "plain words, naïve 中文 😀 and more",
}


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("plain", [False, True])
def test_bpe_reuses_chunks_of_any_script(spark, tmp_path, script, plain):
    path = plain_file(tmp_path) if plain else PATH
    enc = tokens.encoder(path)
    assert enc.level is not plain
    rng = random.Random(3)
    parts = SCRIPTS[script].split(" ")
    text = lambda n: rng.choice(["", " "]).join(rng.choice(parts) for _ in range(n))
    body = [text(3).join([" ", "\n"]) + text(rng.randint(1, 9)) for _ in range(700)]
    shared = "".join(body)
    chunks = bpe._chunks(np.frombuffer(shared.encode(), dtype=np.uint8))
    assert len(chunks) > 2 and len(bpe.reusable(enc, chunks)) == len(chunks)  # each is reused
    known = [bpe.Known(enc, c, np.frombuffer(i, enc.dtype)) for c, i in zip(chunks, bpe.reusable(enc, chunks).values(), strict=True)]
    want = enc.tok.encode("é" + shared + "中", add_special_tokens=False).ids
    assert bpe.join(enc, [["é".encode(), *known, "中".encode()]])[0].tolist() == want
    rows = [(i, text(rng.randint(0, 200)) + shared + text(rng.randint(0, 200))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(bpe.digests(bpe.encode(df, path=path), path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == brute.bpe(rows, path)


def test_join_widens_until_both_sides_agree(tmp_path):
    """Chunks whose ids at the edges are wrong on purpose."""
    enc = tokens.encoder(PATH)
    rng, vocab = random.Random(5), vocabulary(2)
    text = " ".join(rng.choice(vocab) for _ in range(400)).encode()
    ids = np.frombuffer(enc.encode([text.decode()])[0], enc.dtype).copy()
    whole = b"x" + text + b"y"
    want = enc.tok.encode(whole.decode(), add_special_tokens=False).ids
    for wrong in (0, 10, 30, 200):
        own = ids.copy()
        own[:wrong], own[len(own) - wrong :] = own[:wrong][::-1], own[len(own) - wrong :][::-1]
        assert bpe.join(enc, [[b"x", bpe.Known(enc, text, own), b"y"]])[0].tolist() == want
    assert bpe.join(enc, [[], [b""], [b"ab", b"c d"]])[2].tolist() == enc.tok.encode("abc d", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_with_other_files(spark, docs, rows, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    assert got(bpe.digests(bpe.encode(docs, path=path), path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == brute.bpe(rows, path)


def plain_feature(payload):
    """The cosine hash with loops, from samples in rows of 576."""
    rows = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    h, w = len(rows), 576
    edge = lambda n: [(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)]
    down = [[sum(rows[r][c] for r in range(a, b)) / (b - a) for c in range(w)] for a, b in edge(h)]
    small = np.array([[sum(row[a:b]) / (b - a) for a, b in edge(w)] for row in down])
    wave = np.array([[np.cos(np.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)])
    low = np.round((wave @ small @ wave.T).ravel(), 6)
    return "".join(f"{int(''.join('1' if v > np.median(low[1:]) else '0' for v in low[i : i + 8]), 2):02x}" for i in range(0, 64, 8))


def test_media_rows_are_filtered(spark):
    texts = [" ".join(vocabulary(k)) * 3 for k in range(4)] + ["a" * 576 + "b" * 576 + "ab" * 2000, "", "é" * 700]
    kinds = set()
    for t in texts:
        payload = media.pad(t.encode())
        png = media.encode_png(payload)
        raw = zlib.decompress(png[33 + 8 : 33 + 8 + int.from_bytes(png[33:37], "big")])
        kinds |= {raw[i] for i in range(0, len(raw), 577)}
        assert media.decode_png(png).tobytes() == payload
    assert kinds >= {1, 2}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(media.to_media(df)).collect():
        payload = media.pad(texts[r.doc_id].encode())
        png = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(png), brute.sha(png), plain_feature(payload))


def test_linked_pairs_of_a_node():
    """Against full sets: no link across labels is left out, and what is passed on in vain is at the threshold."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    own = [np.unique(np.concatenate([base[rng.random(120) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)])) for _ in range(90)]
    own += [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(10)]
    comp = np.arange(100) // 3
    got = near._linked([np.unique((x >> np.uint64(32)).astype(np.uint32)) for x in own], np.array([len(x) for x in own]), comp)
    sets = [set(x.tolist()) for x in own]
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])

    def parts(pairs):
        root = {c: c for c in comp.tolist()}
        for i, j in pairs:
            a, b = root[int(comp[i])], root[int(comp[j])]
            root = {k: a if v == b else v for k, v in root.items()}
        return len(set(root.values()))

    true = [(i, j) for i in range(100) for j in range(i + 1, 100) if share(i, j) >= 0.75]
    assert all(share(i, j) > 0.73 for i, j in got)
    assert parts([p for p in got if share(*p) >= 0.75]) == parts(true)
    assert len(got) < len(true) / 4


def plain_png(png):
    """Height and samples by the letter of the format: chunks, then the filters none, left and up, sample by sample."""
    at, body = 8, b""
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        assert zlib.crc32(png[at + 4 : at + 8 + size]) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
        body += png[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    raw, lines, above = zlib.decompress(body), [], [0] * media.UNIT
    for i in range(0, len(raw), media.UNIT + 1):
        line = []
        for x, up in zip(raw[i + 1 : i + 1 + media.UNIT], above, strict=True):
            line.append((x + {0: 0, 1: line[-1] if line else 0, 2: up}[raw[i]]) % 256)
        lines.append(line)
        above = line
    return lines


def feature_by_definition(lines):
    """32 x 32 means, cosine sums by their definition, signs against the median of all but the mean."""

    def means(x):
        edges = [i * len(x) // 32 for i in range(33)]
        return [[sum(col) / len(col) for col in zip(*x[a : max(b, a + 1)], strict=True)] for a, b in zip(edges, edges[1:], strict=False)]

    small = list(zip(*means([list(c) for c in zip(*means(lines), strict=True)]), strict=True))
    wave = [[math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    half = [[sum(w * v for w, v in zip(ws, col, strict=True)) for col in zip(*small, strict=True)] for ws in wave]
    low = [round(sum(w * v for w, v in zip(ws, row, strict=True)), 6) for row in half for ws in wave]
    middle = statistics.median(low[1:])
    return f"{int(''.join('01'[v > middle] for v in low), 2):016x}"


def test_media_against_a_plain_reader(spark, docs, rows):
    stored = media.to_media(docs)
    forms = {r.doc_id: r.media for r in stored.collect()}
    texts = dict(rows)
    for r in media.media_features(stored).collect():
        lines = plain_png(forms[r.doc_id])
        raw = (texts[r.doc_id] or "").encode()
        assert bytes(x for line in lines for x in line) == media.pad(raw)
        assert (r.media_bytes, r.media_sha256) == (len(forms[r.doc_id]), brute.sha(forms[r.doc_id]))
        assert r.feature == feature_by_definition(lines)


def test_iban_and_context_against_plain_forms(spark):
    rng = random.Random(6)
    good = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(1, 12)):
            iban = rng.choice(good)
            if rng.random() < 0.5:
                k = rng.randrange(4, len(iban))
                iban = iban[:k] + rng.choice("0123456789") + iban[k + 1 :]
            words += [rng.choice([iban, iban.lower(), f"({iban})", f"x{iban}", "bank", "IBAN:", "accounts", "filler " * rng.randint(1, 9), "née"])]
        rows.append((i, " ".join(words)))

    def plain(text):
        out = []
        hits = list(re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", text))
        for n, m in enumerate(hits):
            if int("".join(str(int(c, 36)) for c in m[0][4:] + m[0][:4])) % 97 == 1:
                before = text[hits[n - 1].end() if n else 0 : m.start()][-48:]
                after = text[m.end() : hits[n + 1].start() if n + 1 < len(hits) else len(text)][:48]
                near_word = re.search(r"\b(?:iban|account|bank|transfer|bic|swift)\b", f"{before} {after}", re.IGNORECASE | re.ASCII)
                out.append((m.start(), m.end(), 1.0 if near_word else 0.9))
        return out

    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got_spans = {r.doc_id: [(s["start"], s["end"], s["score"]) for s in r.spans if s["kind"] == "iban"] for r in found}
    assert got_spans == {i: plain(t) for i, t in rows}
