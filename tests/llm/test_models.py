"""Language ID, benchmark search, quotation linking and the pipeline."""

import os
import pickle
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gridlace.llm import chat, decontaminate, langid, registry, scratch

WORDS = {"aa": "bla blo bli ble blu blabla blobli", "bb": "gor gur gir gorgur girgor gurgi", "cc": "éta ôta ûta étaôta ûtaé çata"}


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    langs = sorted(WORDS)
    rows = []
    for i in range(n):
        lang = langs[i % 3]
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang if i % 7 else None))
    return rows


SCHEMA = "doc_id long, text string, lang string"


def test_langid(spark):
    rows = labelled() + [(1000, None, "aa"), (1001, "", None), (1002, "123 !!", "bb"), (1003, "É" * 3000, None), (1004, "bla blo " * 20_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in langid.predict(df, langid.train(df)).collect()}
    truth = {i: sorted(WORDS)[i % 3] for i in range(400)}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) >= 0.98
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (1000, 1001, 1002))
    assert out[1004].lang_pred == "aa" and not out[1004].rejected
    assert all(0 <= r.score <= 1 for r in out.values())


def test_langid_learns_from_no_held_out_row(spark):
    rows = labelled()
    wrong = [(i, t, "bb" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    a, b = (langid.train(spark.createDataFrame(r, SCHEMA)) for r in (rows, wrong))
    assert a.labels == b.labels and (a.table == b.table).all()


def test_langid_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "bla", None)], SCHEMA)
    assert langid.train(df) is None
    assert langid.predict(df, None).first().lang_pred == "und"
    assert langid.predict(df.limit(0), None).count() == 0


def bench_texts(seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    return rng, vocab, text


def test_decontaminate(spark):
    rng, vocab, text = bench_texts()
    items = [(i, f"{text(20).capitalize()}. {text(14).capitalize()}.") for i in range(20)]
    docs, want = [], set()
    for i in range(120):
        t = text(rng.randint(10, 300))
        if i < 20:
            t = f"{t}, {items[i][1].upper()} {text(30)}"
            want.add((i, i))
        elif i < 30:  # a paraphrase: some words of the first sentence changed
            w = items[i - 20][1].split()
            for k in rng.sample(range(18), 7):
                w[k] = rng.choice(vocab)
            t = f"{t} {' '.join(w)} {text(50)}"
            want.add((i, i - 20))
        elif i < 40:  # half an item is not the item
            t = f"{t} {' '.join(items[i - 30][1].split()[:12])} {text(50)}"
        docs.append((i, t, "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, text(4000) + " " + items[3][1], "x")]
    want.add((502, 3))
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    for many in (20_000, 7):
        out = decontaminate.contaminated(df, bench, items=many).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want
    assert all(r.paraphrase == (20 <= r.doc_id < 30 and r.share < decontaminate.SURE) for r in out)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def planted_items(rng, text, vocab, sizes):
    """Items, and documents that hold one each: exact copies, then copies with words of the first sentence changed."""
    items = [(i, f"{text(n - 5).capitalize()}. {text(5).capitalize()}.") for i, n in enumerate(sizes)]
    docs = []
    for i in range(200):
        k = rng.randrange(len(items))
        w = items[k][1].split()
        if i >= 100:
            for x in rng.sample(range(len(w) - 5), int(0.35 * len(w))):
                w[x] = rng.choice(vocab)
        docs.append((i, f"{text(rng.randint(40, 150))} {' '.join(w)} {text(rng.randint(40, 150))}", k))
    return items, docs


def plain_matches(items, docs):
    """All pairs that the subsequence and the answer accept, without any search for candidates."""
    parsed = [decontaminate.parse_item(*x) for x in items]
    out = set()
    for d, t, _ in docs:
        h = decontaminate._of(t).tolist()
        for x in parsed:
            n = len(x.words)
            for at in range(0, len(h), decontaminate.HOP):
                region = h[max(0, at - n) : at + 2 * decontaminate.HOP + n]
                same = decontaminate.common(x.whole, n, region) / n
                answer = decontaminate.common(x.last, n - x.answer, region) / (n - x.answer)
                if same >= decontaminate.SURE or same >= decontaminate.LIKELY and answer >= decontaminate.ANSWER:
                    out.add((d, x.item))
                    break
    return out


def found_matches(spark, items, docs):
    df = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string").repartition(4)
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_decontaminate_many_items(spark):
    """As many items as give far more passages than the basis has directions."""
    rng, vocab, text = bench_texts(5)
    items, docs = planted_items(rng, text, vocab, [rng.randint(20, 60) for _ in range(1000)])
    found = found_matches(spark, items, docs)
    assert found >= {(d, k) for d, _, k in docs}
    assert found == plain_matches(items, docs)


def test_decontaminate_short_items(spark):
    """Items of less words than half a window, in documents whose other words are the benchmark's too."""
    rng, vocab, text = bench_texts(6)
    items, docs = planted_items(rng, text, vocab, [8 + k % 12 for k in range(120)])
    found = found_matches(spark, items, docs)
    assert found >= {(d, k) for d, _, k in docs if d < 100}
    assert found == plain_matches(items, docs)


def test_common_subsequence():
    rng = random.Random(1)

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert decontaminate.common(decontaminate.Places(np.array(a)), len(a), b) == plain(a, b)


def test_latent_basis_is_that_of_the_matrix(spark):
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 40, 30).astype(np.int32) for _ in range(25)]
    weight = rng.uniform(0.5, 3, 40)
    df = spark.createDataFrame([(r.tobytes(),) for r in rows], "terms binary").repartition(3)
    basis = decontaminate.latent_basis(df, weight, rank=10)
    a = np.array([np.bincount(r, minlength=40) * weight for r in rows])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    values = np.linalg.svd(a)[1]
    assert np.linalg.norm(a @ basis, axis=0) == pytest.approx(values[:10], rel=0.02)


def test_parse_quotes():
    text = "Yes, agreed.\n\nOn Mon, Ann wrote:\n> First line\n> goes on.\n>> Old one.\n> \nAnd more."
    assert chat.parse(text) == ("Yes, agreed.\n\nAnd more.", [(1, "First line\ngoes on."), (2, "Old one.")])
    assert chat.parse(None) == ("", [])
    assert chat.parse("> > deep") == ("", [(2, "deep")])


CONV = "conv_id long, turn long, role string, text string, thread string"


def test_chat(spark):
    rows = [
        (1, 0, "a", "Where do we meet? I am at home.", "x"),
        (1, 1, "b", "Something else. Thanks.", "x"),
        (1, 2, "c", "> where do we\n> meet?\nAt the station.", "x"),
        (1, 3, "d", "> Something else.\nWhat else?", "x"),
        (1, 4, "a", "On Tuesday c wrote:\n>> Where do we meet?\n> At the station.\nFine.", "x"),
        (1, 5, "e", "> nobody said this\nHm.", "x"),
        (2, 0, "a", "Where do we meet?", "x"),
        (2, 1, None, None, "x"),
        (None, 0, "a", "> Where do we meet?\nNull.", "x"),
        (3, None, "a", "No turn.", "x"),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, CONV).repartition(3)).collect()
    one = sorted((r.position, r.turn, r.reply_to, r.thread, r.text) for r in out if r.conv_id == 1)
    assert one == [
        (0, 0, None, 0, "Where do we meet? I am at home."),
        (1, 2, 0, 0, "At the station."),
        (2, 4, 2, 0, "Fine."),
        (3, 1, None, 1, "Something else. Thanks."),
        (4, 3, 1, 1, "What else?"),
        (5, 5, None, 5, "Hm."),
    ]
    rest = {(r.conv_id, r.turn): (r.position, r.text, r.reply_to) for r in out if r.conv_id != 1}
    assert rest == {(2, 0): (0, "Where do we meet?", None), (2, 1): (1, "", None), (None, 0): (0, "Null.", None), (3, None): (0, "No turn.", None)}
    assert chat.format_chats(spark.createDataFrame([], CONV)).count() == 0


def test_chat_repeated_sentences(spark):
    """A later message that wrote the same sentences again is the original, whatever their number of writers."""
    rows = [
        (1, 1, "a", "Thanks.", "x"),
        (1, 3, "b", "Thanks.", "x"),
        (1, 4, "c", "> Thanks.\nWelcome.", "x"),
        (2, 0, "a", "Long first sentence here.", "x"),
        (2, 1, "b", "Long first sentence here. New.", "x"),
        (2, 2, "c", "> Long first sentence here. New.\nYes.", "x"),
    ]
    out = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.position) for r in chat.format_chats(spark.createDataFrame(rows, CONV)).collect()}
    assert out[1, 4] == (3, 3, 2) and out[2, 2] == (1, 1, 2)

    rng = random.Random(3)
    phrases = ["Thanks.", "Fine with me.", "Let us meet tomorrow.", "No.", "See the notes of last week."]
    rows, said, want = [], {}, {}
    for turn in range(120):
        own = rng.sample(phrases, rng.randint(1, 3)) + ([f"Only number {turn}."] if rng.random() < 0.3 else [])
        text = " ".join(own)
        if turn and rng.random() < 0.6:
            quote = rng.sample(phrases, rng.randint(1, 3)) + [s for s in said[rng.randrange(turn)] if s.startswith("Only")]
            score = {t: sum(len(" ".join(chat._WORDS.findall(s))) for s in quote if s in said[t]) for t in range(turn)}
            most = max(score.values())
            if most:
                want[turn] = max(t for t in score if score[t] == most)
            text = "> " + " ".join(quote) + "\n" + text
        said[turn] = own
        rows.append((7, turn, "a", text, "x"))
    parsed = chat._parsed(spark.createDataFrame(rows, CONV))
    for many in (0, 3, chat.MANY, 10**6):
        assert {r.turn: r.reply_to for r in chat.link_quotes(parsed, many).collect()} == want


def test_chat_one_long_conversation(spark):
    rows = [(1, i, "a", f"message number {i} says so." + (f"\n> message number {i - 1} says so." if i % 10 else ""), "x") for i in range(300)]
    rows += [(1, 299, "a", rows[-1][3], "x")]
    out = chat.format_chats(spark.createDataFrame(rows, CONV)).collect()
    assert sorted(r.position for r in out) == list(range(301))
    assert all(r.reply_to == (r.turn - 1 if r.turn % 10 else None) and r.thread == r.turn // 10 * 10 for r in out)


def pipeline_rows():
    rng, _, text = bench_texts(9)
    rows = [(i, text(40) + "\nshared line\n" + text(20), "en", f"s{i % 15}", 0) for i in range(60)]
    rows += [(60, rows[3][1], "en", "s1", 0), (61, "123 456", "en", "s2", 0), (62, None, "en", "s3", 0)]
    bench = text(30)
    return rows + [(63, f"{text(20)} {bench} {text(20)}", "en", "s4", 0)], bench


def test_long_benchmark_items(spark, monkeypatch):
    """Items of 20,000 words, most of them distinct, in blocks apart from short ones; tables stay small whatever the length."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = text(20_000), text(30)
    broken = long.split()
    for i in rng.sample(range(20_000), 3_000):
        broken[i] = word()
    items = [(1, long), (2, short)]
    docs = [(1, f"{text(40)} {long} {text(40)}"), (2, " ".join(broken)), (3, f"{text(50)} {short} {text(50)}"), (4, text(300)), (5, " ".join(long.split()[:9_000]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_common == 20_000 or r.item_id == 2) for r in out} == {(1, 1, True), (2, 1, False), (3, 2, True)}
    assert next(r.n_common for r in out if r.doc_id == 2) >= 17_000
    whole = decontaminate.parse_item(1, long)
    assert whole.whole.masks is None and len(pickle.dumps(whole)) < 100 * len(whole.words)
    # masks that are made on demand are those of a table
    own = np.array([rng.randint(0, 40) for _ in range(500)])
    table = decontaminate.Places(own)
    monkeypatch.setattr(decontaminate, "LONG", 100)
    lazy = decontaminate.Places(own)
    assert lazy.masks is None and all(lazy.get(w) == table.get(w) for w in range(45))


def test_pipeline(spark, tmp_path):
    rows, bench = pipeline_rows()
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names, kept = docs.columns, []
    store = scratch.Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        docs = store.table(stage(spark, docs, at), name)
        kept.append({r.doc_id for r in docs.collect()})
        if name != "tokens":
            assert docs.columns == names
        if name == "lines":
            assert not any("shared line" in (r.text or "") for r in docs.collect())
    assert kept[0] == kept[1] == set(range(64)) - {61, 62}
    assert kept[2] == kept[1] - {60} and kept[3] == kept[4] == kept[2] - {63}
    here = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(here))
    assert corpus_pipeline.run(spark, at).count() == 60
    left = set(os.listdir(here)) - before
    assert [name.split("-")[0] for name in left] == ["pipeline"]  # the tables of its stages alone


def test_registry():
    assert sorted(int(k.split("_")[0][2:]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)


STAGE_ROWS = "doc_id long, text string, lang string, source string, n_chars long, __gone long, n_removed_lines long, `a.b` string, key string, n string, gone string, c0 string, rejected string, vertex long"


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, tmp_path, stage):
    """Null ids, repeated rows and ids, null, empty and long texts, names that clash with any used inside, an empty table."""
    rng, _, text = bench_texts(4)
    bench, near = text(40), text(60)
    own = lambda d, t, lang="en": (d, t, lang, "s1", 1, 2, 3, "x", "k", "n", "g", "c", "r", 5)
    rows = [own(i, text(30)) for i in range(40)]
    rows += [own(None, text(25)), own(None, f"{text(9)} {bench} {text(9)}"), own(50, near), own(50, near), own(51, near), own(50, text(33)), own(52, None), own(53, ""), own(54, "12 34"), own(55, f"{bench} {text(12)}"), own(55, text(31)), own(56, text(30_000), None)]
    at = str(tmp_path)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    df = spark.createDataFrame(rows, STAGE_ROWS).repartition(3)
    for docs in (df, df.limit(0)):
        out = stage(spark, docs, at)
        got = [tuple(r) for r in out.collect()]
        name = stage.__name__
        if name == "encode_texts":
            assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and len(got) == docs.count()
            continue
        assert out.columns == docs.columns
        gone = {"keep_known": lambda r: r[1] in (None, "", "12 34"), "without_boilerplate": lambda r: False, "one_of_each": lambda r: r[0] == 51, "without_benchmark": lambda r: bench in (r[1] or "")}[name]
        assert sorted(map(str, got)) == sorted(str(r) for r in map(tuple, docs.collect()) if not gone(r))


def plain_score(model, text):
    """(label, score, rejected) with loops: mean of the rows of all pairs and runs of four, softmax with the outcome of none."""
    raw = text.encode()
    if not any(c.isalpha() for c in text):
        return "und", 0.0, True
    low = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw] + [32] * 3
    total = np.zeros(len(model.labels))
    for i in range(len(raw)):
        pair = low[i] << 8 | low[i + 1]
        four = (pair << 16 | low[i + 2] << 8 | low[i + 3]) * 2654435761 % 2**32
        total += model.table[pair].astype(float) + model.table[(four >> (32 - langid.BITS)) + 65536]
    z = np.append(total / (2 * len(raw)) + model.bias, model.none) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    k = int(p[:-1].argmax())
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
    return model.labels[k], float(p[k]), bool(p[k] < model.threshold or letters < langid.LETTERS)


def test_langid_rejects_what_it_has_not_learnt(spark):
    """Other scripts, noise, single letters and a language left out are rejected; held-out texts are kept. Scores equal a plain predictor's."""
    rows = labelled(900)
    two = [(i, t, lang if lang != "cc" else None) for i, t, lang in rows]
    model = langid.train(spark.createDataFrame(two, SCHEMA))
    assert model.labels == ["aa", "bb"] and model.false_accept <= 2 * langid.FALSE_ACCEPT and model.false_reject <= 0.05
    rng = random.Random(1)
    odd = ["これは日本語の文章です", "Это русский текст о погоде", "x", "b", "Q!", *("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(40)) for _ in range(10))]
    docs = [(5000 + i, t) for i, t in enumerate(odd)] + [(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    out = {r.doc_id: r for r in langid.predict(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for d, t in docs:
        label, score, rejected = plain_score(model, t)
        assert (out[d].lang_pred, out[d].rejected) == (label, rejected) and out[d].score == pytest.approx(score, rel=1e-4)
    assert all(out[5000 + i].rejected for i in range(len(odd)))
    assert np.mean([out[d].rejected for d, _ in docs if d < 5000 and rows[d][2] != "cc" and d % 3 != 2]) <= 0.05
    assert np.mean([out[d].rejected for d, _ in docs if d < 5000 and d % 3 == 2]) >= 0.95


def test_decontaminate_latent_search_and_recall(spark):
    """Verbatim items of 5 to 60 words among the benchmark's own words, and paraphrases: recall, and what the latent search finds alone."""
    rng, vocab, text = bench_texts(8)
    items, docs = planted_items(rng, text, vocab, [8 + k % 53 for k in range(150)])
    items += [(150 + k, text(5 + k % 3)) for k in range(20)]
    docs = [(d, f"{text(100)} {items[k][1] if d < 100 else t} {text(100)}", k) for d, t, k in docs]
    docs += [(300 + k, f"{text(100)} {items[150 + k][1]} {text(100)}", 150 + k) for k in range(20)]
    df = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string").repartition(4)
    out = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in out}
    assert found == plain_matches(items, docs)
    assert all((d, k) in found for d, _, k in docs if d < 100 or d >= 300)
    assert np.mean([(d, k) in found for d, _, k in docs if 100 <= d < 200 and len(items[k][1].split()) >= 20]) >= 0.9
    latent = {(r.doc_id, r.item_id) for r in out if r.latent}
    long = [(d, k) in latent for d, _, k in docs if d < 100 and len(items[k][1].split()) >= 30]
    assert np.mean(long) >= 0.9 and latent < found


def test_langid_against_plain_averages(spark):
    """Labels and scores of the trained model, one byte after the other."""
    rows = [(i, t[:400], lang) for i, t, lang in labelled(90)] + [(500, "Bla, BLO; 12 gor ¿taé?", None), (501, "a", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df)

    def plain(text):
        raw = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
        x, total = raw + [32] * 3, np.zeros(len(model.labels))
        for i in range(len(raw)):
            four = int.from_bytes(bytes(x[i : i + 4]), "big") * 2654435761 % 2**32
            total += model.table[x[i] * 256 + x[i + 1]] + model.table[65536 + (four >> (32 - langid.BITS))].astype(float)
        z = np.append(total / (2 * len(raw)) + model.bias, model.none) / model.temperature
        p = np.exp(z - z.max())
        p = (p / p.sum())[:-1]
        return model.labels[int(p.argmax())], p.max()

    for r in langid.predict(df, model, keep=("text",)).collect():
        label, score = plain(r.text)
        assert r.lang_pred == label and r.score == pytest.approx(score, rel=1e-3)
        assert r.rejected == (r.score < model.threshold or r.doc_id == 501)


def test_chat_threads_and_places_against_a_plain_walk(spark):
    """Random reply trees in several conversations, each message quoting one earlier message."""
    rng = random.Random(11)
    rows, want = [], {}
    for conv in range(4):
        thread = {}
        for turn in range(60):
            up = rng.randrange(turn) if turn and rng.random() < 0.8 else None
            thread[turn] = turn if up is None else thread[up]
            quote = "" if up is None else f"> word {conv} of\n> turn {up} here.\n"
            rows.append((conv, turn, "a", f"{quote}word {conv} of turn {turn} here.", "x"))
            want[conv, turn] = [up, thread[turn]]
        for place, turn in enumerate(sorted(thread, key=lambda t: (thread[t], t))):
            want[conv, turn].append(place)
    rng.shuffle(rows)
    out = chat.format_chats(spark.createDataFrame(rows, CONV).repartition(3)).collect()
    assert {(r.conv_id, r.turn): [r.reply_to, r.thread, r.position] for r in out} == want
