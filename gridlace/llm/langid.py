"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Features are byte pairs and hashed runs of four bytes, ASCII in lower case and all other
ASCII signs as spaces, averaged over the whole text. Training takes whole texts of a bounded
sample of labelled rows, at most PER_LANGUAGE of each label in expectation, chosen by a hash of the
id. One part in five of them calibrates: their whole texts and short parts of them, and made-up texts of no learnt language
(random letters, consonants, other scripts), fit a temperature and the level of a further outcome, none of the labels, by
the likelihood of smoothed targets. The score is the probability of the best label beside that outcome; the threshold is the one that lets
FALSE_ACCEPT of the made-up texts through. Texts of less than LETTERS bytes of letters are too short to tell and rejected. As both layers are linear, a prediction averages rows of their product: one small table per task.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; ties
go to the label that sorts first; repeated rows give repeated results; an empty table gives an
empty one; without any labelled row all others are ``und`` too. Only id, text and (for training) label are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

#: Expected number of sampled rows for each label, and of buckets and dimensions.
PER_LANGUAGE, BITS, DIM, EPOCHS = 800, 16, 16, 6
#: Share of texts in no learnt language that may be accepted, and how many of each kind are made up.
FALSE_ACCEPT, MADE = 0.01, 60
#: Bytes of letters that a text needs to be told by.
LETTERS = 4
_MAP = np.full(256, 32, dtype=np.uint8)
_MAP[65:91] = np.arange(97, 123)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MULT = np.uint32(2654435761)


def _features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the pair and of the run of four that start at each byte (the last three are padded)."""
    x = np.full(len(data) + 3, 32, dtype=np.uint32)
    x[: len(data)] = _MAP[data]
    pair = x[:-3] << np.uint32(8) | x[1:-2]
    four = (pair << np.uint32(16) | x[2:-1] << np.uint32(8) | x[3:]) * _MULT
    return pair, (four >> np.uint32(32 - BITS)) + np.uint32(65536)


def _has_letter(raw: np.ndarray) -> bool:
    if _LETTER[raw].any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def _some_words(raw: np.ndarray) -> np.ndarray:
    """Three to fourteen words from the middle of a text, to calibrate on short ones; how many follows from its length."""
    starts, ends, _ = words.split(raw, np.array([0, len(raw)]))
    if not len(starts):
        return raw[:0]
    n = 3 + len(raw) % 12
    i = max(0, len(starts) - n) // 2
    return raw[starts[i] : ends[min(i + n, len(starts)) - 1]]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # by bucket, the embedding already multiplied by the output layer
    bias: np.ndarray
    temperature: float = 1.0
    none: float = -np.inf  # level of the outcome that it is no label
    threshold: float = 0.0
    false_accept: float = 0.0  # as measured where it was fitted
    false_reject: float = 0.0

    def scores(self, logits: np.ndarray) -> np.ndarray:
        """Probabilities of the labels; what they lack to 1 is that of none."""
        z = np.column_stack([logits, np.full(len(logits), self.none)]) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return (p / p.sum(axis=1, keepdims=True))[:, :-1]

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """By document; documents must not be empty."""
        total = np.zeros((len(bounds) - 1, len(self.labels)), dtype=np.float64)
        for i in range(len(bounds) - 1):
            for a in range(int(bounds[i]), int(bounds[i + 1]), 1 << 18):
                own = data[a : min(a + (1 << 18) + 3, bounds[i + 1])]
                keep = min(1 << 18, int(bounds[i + 1]) - a)
                for f in _features(own):
                    total[i] += self.table.take(f[:keep], axis=0).sum(axis=0, dtype=np.float64)
        return total / (2 * np.diff(bounds))[:, None] + self.bias


def learnable(docs: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Rows whose label may be learnt from: labelled ones that the id's crc32 doesn't hold out."""
    return docs.filter(F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 5) -> Model | None:
    """A model of the labelled rows of docs. The driver gets feature counts of the sample alone."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = learnable(rows, "id", "label")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, per_language / counts[k])])
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30)

    def count(batches):
        for batch in batches:
            bounds, data = words.utf8(batch.column(1))
            at, used, weights, parts = [], [], [], []
            for i in range(len(bounds) - 1):
                whole = data[bounds[i] : bounds[i + 1]]
                for part in (False, True):
                    own = _some_words(whole) if part else whole
                    if len(own) and _has_letter(own):
                        f, n = np.unique(np.concatenate(_features(own)), return_counts=True)
                        at.append(i)
                        used.append(f.astype("<u4").tobytes())
                        weights.append((n / n.sum()).astype("<f4").tobytes())
                        parts.append(part)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(used, pa.binary()), pa.array(weights, pa.binary()), pa.array(parts, pa.bool_())], ["id", "label", "used", "weights", "part"])

    kind = rows.schema["id"].dataType.simpleString()
    sample = rows.filter(drawn).mapInArrow(words.freeing(count), f"id {kind}, label string, used binary, weights binary, part boolean").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "part", "used").collect()
    known = {k: i for i, k in enumerate(labels)}
    items, parts = ([(np.frombuffer(r["used"], "<u4"), np.frombuffer(r["weights"], "<f4"), known[r["label"]]) for r in sample if r["part"] is part] for part in (False, True))
    if not items:
        return None
    few = len(items) < 10
    held = [x for i, x in enumerate(items) if few or i % 5 == 0] + [x for i, x in enumerate(parts) if few or i % 5 == 0]
    return _fit(labels, [x for i, x in enumerate(items) if few or i % 5], held, seed)


def _fit(labels: list[str], learn: list, hold: list, seed: int) -> Model:
    rng, size = np.random.default_rng(seed), 65536 + (1 << BITS)
    e = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(labels)), dtype=np.float32), np.zeros(len(labels), dtype=np.float32)
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(learn)):
            used, weight, label = learn[k]
            rate = np.float32(1.0 * (1 - step / steps) + 0.01)
            hidden = weight @ e[used]
            z = hidden @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = w @ p
            w -= rate * np.outer(hidden, p)
            bias -= np.float32(0.1) * rate * p
            # the mean's gradient is spread over few rows, so its step is longer
            e[used] -= (rate * 10) * weight[:, None] * back[None, :]
            step += 1
    model = Model(labels, e @ w, bias)
    _calibrate(model, np.array([u @ model.table[f] for f, u, _ in hold]) + bias, np.array([y for *_, y in hold]), seed)
    return model


#: First and last code points of letters of other scripts, from which texts in no learnt language are made up.
_SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def made_up(seed: int, many: int = MADE) -> list[str]:
    """Texts in no language: so many of random letters, of consonants, and of other scripts."""
    rng = np.random.default_rng(seed)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", *("".join(map(chr, range(a, b + 1))) for a, b in _SCRIPTS)]

    def text(letters: str, n: int) -> str:
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(n))

    out = [text(k, int(rng.integers(2, 40))) for k in kinds[:2] for _ in range(many)]
    return out + [text(k, int(rng.integers(1, 40))) for k in kinds[2:] for _ in range(-(-many // len(_SCRIPTS)))]


def _calibrate(model: Model, right: np.ndarray, truth: np.ndarray, seed: int) -> None:
    """Sets temperature, level and threshold from logits of labelled texts and of made-up ones."""
    raw = [np.frombuffer(t.encode(), dtype=np.uint8) for t in made_up(seed)]
    wrong = np.concatenate([model.logits(x, np.array([0, len(x)])) for x in raw])
    logits, k = np.concatenate([right, wrong]), len(model.labels)
    target = np.concatenate([truth, np.full(len(wrong), k)])
    weight = np.concatenate([np.full(len(right), 1 / len(right)), np.full(len(wrong), 1 / len(wrong))])
    # smoothed targets, as sure as that many texts allow, keep the temperature from running to nothing
    smooth = np.concatenate([np.full(len(right), 1 / (len(right) + 2)), np.full(len(wrong), 1 / (len(wrong) + 2))])
    top = logits.max(axis=1)

    def loss(level: float, t: float) -> float:
        z = np.column_stack([logits, np.full(len(logits), level)]) / t
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        own = z[np.arange(len(z)), target]
        return float(-(weight * ((1 - smooth) * own + smooth * (z.sum(axis=1) - own) / k)).sum())

    span = max(float(np.ptp(top)), 1e-3)
    grid = [(level, t) for level in np.linspace(top.min(), top.max(), 41) for t in span * np.geomspace(1e-3, 1, 31)]
    model.none, model.temperature = min(grid, key=lambda x: loss(*x))
    accepted = np.sort(model.scores(wrong).max(axis=1))
    model.threshold = float(np.clip(np.quantile(accepted, 1 - FALSE_ACCEPT, method="higher") * (1 + 1e-9), 1.05 / (k + 1), 0.5))
    p = model.scores(right)
    model.false_accept = float((accepted >= model.threshold).mean())
    model.false_reject = float((p.max(axis=1) < model.threshold).mean())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), and the columns of docs named in keep before them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in keep]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds), f"doc_id {docs.schema[id_col].dataType.simpleString()}", "lang_pred string, score double, rejected boolean"])

    used = list(dict.fromkeys([*keep, id_col, text_col]))
    at, ids = used.index(text_col), used.index(id_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            bounds, data = words.utf8(batch.column(at))
            for i, j in words.spans(bounds):  # small batches go out, whatever the size of what came in
                pred, score, short = np.full(j - i, "und", dtype=object), np.zeros(j - i), np.zeros(j - i, dtype=bool)
                for k in range(i, j) if m is not None else ():
                    own = data[bounds[k] : bounds[k + 1]]
                    if _has_letter(own):
                        p = m.scores(m.logits(own, np.array([0, len(own)])))[0]
                        pred[k - i], score[k - i] = m.labels[int(p.argmax())], float(p.max())
                        short[k - i] = np.count_nonzero(_LETTER[own] | (own >= 128)) < LETTERS
                out = short | (score < m.threshold) | (pred == "und") if m is not None else np.ones(j - i, dtype=bool)
                part = batch.slice(i, j - i)
                cols = [*(part.column(c) for c in range(len(keep))), part.column(ids)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score), pa.array(out)], [*keep, "doc_id", "lang_pred", "score", "rejected"])

    return docs.select(*(F.col(c) for c in used)).mapInArrow(words.freeing(run), schema)


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of a pipeline: documents whose language is rejected go; columns stay as they are, whatever their names.

    A null text and one without letters go; a row with a null id is judged by its text as others are, but nothing is learnt from it;
    repeated rows share their fate; texts of any length count whole; without a labelled row to learn from all go; an empty table gives
    an empty one."""
    rows, at = scratch.positional(docs)
    out = predict(rows, train(rows, at["doc_id"], at["text"], at["lang"]), at["doc_id"], at["text"], tuple(at.values()))
    return out.filter(~F.col("rejected")).drop("doc_id", "lang_pred", "score", "rejected").toDF(*docs.columns)
