"""Personal data by native expressions: patterns propose spans, checksums confirm, context scores.

Kinds: email, ip, card (Luhn), phone, iban (mod 97). Positions come from two scans of
one pattern: ``split`` gives what lies between the matches, ``regexp_extract_all`` the matches,
and their running lengths the offsets. Patterns are possessive, so that they need no
backtracking and no deep recursion on very long runs; each matches what its plain form does.

Defined results: a null text is empty and has no spans; overlapping spans of different kinds
all stay; repeated rows give repeated results; an empty table gives an empty one; only the
id and the text column are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

_LOCAL = r"[A-Za-z0-9._%+-]"
#: A run that fails from its first character fails from every later one; \G is the end of the match before.
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words nearby that make a kind likelier, and the score of a span that has none.
_CONTEXT = {
    "email": ("e-?mail|mail|contact|write|address", 0.8),
    "ip": ("ip|host|server|address|network|ping", 0.6),
    "card": ("card|visa|mastercard|amex|credit|debit|payment|cvv", 0.7),
    "phone": ("phone|tel|call|mobile|fax|whatsapp|sms", 0.6),
    "iban": ("iban|account|bank|transfer|bic|swift", 0.9),
}
_NEAR = 48
_BLOCK = 128


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    def add(rest: Column, i: Column) -> Column:
        c = F.substr(iban, (i + 3) % F.length(iban) + 1, F.lit(1))
        v = F.ascii(c)
        return F.when(v < 65, (rest * 10 + v - 48) % 97).otherwise((rest * 100 + v - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), add) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":

        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return F.when(F.length(bare) > 3, False).otherwise(F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(14, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return _mod97(hit) if kind == "iban" else F.lit(True)


def _spans(kind: str, gaps: Column, hits: Column) -> Column:
    """Array of (start, rank, end, kind, score); offsets run within blocks, whose bases are summed before."""
    word, plain = _CONTEXT[kind]
    n, size = F.size(hits), F.lit(_BLOCK)
    lens = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(F.get(hits, i)).cast("long").alias("hit"), i.alias("i")))

    def block(all_: Column, b: Column) -> Column:
        base = F.aggregate(F.slice(all_, F.lit(1), b * size), F.lit(0).cast("long"), lambda t, x: t + x.gap + x.hit)
        none = F.array().cast("array<struct<start:bigint,end:bigint,i:int>>")
        return F.aggregate(
            F.slice(all_, b * size + 1, size),
            F.struct(base.alias("at"), none.alias("out")),
            lambda s, x: F.struct((s["at"] + x.gap + x.hit).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x.gap).alias("start"), (s["at"] + x.gap + x.hit).alias("end"), x.i.alias("i")))).alias("out")),
            lambda s: s["out"],
        )

    def found(p: Column) -> Column:
        near = F.concat(F.right(F.get(gaps, p.i), F.lit(_NEAR)), F.lit(" "), F.left(F.get(gaps, p.i + 1), F.lit(_NEAR)))
        score = F.when(near.rlike(rf"(?i)\b(?:{word})\b"), F.least(F.lit(1.0), F.lit(plain + 0.2))).otherwise(F.lit(plain))
        return F.struct(p.start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), p.end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    placed = F.transform(F.array(lens), lambda all_: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda b: block(all_, b))))[0]
    return F.when(n > 0, F.transform(F.filter(placed, lambda p: _valid(kind, F.get(hits, p.i))), found)).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (start, rank, end, kind, score), by start and then kind as listed; code points."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = []
    for kind, pattern in _PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), 0)
        hits.append((F.when(F.contains("text", F.lit(_NEEDS[kind])), found).otherwise(F.array().cast("array<string>")) if kind in _NEEDS else found).alias(f"hits_{kind}"))
    df = df.select("doc_id", "text", *hits)
    gaps = [F.when(F.size(f"hits_{k}") > 0, F.split("text", p, -1)).alias(f"gaps_{k}") for k, p in _PATTERNS.items()]
    df = df.select("doc_id", *(f"hits_{k}" for k in KINDS), *gaps)
    df = df.select("doc_id", *(_spans(k, F.col(f"gaps_{k}"), F.col(f"hits_{k}")).alias(k) for k in KINDS))
    return df.select("doc_id", F.array_sort(F.concat(*KINDS)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The texts with each span of at least that score replaced by its kind in brackets; overlaps count as the first."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = find_pii(df)
    joined = df.join(spans, df["doc_id"].eqNullSafe(spans["doc_id"])).select(df["doc_id"], "text", F.filter("spans", lambda s: s.score >= least).alias("spans"))
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x.start < s["at"], s).otherwise(F.struct(x.end.alias("at"), F.concat(s["out"], F.substr(F.col("text"), s["at"].cast("int") + 1, (x.start - s["at"]).cast("int")), F.lit("["), x.kind, F.lit("]")).alias("out"))),
        lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"].cast("int") + 1)),
    )
    return joined.select("doc_id", step.alias("text"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"), F.transform("spans", lambda s: s.score).alias("scores"))
