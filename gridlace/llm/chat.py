"""Chat formatting by quotation linking.

1. Each message is parsed into lines with a quote level (the ``>`` signs at its start); runs of one level are
   passages, at any depth. Lines that announce a quotation ("On ... wrote:") go with it. What is left at level 0
   is the message's own text.
2. Own texts and quoted passages are cut into sentences, normalised (letters and digits in lower case, so line
   breaks, marks and case don't matter) and hashed. Every earlier message that wrote a sentence of a passage can be its
   original. Messages with a sentence of up to MANY writers are all compared; of those that share only more common
   sentences, and the same ones, the latest before the quotation stands for all, as no other of them can be chosen.
3. A passage belongs to the earlier message that wrote most of it (by characters; ties: the later message). A
   message replies to the original of its first passage at level 1, or, without one, of its lowest level.
4. Replies are followed to the first message of their thread by pointer doubling. A conversation is ordered by threads
   (by their first turn) and by turn within one, so no message stands before what it replies to. Positions come
   from ranges of the sorted rows, so one long conversation isn't one task's work.

Defined results: a null text is empty; a null conversation or turn has no links and its own thread; a null turn stands
last; messages that share a turn are ordered by role and text, and repeated rows stay, each with its place;
quotes that nothing explains are dropped from the text and leave the message unlinked; an empty table gives an empty one; further
columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

MANY = 16
_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ANNOUNCE = re.compile(r"\s*(?:On\b.{0,300}\bwrote|Le\b.{0,300}\ba écrit|Am\b.{0,300}\bschrieb.{0,100}|El\b.{0,300}\bescribió)\s*:\s*")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n\s*\n")
_WORDS = re.compile(r"[^\W_]+")


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]) of a message."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if last == 0 and any(s.strip() for s in own):
                k = max(i for i, s in enumerate(own) if s.strip())
                if _ANNOUNCE.fullmatch(own[k]):
                    del own[k:]
            body = line[m.end() :]
            inner = _ANNOUNCE.fullmatch(body)
            if level == last and quoted:
                quoted[-1][1].append("" if inner else body)
            else:
                quoted.append((level, ["" if inner else body]))
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), [(n, p) for n, ls in quoted if (p := "\n".join(ls).strip())]


def sentences(text: str) -> dict[int, int]:
    """Hash and length of each normalised sentence; wrapped lines are one sentence."""
    out = {}
    for s in _SENTENCE.split(text):
        norm = " ".join(_WORDS.findall(s)).lower()
        if norm:
            out[xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass")) - 2**63] = len(norm)
    return out


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            done = [parse(t) for t in batch.column(3).to_pylist()]
            facts = [[(0, 0, h, n) for h, n in sentences(own).items()] + [(k + 1, level, h, n) for k, (level, p) in enumerate(quoted) for h, n in sentences(p).items()] for own, quoted in done]
            kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())]))
            rows = [[dict(zip(("passage", "level", "hash", "n"), f, strict=True)) for f in own] for own in facts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array([own for own, _ in done], pa.string()), pa.array([len(q) for _, q in done], pa.int64()), pa.array([max((n for n, _ in q), default=0) for _, q in done], pa.int64()), pa.array(rows, kind)],
                ["conv_id", "turn", "role", "text", "n_quotes", "levels", "facts"],
            )

    kinds = [messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    return messages.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, text string, n_quotes long, levels long, facts array<struct<passage:int,level:int,hash:bigint,n:bigint>>")


def link_quotes(parsed: DataFrame, many: int = MANY) -> DataFrame:
    """(conv_id, turn, reply_to, level, n_common) for turns with a quotation that an earlier message explains."""
    facts = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("facts").alias("f")).select("conv_id", "turn", "f.*")
    quoted = facts.filter("passage > 0").distinct()
    passage = ["conv_id", "turn", "level", "passage"]
    asked = quoted.select("conv_id", "hash").distinct()
    wrote = facts.filter("passage = 0").select("conv_id", "hash", F.col("turn").alias("first")).distinct().join(asked, ["conv_id", "hash"], "left_semi")
    writers = wrote.groupBy("conv_id", "hash").agg(F.count("*").alias("writers"))
    wide = wrote.join(writers, ["conv_id", "hash"])
    rare = quoted.join(wide.filter(F.col("writers") <= many), ["conv_id", "hash"]).filter("first < turn").select(*passage, "first")
    # common sentences: messages by the set of them
    sets = wide.filter(F.col("writers") > many).groupBy("conv_id", "first").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    sets = sets.withColumn("set", F.xxhash64("hashes"))
    kinds = sets.groupBy("conv_id", "set").agg(F.first("hashes").alias("hashes")).select("conv_id", "set", F.explode("hashes").alias("hash"))
    pairs = quoted.join(kinds, ["conv_id", "hash"]).select(*passage, "set").distinct()
    # at one turn the quotation stands before the writer, so it sees earlier ones only
    line = pairs.select("conv_id", "set", "turn", F.lit(None).cast(parsed.schema["turn"].dataType).alias("first")).distinct().unionByName(sets.select("conv_id", "set", F.col("first").alias("turn"), "first"))
    before = Window.partitionBy("conv_id", "set").orderBy("turn", F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    latest = line.withColumn("latest", F.last("first", ignorenulls=True).over(before)).filter("first is null and latest is not null").select("conv_id", "set", "turn", F.col("latest").alias("first"))
    common = pairs.join(latest, ["conv_id", "set", "turn"]).select(*passage, "first")
    found = rare.unionByName(common).distinct().join(quoted, passage).join(wrote, ["conv_id", "first", "hash"])
    votes = found.groupBy(*passage, "first").agg(F.sum("n").alias("n"))
    # lowest level and first passage, then most characters, then the later message
    best = F.min(F.struct("level", "passage", (-F.col("n")).alias("less"), (-F.col("first")).alias("back"))).alias("x")
    return votes.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", (-F.col("x.back")).alias("reply_to"), F.col("x.level").alias("level"), (-F.col("x.less")).alias("n_common"))


def threads(links: DataFrame, store: scratch.Scratch) -> DataFrame:
    """(conv_id, turn, thread): the turn that each linked turn's replies lead to in the end."""
    now = store.table(links.select("conv_id", "turn", F.col("reply_to").alias("up")), "up-0")
    step = 0
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"))
        step += 1
        far = store.table(now.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), f"up-{step}")
        if not far.filter("moved").limit(1).count():
            return far.select("conv_id", "turn", F.col("up").alias("thread"))
        now = far.select("conv_id", "turn", "up")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, turn, role, text, reply_to, thread, n_quotes, quote_levels, formatted): one row a message."""
    spark = messages.sparkSession
    store = scratch.Scratch(spark, "chat")
    messages = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    parsed = store.table(_parsed(messages), "parsed")
    links = store.table(link_quotes(parsed), "links")
    ends = links.join(threads(links, store), ["conv_id", "turn"]) if links.limit(1).count() else links.withColumn("thread", F.col("reply_to"))
    rows = parsed.drop("facts").join(ends, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    # nulls first among conversations, last among turns
    order = [F.col("conv_id"), F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    placed = store.table(rows.repartitionByRange(scratch.fanout(spark), *order).withColumn("part", F.spark_partition_id()), "placed")
    own = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    wide = own.groupBy("conv_id").agg(F.count("*").alias("parts"), F.collect_list(F.struct("part", "n")).alias("own")).filter("parts > 1")
    before = wide.select("conv_id", F.explode("own").alias("x"), "own").select(
        "conv_id", F.col("x.part").alias("part"), F.aggregate(F.filter("own", lambda y: y.part < F.col("x.part")), F.lit(0).cast("long"), lambda t, y: t + y.n).alias("before")
    )
    left, right = placed.alias("l"), before.alias("r")
    joined = left.join(right, F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.part") == F.col("r.part")), "left").select("l.*", F.coalesce("r.before", F.lit(0)).alias("before"))
    window = Window.partitionBy("part", "conv_id").orderBy(*order[1:])
    position = (F.row_number().over(window) - 1 + F.col("before")).cast("long").alias("position")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")).alias("formatted")
    return joined.select("conv_id", position, "turn", "role", "text", "reply_to", "thread", "n_quotes", F.col("levels").alias("quote_levels"), formatted)


def op5_chat(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
