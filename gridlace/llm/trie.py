"""A trie of conversations, in preorder: every distinct sequence of first turns is a node, with the interval of its subtree.

1. Turns are put in order by a distributed scan, and a digest stands for each (role, text).
2. Distinct sequences of turns get their lexicographic rank: digests by blocks of BLOCK, distinct blocks are sorted and ranked, ranks
   are taken by blocks again, until each sequence is one number. No row holds more than BLOCK of them, however long a conversation.
3. Prefixes are named by running exclusive ors of 128-bit hashes of (depth, digest) over the sequences; equal names make one node.
   A node's members are the sequences from the first to the last rank that hold it, so nodes in the order of (first sequence,
   depth) are in preorder, and the subtree of a node ends with the last node that its last sequence brings in.
4. One scan in preorder sums leaves and savings; a subtree's figures are the difference of two sums.

Only distinct sequences are spelled out: a conversation that occurs a million times is one of them with a weight. Defined results:
rows with a null conversation id belong to none; null roles and texts are empty; turns of one number follow by role, then by digest,
rows that are repeated are turns of their own; conversations of any length are taken in ranges; an empty table gives no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans, scratch, words

#: Turns, or ranks of blocks, that are compared as one key. Bytes of joined ids in one row.
BLOCK, PACK = 64, 1 << 16
#: Of the query: conversations of one shared start, and one more than the most turns that are shared.
FAMILY, HEADS = 20, 4


def ordered_turns(conversations: DataFrame, store: scratch.Scratch, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """(conv_id, pos, digest, words): turns of each conversation, pos from 1 in the order of turn, nulls first."""
    c, turn, role, text = names
    said = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text)]
    plain = conversations.filter(F.col(c).isNotNull()).select(
        F.col(c).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said[0].alias("role"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said), 256)), 1, 16).alias("digest"),
        F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"),
    )
    ranked = scans.scan(store.table(plain, "plain"), ["conv_id", "turn", "role", "digest", "tie"], store, "turns")
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"))
    return store.table(ranked.join(first, "conv_id").select("conv_id", (F.col("rank") - F.col("first") + 1).alias("pos"), "digest", "words"), "placed")


def with_shared_heads(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """turns with conversations rebuilt: the first h turns of conversation c - c % family, then c's own after its first h; h = crc32(c) % heads.

    A conversation left without turns has one row, with pos 0."""
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    convs = turns.select("conv_id").distinct().select("conv_id", base, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    starts = turns.filter(F.col("pos") < heads).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    convs = convs.join(starts, "base", "left").withColumn("head", F.coalesce(F.filter("head", lambda t: t["pos"] <= F.col("h")), F.array()))
    shared = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.words")
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("k")), "conv_id").filter(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "words")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return shared.unionByName(own).unionByName(none)


def sequence_ranks(turns: DataFrame, store: scratch.Scratch) -> DataFrame:
    """(conv_id, seq): the lexicographic rank of each conversation's sequence among the distinct ones; -1 for one without turns."""
    symbols = turns.filter("pos > 0").select("conv_id", (F.col("pos") - 1).alias("at"), F.col("digest").alias("symbol"))
    longest, level = turns.agg(F.max("pos")).first()[0] or 0, 0
    while True:
        block = F.floor(F.col("at") / BLOCK).cast("long").alias("at")
        own = F.array_sort(F.collect_list(F.struct("at", "symbol")))
        keyed = symbols.groupBy("conv_id", block.alias("block")).agg(F.transform(own, lambda x: x["symbol"]).alias("key"))
        keyed = store.table(keyed, f"keyed{level}")
        ranks = scans.scan(keyed.select("key").distinct(), ["key"], store, f"ranks{level}").withColumnRenamed("rank", "symbol")
        symbols = keyed.join(ranks, "key").select("conv_id", F.col("block").alias("at"), "symbol")
        longest, level = -(-longest // BLOCK), level + 1
        if longest <= 1:
            break
        symbols = store.table(symbols, f"symbols{level}")
    every = turns.filter("pos = 0").select("conv_id")
    return store.table(every.join(symbols.select("conv_id", F.col("symbol").alias("seq")), "conv_id", "left").select("conv_id", F.coalesce("seq", F.lit(-1)).alias("seq")), "seqs")


def joined_ids(seqs: DataFrame, store: scratch.Scratch) -> DataFrame:
    """(seq, ends_sha256): of each sequence the hash of its conversations' ids, ascending and joined by commas.

    Ranges of ids are joined into rows of PACK bytes, which one task hashes as a stream: a hash has to see them in order."""
    ranged = seqs.select("seq", "conv_id").repartitionByRange(scratch.fanout(seqs.sparkSession), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")

    def pack(batches):
        part, n, seq, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([",".join(held)])], ["seq", "part", "n", "ids"])

        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (s != seq or size >= PACK):
                    yield row()
                    n, held, size = n + 1, [], 0
                seq = s
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def finish(batches):
        seq, sha = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != seq:
                    if sha is not None:
                        done.append((seq, sha.hexdigest()))
                    seq, sha = s, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["seq", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([sha.hexdigest()])], ["seq", "ends_sha256"])

    packed = store.table(ranged.mapInArrow(words.freeing(pack), "seq long, part long, n long, ids string"), "packed")
    return packed.repartition("seq").sortWithinPartitions("seq", "part", "n").mapInArrow(words.freeing(finish), "seq long, ends_sha256 string")


def build(turns: DataFrame, store: scratch.Scratch) -> DataFrame:
    """Nodes of the trie of (conv_id, pos, digest, words), in which each conversation has a row with pos 0.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the interval
    of the subtree in preorder: node (from 0) and last."""
    turns = store.table(turns, "rebuilt")
    seqs = sequence_ranks(turns, store)
    each = store.table(seqs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "each")
    lane = [F.when(F.col("pos") > 0, h).otherwise(0) for h in (F.xxhash64("pos", "digest"), F.xxhash64("digest", "pos", F.lit(1)))]
    spelled = turns.join(each, "conv_id").select("seq", "conv_id", "n", F.col("pos").alias("depth"), "words", lane[0].alias("a"), lane[1].alias("b"))
    rows = scans.scan(store.table(spelled, "spelled"), ["seq", "depth"], store, "named", xors=("a", "b"))
    # the row of depth 0 has the exclusive or of all sequences before
    starts = rows.filter("depth = 0").select("seq", F.col("a_upto").alias("a0"), F.col("b_upto").alias("b0"))
    ends = rows.groupBy("seq").agg(F.max("depth").alias("length"))
    rows = rows.join(starts.join(ends, "seq"), "seq").withColumns({"pa": F.col("a_upto").bitwiseXOR(F.col("a0")), "pb": F.col("b_upto").bitwiseXOR(F.col("b0"))})
    above = [F.any_value(F.col(f"p{x}").bitwiseXOR(F.col(x))).alias(f"q{x}") for x in "ab"]
    nodes = rows.groupBy("depth", "pa", "pb").agg(
        F.min("seq").alias("seq"), F.max("seq").alias("last_seq"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.any_value("words").alias("words"), *above, F.bool_or(F.col("depth") == F.col("length")).alias("stops"),
    )
    nodes = store.table(nodes, "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    # children of the root may be as many as there are conversations: its id, one number, is a subquery
    root = nodes.filter("depth = 0").select("conv_id").scalar()
    deep = nodes.filter("depth > 1").join(parents, ["depth", "qa", "qb"])
    high = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root))
    whole = deep.unionByName(high).join(kids, ["depth", "pa", "pb"], "left").select(
        "seq", "last_seq", "depth", "conv_id", "parent_conv_id", "n_convs", "stops", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"),
    )
    whole = store.table(whole.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "whole")
    ranked = scans.scan(whole, ["seq", "depth"], store, "preorder", sums=("leaf", "own"))
    last = ranked.filter("stops").select(F.col("seq").alias("last_seq"), F.col("rank").alias("last"), F.col("leaf_upto").alias("leaf_end"), F.col("own_upto").alias("own_end"))
    stopped = joined_ids(seqs, store)
    none = hashlib.sha256(b"").hexdigest()
    return ranked.join(last, "last_seq").join(stopped.withColumn("stops", F.lit(True)), ["seq", "stops"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf_end") - F.col("leaf_upto") + F.col("leaf")).alias("n_leaves"),
        (F.col("own_end") - F.col("own_upto") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.col("rank").alias("node"), "last",
    )


def prefix_trie(conversations: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """build() of conversations as they are."""
    store = scratch.Scratch(conversations.sparkSession, "trie")
    turns = ordered_turns(conversations, store, names)
    every = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return build(turns.unionByName(every), store)


def op11_trie(spark, sf_dir: str) -> DataFrame:
    store = scratch.Scratch(spark, "trie")
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), store)
    return build(with_shared_heads(turns), store).drop("node", "last")


#: Unsigned crc32 of an id's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda crc, byte: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295))"""
OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said, turn FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(said ORDER BY turn NULLS FIRST, said) AS own, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {HEADS} AS h FROM t GROUP BY conv_id
), s AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.base
), p AS (
  SELECT conv_id, d, sha256(seq[1:d]::JSON::VARCHAR) AS k, sha256(seq[1:d - 1]::JSON::VARCHAR) AS up, d = len(seq) AS stops,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(seq[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)
), n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * any_value(words) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM p GROUP BY d, k
), kids AS (
  SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), whole AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)
), under AS (
  SELECT DISTINCT a.d, a.k, b.d AS at, b.k AS node FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d
), sums AS (
  SELECT u.d, u.k, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.own)::BIGINT AS saved_tokens FROM under u JOIN whole w ON w.d = u.at AND w.k = u.node GROUP BY u.d, u.k
)
SELECT w.conv_id, w.d AS depth, above.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (d, k) LEFT JOIN n above ON w.d > 0 AND above.d = w.d - 1 AND above.k = w.up
"""
