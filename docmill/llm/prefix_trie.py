"""Conversation prefix trie by partition refinement.

All conversations start in one class, the root. Each round looks at one more turn: a class is split by the
turn its members have there, and every part is a node of the trie. A part with a single turn sequence left is
retired: no other conversation can share what follows, so its tail is a chain of nodes with one child each and
is written out at once. Rounds go on while a class has two different sequences, that is as deep as different
conversations agree. Equal conversations are one sequence with a number of copies. Then leaves and saved tokens are
folded back, one level at a time, from the deepest nodes to the root.

A round shuffles one small row for each active sequence and no texts: turns are compared by SHA-256. What a
node shares with a third of all conversations is a count, summed before the shuffle. Only the digest of the
members that end at a node needs them in order: their numbers are sorted in ranges, joined to stretches of text
by range, and these stream through the hash, one after the other.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, ranked, written

#: Turns that a follower takes over at most, and conversations that follow the same one.
HEADS, GROUP = 6, 100
#: Numbers of a stretch of text that goes to the hash as one row.
STRETCH = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """What two turns have in common exactly if role and text are equal."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_in_order(rows: DataFrame) -> DataFrame:
    """conv, pos (from 1), key, chars of the rows (conv_id, turn, role, text), null turns first, equal ones by role and text.

    Null roles and texts are empty; rows without conv_id belong to no conversation. Rows are sorted in ranges of
    all columns, so a conversation of any length takes several tasks.
    """
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", r.alias("role"), t.alias("text"))
    rows = rows.select("conv", "turn", "role", "text", turn_key(F.col("role"), F.col("text")).alias("key"), F.char_length("text").cast("long").alias("chars"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("key")]
    placed = ranked(rows, order, [], "turns").select("conv", "key", "chars", "n")
    first = placed.groupBy("conv").agg((F.min("n") - 1).alias("before"))
    return placed.join(first, "conv").select("conv", (F.col("n") - F.col("before")).alias("pos"), "key", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, pos, key, chars: the first h turns of conversation conv - conv % 100, then the own ones after h; h = crc32(conv) % 6.

    A conversation that is left without a turn has no rows.
    """
    h = F.crc32(F.col("conv").cast("string")) % HEADS
    heads = turns.filter((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS)).select(F.col("conv").alias("base"), F.col("pos").alias("at"), "key", "chars")
    there = heads.groupBy("base").agg(F.max("at").alias("there"))  # turns that can be taken over
    convs = turns.select("conv").distinct().withColumns({"h": h, "base": F.col("conv") - F.col("conv") % GROUP}).join(there, "base", "left")
    convs = convs.select("conv", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    taken = convs.filter("taken > 0").join(heads, "base").filter("at <= taken").select("conv", F.col("at").alias("pos"), "key", "chars")
    own = turns.join(convs.select("conv", "h", "taken"), "conv").filter("pos > h")
    return taken.unionByName(own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "chars"))


def sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, len, copies) of each distinct sequence of turns, named after its smallest conversation, and (conv, seq) of all.

    Equal sequences have equal digests of (place, turn) pairs, brought together by exclusive or.
    """
    pair = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("key")), 256)
    lanes = [F.conv(F.substring(pair, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)]
    own = turns.groupBy("conv").agg(F.count("*").alias("len"), *[F.bit_xor(x).alias(f"d{k}") for k, x in enumerate(lanes)])
    digest = ["len", "d0", "d1", "d2", "d3"]
    every = convs.join(own, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in digest])
    every = written(every, "digests")
    groups = every.groupBy(*digest).agg(F.min("conv").alias("seq"), F.count("*").alias("copies"))
    return groups.select("seq", "len", "copies"), every.join(groups, digest).select("conv", "seq")


def _stretches(batches):
    """Joins runs of sorted (conv_id, depth, conv) rows to texts; ``first`` tells their order."""
    node, run = None, []

    def out():
        text = ",".join(map(str, run))
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([run[0]], pa.int64()), pa.array([text], pa.string())], names=["conv_id", "depth", "first", "text"])

    for batch in batches:
        for conv_id, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if run and ((conv_id, depth) != node or len(run) >= STRETCH):
                yield out()
                run = []
            node = conv_id, depth
            run.append(conv)
    if run:
        yield out()


def _digests(batches):
    """SHA-256 of each node's texts, comma-joined; rows are sorted by node and ``first``."""
    node, state = None, None
    for batch in batches:
        done: tuple[list, list, list] = [], [], []
        for conv_id, depth, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (conv_id, depth) != node:
                if node is not None:
                    for column, x in zip(done, (*node, state.hexdigest())):
                        column.append(x)
                node, state = (conv_id, depth), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["conv_id", "depth", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the rows (conv_id, depth, conv): each node's conv in ascending order, comma-joined, hashed.

    Numbers are sorted and joined in ranges, whatever share of them a node has; a node's stretches then pass through one
    task, which holds one at a time (a hash has an order).
    """
    parts = ends.orderBy("conv_id", "depth", "conv").mapInArrow(_stretches, "conv_id bigint, depth bigint, first bigint, text string")
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_digests, "conv_id bigint, depth bigint, ends_sha256 string")


def _level(active: DataFrame, turns: DataFrame, depth: int) -> DataFrame:
    """Members of the parts that one more turn splits the active classes into: a class's number is its smallest conversation."""
    met = active.select("seq", "len", "copies", F.col("node").alias("parent")).join(turns.filter(F.col("pos") == depth).select("seq", "key", "chars"), "seq")
    parts = met.groupBy("parent", "key").agg(F.min("seq").alias("node"), F.count("*").alias("seqs"), F.sum("copies").alias("n_convs"))
    return met.join(parts, ["parent", "key"]).select("seq", "len", "copies", "parent", "node", "seqs", "n_convs", "chars")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of the conversations ``convs`` (conv) with the turns (conv, pos, key, chars).

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. A conversation without turns ends at the root; without conversations there is no node. The number of
    rounds is the length of the longest beginning that two different conversations share; each starts jobs at plan time.
    """
    spark = turns.sparkSession
    seqs, members = sequences(turns, convs)
    seqs = written(seqs, "sequences")
    path = new_path(spark, "turns")
    own = turns.select(F.col("conv").alias("seq"), "pos", "key", "chars").join(seqs.select("seq"), "seq", "left_semi")
    # by place in the conversation, so that a round reads little more than its own turns
    own.repartitionByRange("pos", "seq").sortWithinPartitions("pos").write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)

    root = seqs.agg(F.min("seq").alias("node"), F.count("*").alias("seqs"), F.sum("copies").alias("n_convs"))  # one row
    level = seqs.crossJoin(root).select("seq", "len", "copies", F.lit(None).cast("long").alias("parent"), "node", "seqs", "n_convs", F.lit(0).cast("long").alias("chars"))
    levels = [written(level, "level-0")]
    while (active := levels[-1].filter("seqs > 1")).limit(1).count():
        levels.append(written(_level(active, own, len(levels)), f"level-{len(levels)}"))

    chains, ends = [], []
    for depth, level in enumerate(levels):
        alone = level.filter("seqs = 1").withColumn("depth", F.lit(depth).cast("long"))
        chains.append(alone.select("seq", "len", "copies", "depth", "parent", "chars"))
        last = F.when(F.col("seqs") == 1, F.col("seq")).otherwise(F.col("node"))
        ends.append(level.filter((F.col("seqs") == 1) | (F.col("len") == depth)).select("seq", last.alias("conv_id"), F.col("len").alias("depth")))
    retired = _union(chains)
    tails = retired.select("seq", "len", "copies", F.col("depth").alias("top"), F.lit(None).cast("long").alias("up")).join(own.select("seq", F.col("pos").alias("depth"), "chars"), "seq").filter("depth > top")
    heads = retired.select("seq", "len", "copies", F.col("depth").alias("top"), F.col("parent").alias("up"), "depth", "chars")
    chain = heads.unionByName(tails.select(heads.columns)).withColumn("own", (F.col("copies") - 1) * F.col("chars"))
    below = Window.partitionBy("seq").orderBy(F.desc("depth"))  # of a chain that nothing is saved in the sum is 0
    once, often = chain.filter("copies = 1").withColumn("saved_tokens", F.lit(0).cast("long")), chain.filter("copies > 1").withColumn("saved_tokens", F.sum("own").over(below))
    chain = once.unionByName(often).select(
        F.col("seq").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("up")).otherwise(F.col("seq")).alias("parent_conv_id"),
        F.col("copies").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", (F.col("depth") == F.col("top")).alias("top"),
    )
    chain = written(chain, "chains")

    folded: list[DataFrame] = []  # the deepest level first
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].filter("seqs > 1 and seq = node").select("node", "parent", "n_convs", "chars")
        kids = chain.filter(F.col("top") & (F.col("depth") == depth + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        if folded:
            kids = kids.unionByName(folded[-1].select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = kids.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("kids_saved"))
        folded.append(
            written(
                nodes.join(sums, "node").select(
                    F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                    ((F.col("n_convs") - 1) * F.col("chars") + F.col("kids_saved")).alias("saved_tokens"),
                ),
                f"folded-{depth}",
            )
        )
    digests = ends_digests(members.join(_union(ends), "seq").select("conv_id", "depth", "conv"))
    nodes = _union([*folded, chain.drop("top")])
    return nodes.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of all conversations of a table (conv_id, turn, role, text), each rebuilt by ``rebuilt``.

    Null roles and texts are empty, null turns come first, rows without conv_id don't count; other columns don't matter.
    """
    own = written(turns_in_order(rows.select("conv_id", "turn", "role", "text")), "own-turns")
    return trie(written(rebuilt(own), "rebuilt"), own.select("conv").distinct())
