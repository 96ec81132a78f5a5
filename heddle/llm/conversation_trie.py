"""Prefix trie of conversations, rolled up in bands of depths.

A node stands for a distinct sequence of first turns; its key is the exclusive or of
two 64-bit hashes of (depth, role, text) of these turns, so keys of all prefixes are
running values. They are made in bands of BAND depths: inside a band by a window of
at most BAND rows, between bands by the same function over one row a band. Each row
so learns the keys of its ancestors inside its band, and of the node just above.

A node's totals over its subtree come in three steps: nodes add their own values to
the node above their band; these nodes, BAND levels apart, form a trie of their own,
which the same function completes; then each node explodes to its ancestors inside
its band, where a node at a band's end brings the completed total of what hangs below
it. Rounds are the logarithm of the depth, and a node explodes to BAND rows at most.

Order inside a conversation (turn, null first, then role and text) comes from one sort
over all tasks; a conversation may lie across many of them. Rows equal in all four
columns go to one task, which streams them. A conversation's members that end at one
node are joined to text where they lie and hashed in order; SHA-256 itself runs through
one node's ids in one task, holding one chunk.

Defined cases: rows without conv_id are no conversation; null role and text are empty;
repeated turns are turns; other columns take no part; an empty table has no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import column, discard, enter, materialize, release

#: Depths of a band; ids joined to one chunk of text.
BAND, CHUNK = 8, 50_000
#: Leading code points of role and text by which rows are dealt; the rest is compared inside a task.
_LEAD = 24


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2 (hashes of role and text), size (UTF-8 bytes of the text) of every turn."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    dealt = rows.repartitionByRange(*keys, F.substring("role", 1, _LEAD), F.substring("text", 1, _LEAD)).sortWithinPartitions(*keys, "role", "text")
    hashed = dealt.select("conv_id", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"), F.octet_length("text").cast("long").alias("size"))

    def number(batches):
        enter(__name__)
        part, conv, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            places = []
            for c in column(b, "conv_id"):
                n = n + 1 if c == conv else 1
                conv = c
                places.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), pa.array(places, pa.int64())], [*b.schema.names, "part", "place"])
        release()

    found = materialize(hashed.mapInArrow(number, "conv_id long, h1 long, h2 long, size long, part long, place long"), "turns")
    # only the first conversation of a part may have begun in an earlier one
    edge = F.struct("conv_id", "place")
    ends = found.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(edge).alias("last")).collect()
    carried, last = [], (None, 0)
    for r in sorted(ends, key=lambda r: r["part"]):
        begun = last[1] if last[0] == r["first"] else 0
        if begun:
            carried.append((r["part"], r["first"], begun))
        last = r["last"]["conv_id"], r["last"]["place"] + (begun if r["last"]["conv_id"] == r["first"] else 0)
    spark = conversations.sparkSession
    # one row a part at most
    before = F.broadcast(spark.createDataFrame(carried, "part long, conv_id long, begun long"))
    return found.join(before, ["part", "conv_id"], "left").select("conv_id", (F.col("place") + F.coalesce("begun", F.lit(0))).alias("pos"), "h1", "h2", "size")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, depth from 1, h1, h2, size, ends), and all (conv_id, depth).

    The first turns of the conversation conv_id - conv_id % 5 come first, then its own after as many.
    """
    base = F.col("conv_id") - F.col("conv_id") % 5
    lengths = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", base.alias("base"), shared_turns(F.col("conv_id")).alias("h")), "lengths")
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    whole = lengths.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    whole = materialize(whole.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")), "lengths")
    heads = turns.where("pos <= 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    taken = heads.join(whole.where("taken > 0").select("conv_id", "base", "taken", F.col("depth").alias("last")), "base").where("pos <= taken")
    # a conversation's row goes to its turns: AQE splits the turns of a long one
    own = turns.join(whole.select("conv_id", "h", "taken", F.col("depth").alias("last")), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    cols = ["conv_id", F.col("pos").alias("depth"), "h1", "h2", "size", (F.col("pos") == F.col("last")).alias("ends")]
    rows = materialize(taken.select(*cols).unionByName(own.select(*cols)), "rebuilt")
    discard(lengths)
    return rows, whole.select("conv_id", "depth")


def chains(rows: DataFrame, deepest: int) -> list[DataFrame]:
    """For each level (depths 1, BAND, BAND^2 apart): conv_id, depth, top1, top2 and chain.

    rows: conv_id, depth (1 to deepest, without gaps), k1, k2 (what the depth adds to the key).
    chain: keys from the first depth of the band to this one; top: the key just above the band.
    """
    band = F.floor((F.col("depth") - 1) / BAND)
    above: list[DataFrame] = []
    placed = rows.withColumn("band", band)
    if deepest > BAND:
        up = placed.groupBy("conv_id", "band").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
        above = chains(up.select("conv_id", (F.col("band") + 1).alias("depth"), "k1", "k2"), -(-deepest // BAND))
        own = F.element_at("chain", -1)
        tops = above[0].select("conv_id", F.col("depth").alias("band"), own["k1"].alias("top1"), own["k2"].alias("top2"))
        placed = placed.join(tops, ["conv_id", "band"], "left").withColumns({"top1": F.coalesce("top1", F.lit(0)), "top2": F.coalesce("top2", F.lit(0))})
    else:
        placed = placed.withColumns({"top1": F.lit(0).cast("long"), "top2": F.lit(0).cast("long")})
    inside = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(F.bit_xor("k1").over(inside).bitwiseXOR(F.col("top1")).alias("k1"), F.bit_xor("k2").over(inside).bitwiseXOR(F.col("top2")).alias("k2"))
    keyed = placed.withColumn("key", key)
    found = keyed.withColumn("chain", F.collect_list("key").over(inside)).select("conv_id", "depth", "top1", "top2", "chain")
    return [materialize(found, "chains"), *above]


def subtree_sums(levels: list[DataFrame], values: DataFrame, names: list[str]) -> DataFrame:
    """k1, k2 and the sums of the named values over the subtree of each node but the root, itself included.

    levels: for each level k1, k2, top1, top2, chain of its nodes; values: k1, k2, names of the first level's.
    """
    nodes = levels[0].join(values, ["k1", "k2"])
    ready = [F.col(c) for c in names]
    if len(levels) > 1:
        tops = nodes.groupBy(F.col("top1").alias("k1"), F.col("top2").alias("k2")).agg(*[F.sum(c).alias(c) for c in names])
        below = subtree_sums(levels[1:], materialize(tops, "bands"), names)
        nodes = nodes.join(below.select("k1", "k2", *[F.col(c).alias(f"below_{c}") for c in names]), ["k1", "k2"], "left")
        ready = [(F.col(c) + F.coalesce(f"below_{c}", F.lit(0))).alias(c) for c in names]
    up = nodes.select(F.explode("chain").alias("key"), *ready)
    return materialize(up.groupBy(F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2")).agg(*[F.sum(c).alias(c) for c in names]), "sums")


def hashed_members(ends: DataFrame) -> DataFrame:
    """k1, k2 and the SHA-256 of the decimal conv_ids in ascending order, joined by commas, of each node in ends (k1, k2, conv_id)."""

    def chunks(batches):
        enter(__name__)
        held: list[int] = []
        at = None

        def out():
            text = ",".join(map(str, held)).encode()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((at[0], pa.int64()), (at[1], pa.int64()), (held[0], pa.int64()), (text, pa.binary()))], ["k1", "k2", "first", "ids"])

        for b in batches:
            for k1, k2, c in zip(*[column(b, x) for x in ("k1", "k2", "conv_id")], strict=True):
                if held and (at != (k1, k2) or len(held) == CHUNK):
                    yield out()
                    held.clear()
                at = k1, k2
                held.append(c)
        if held:
            yield out()
        release()

    def hashes(batches):
        at, state, done = None, None, []
        for b in batches:
            for k1, k2, text in zip(*[column(b, x) for x in ("k1", "k2", "ids")], strict=True):
                if at == (k1, k2):
                    state.update(b",")
                else:
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = (k1, k2), hashlib.sha256()
                state.update(text)
            yield _digests(done)
            done = []
        if at:
            yield _digests([(*at, state.hexdigest())])

    # rows are dealt by (node, member), so a node of very many members lies in many tasks
    dealt = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    parts = dealt.select("k1", "k2", "conv_id").mapInArrow(chunks, "k1 long, k2 long, first long, ids binary")
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashes, "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: members but one, times the bytes of a node's last text), ends_sha256."""
    turns = ordered_turns(conversations)
    rows, convs = rebuild(turns)
    deepest = convs.agg(F.max("depth")).first()[0] or 0
    adds = rows.select("conv_id", "depth", *[F.xxhash64(F.lit(k), "depth", "h1", "h2").alias(f"k{k}") for k in (1, 2)])
    paths = chains(adds, max(deepest, 1))
    last = F.element_at("chain", -1)
    named = [p.select("conv_id", "depth", last["k1"].alias("k1"), last["k2"].alias("k2"), "top1", "top2", "chain") for p in paths]
    members = materialize(named[0].drop("top1", "top2", "chain").join(rows.select("conv_id", "depth", "size", "ends"), ["conv_id", "depth"]), "members")
    above = F.when(F.size("chain") > 1, F.element_at("chain", -2)).otherwise(F.struct(F.col("top1").alias("k1"), F.col("top2").alias("k2")))
    links = named[0].groupBy("k1", "k2").agg(F.first(above).alias("up"), F.first("top1").alias("top1"), F.first("top2").alias("top2"), F.first("chain").alias("chain"))
    links = materialize(links, "links")
    counted = members.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"))
    children = links.groupBy(F.col("up.k1").alias("k1"), F.col("up.k2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = counted.join(children, ["k1", "k2"], "left").fillna(0, ["n_children"])
    nodes = materialize(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("size")), "nodes")
    higher = [p.groupBy("k1", "k2").agg(F.first("top1").alias("top1"), F.first("top2").alias("top2"), F.first("chain").alias("chain")) for p in named[1:]]
    sums = subtree_sums([links.drop("up"), *higher], nodes.select("k1", "k2", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    at_root = convs.where("depth = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    ends = hashed_members(members.where("ends").select("k1", "k2", "conv_id").unionByName(at_root))
    first = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    below = sums.join(nodes.where("depth = 1").select("k1", "k2"), ["k1", "k2"]).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    own = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    figures = own.unionByName(first, True).unionByName(below, True)
    zero = F.lit(0).cast("long")
    root = figures.agg(*[F.max(c).alias(c) for c in figures.columns]).where("n_convs > 0")
    root = root.select(
        zero.alias("k1"),
        zero.alias("k2"),
        "conv_id",
        zero.alias("depth"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.lit(None).cast("long").alias("parent_conv_id"),
    )
    parents = nodes.select("k1", "k2", "conv_id").unionByName(root.select("k1", "k2", "conv_id")).select(F.struct("k1", "k2").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    # a node with very many children: AQE splits them
    inner = nodes.drop("size", "n_leaves", "saved_tokens").join(sums, ["k1", "k2"]).join(links.select("k1", "k2", "up"), ["k1", "k2"]).join(parents, "up").drop("up")
    every = inner.unionByName(root)
    nothing = F.lit(hashlib.sha256().hexdigest())
    return every.join(ends, ["k1", "k2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
