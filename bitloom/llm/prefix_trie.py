"""The trie of conversation prefixes, by partition refinement.

All conversations start in one class, the root. Classes split by their members' next turns; a class of one
member is retired, as nothing can split it: the rest of that conversation is a chain of nodes with one member and one
child each, written down without another look at it. A pass splits classes over a stretch of depths, each twice as
long as the one before, so that passes are few however long the conversations are. Folding back, each conversation hands
every shared node on its path what it adds to that node's subtree: sums by node, no walk over the levels.

A class is named by its depth and 128 bits over its members' turns so far: each turn's digest is hashed with its place,
and the hashes are combined by exclusive or, so that names of prefixes come out of running windows. Windows run
over stretches of a conversation, and over the stretches' totals, so that a conversation of any length is worked on by
many tasks; turns are put in order by ranges of the whole table. Texts are shuffled once, for that order.

Defined results: rows of a null conv_id are no conversation and go; turns of equal (or null) number go by role, then
text; null roles and texts are empty; equal rows are turns each on their own; an empty table has no node, not even a root;
columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import Scratch, words

#: Turns of a conversation that one window holds.
STRETCH = 4096
#: Depths of the first pass.
FIRST = 4
NAME = ("k1", "k2")
#: The SHA-256 of nothing.
NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), turn_id (digest of role and text), n_words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    plain = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    by = ["conv_id", "turn", "role", "text"]
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    laid = plain.repartitionByRange(*by).sortWithinPartitions(*by)
    # The partition's number stands in the id's upper bits, the row's place in the lower.
    laid = scratch.keep(laid.select("conv_id", F.monotonically_increasing_id().alias("at"), digest.alias("turn_id"), F.size(words(F.col("text"))).cast("long").alias("n_words")))
    part = F.shiftright("at", 33)
    counts = laid.groupBy("conv_id", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only conversations that go on from one partition into the next: fewer than there are partitions.
    carried = counts.select("conv_id", "part", before.alias("before")).where("before IS NOT NULL")
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    placed = laid.withColumn("part", part).withColumn("within", within).join(carried, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("within")).cast("long").alias("pos"), "turn_id", "n_words")


def rebuilt(placed: DataFrame, heads: Column, root: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first turns of another: (conv_id, depth, turn_id, n_words) and (conv_id, len).

    heads: how many turns are taken, up to `most`; root: the conversation that they are taken from. The own turns
    follow, but for as many first ones."""
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("h", heads.cast("long")).withColumn("root", root.cast("long"))
    lengths = convs.select(F.col("conv_id").alias("root"), F.least(F.col("own"), F.lit(most).cast("long")).alias("there"))
    convs = convs.join(lengths, "root", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    first = placed.where(F.col("pos") <= most).select(F.col("conv_id").alias("root"), "pos", "turn_id", "n_words")
    lent = convs.where("taken > 0").join(first, "root").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "turn_id", "n_words")
    kept = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "turn_id", "n_words")
    return lent.union(kept), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("len"))


def paths(turns: DataFrame) -> DataFrame:
    """turns(conv_id, depth, turn_id, n_words) with the name of the node at that depth, k1 and k2, the step to it from its
    parent, t1 and t2, and `so_far`, the words up to there."""
    named = turns.select("conv_id", "depth", "n_words", *(F.xxhash64(F.lit(i), "depth", "turn_id").alias(f"t{i}") for i in (1, 2)))
    named = named.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    sums = lambda: [F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.sum("n_words").alias("x3")]
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = named.groupBy("conv_id", "stretch").agg(*sums())
    totals = totals.select("conv_id", "stretch", F.bit_xor("x1").over(before).alias("x1"), F.bit_xor("x2").over(before).alias("x2"), F.sum("x3").over(before).alias("x3")).where("stretch > 0")
    here = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    run = named.withColumns({"y1": F.bit_xor("t1").over(here), "y2": F.bit_xor("t2").over(here), "y3": F.sum("n_words").over(here)}).join(totals, ["conv_id", "stretch"], "left")
    zero = F.lit(0).cast("long")
    key = lambda i: F.col(f"y{i}").bitwiseXOR(F.coalesce(f"x{i}", zero))
    return run.select("conv_id", "depth", "n_words", key(1).alias("k1"), key(2).alias("k2"), "t1", "t2", (F.col("y3") + F.coalesce("x3", zero)).alias("so_far"))


def refined(at: DataFrame, scratch: Scratch, first: int = FIRST) -> DataFrame:
    """The paths' rows at nodes of two members or more, with n_convs, owner (the smallest member) and enders (members that end there).

    at: paths with `len`, the conversation's last depth, from depth 0."""
    node = ["depth", *NAME]
    lo, hi, alive, shared = -1, first, None, None
    while True:
        here = at.where((F.col("depth") > lo) & (F.col("depth") <= hi))
        if alive is not None:
            here = here.join(alive, "conv_id", "left_semi")
        split = here.groupBy(*node).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), F.sum((F.col("len") == F.col("depth")).cast("long")).alias("enders"))
        # Written first, the classes are joined by a join of their own, in which a class of many members can be split.
        rows = scratch.keep(here.join(scratch.keep(split.where("n_convs > 1")), node))
        shared = rows if shared is None else shared.union(rows)
        alive = rows.where((F.col("depth") == hi) & (F.col("len") > hi)).select("conv_id")
        if alive.isEmpty():
            return shared
        lo, hi = hi, 2 * hi + first


def _ends(members: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes at which members(depth, k1, k2, conv_id) end.

    A digest is of all ids in one order, so a node's ids run through one task, sorted by Spark, one by one; none are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []
        give = lambda: pa.RecordBatch.from_arrays([*(pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)), pa.array([d[1] for d in done], pa.string())], ["depth", *NAME, "ends_sha256"])
        for batch in batches:
            for *node, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if node == last:
                    state.update(b",%d" % conv)
                    continue
                if last:
                    done.append((last, state.hexdigest()))
                last, state = node, hashlib.sha256(b"%d" % conv)
            if done:
                yield give()
                done.clear()
        if last:
            done.append((last, state.hexdigest()))
            yield give()

    node = ["depth", *NAME]
    laid = members.select(*node, "conv_id").repartition(*node).sortWithinPartitions(*node, "conv_id")
    return laid.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch, first: int = FIRST) -> DataFrame:
    """A row for each node of turns(conv_id, depth, turn_id, n_words), conversations of lengths(conv_id, len): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    node, zero = ["depth", *NAME], F.lit(0).cast("long")
    lengths = scratch.keep(lengths)
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("n_words"), *(zero.alias(c) for c in (*NAME, "t1", "t2", "so_far")), "len")
    at = scratch.keep(paths(turns).join(lengths, "conv_id").unionByName(roots))
    shared = scratch.keep(refined(at, scratch, first))
    # Of each conversation: its last shared depth, the owner and name of the node there, and the words up to where it comes to own its nodes.
    last = F.max_by(F.struct("depth", *NAME, "owner", "n_convs", "enders"), "depth")
    mine = F.coalesce(F.max(F.when(F.col("owner") != F.col("conv_id"), F.col("so_far"))), zero)
    convs = shared.groupBy("conv_id").agg(last.alias("last"), mine.alias("lent"))
    convs = scratch.keep(lengths.join(convs, "conv_id", "left").withColumn("tail", F.col("len") > F.coalesce("last.depth", F.lit(-1).cast("long"))))
    # A leaf is the end of a tail, or a shared node at which all members end; of those, the owner stands for it.
    leaf = F.col("tail") | ((F.col("last.enders") == F.col("last.n_convs")) & (F.col("last.owner") == F.col("conv_id")))
    adds = F.when(F.col("owner") != F.col("conv_id"), F.col("lent") - F.col("so_far") + F.col("n_words")).otherwise(zero)
    folded = shared.join(convs.select("conv_id", "lent", leaf.alias("leaf"), "tail", F.col("last.depth").alias("stop")), "conv_id").groupBy(*node).agg(
        F.first("owner").alias("conv_id"), F.first("n_convs").alias("n_convs"), F.sum(adds).alias("saved_tokens"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum((F.col("tail") & (F.col("depth") == F.col("stop"))).cast("long")).alias("tails"), F.first("enders").alias("enders"), F.first("t1").alias("t1"), F.first("t2").alias("t2"),
    )
    folded = scratch.keep(folded)
    up = folded.where("depth > 0").select(F.col("depth") - 1, F.col("k1").bitwiseXOR(F.col("t1")), F.col("k2").bitwiseXOR(F.col("t2")), *node).toDF("pd", "p1", "p2", *node)
    below = up.groupBy(F.col("pd").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("below"))
    above = up.join(folded.select(F.col("depth").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")), ["pd", "p1", "p2"]).select(*node, "parent_conv_id")
    ends = _ends(shared.where("depth = len"))
    full = folded.join(below, node, "left").join(above, node, "left").join(ends, node, "left")
    out = full.select("conv_id", "depth", "parent_conv_id", "n_convs", (F.col("tails") + F.coalesce("below", zero)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
    # Tails: one member all the way down.
    from_ = F.coalesce(F.col("last.depth"), F.lit(-1).cast("long")) + 1
    tails = at.select("conv_id", "depth").join(convs.where("tail").select("conv_id", "len", from_.alias("from"), "last.owner"), "conv_id").where("depth >= from")
    one, is_end = F.lit(1).cast("long"), F.col("depth") == F.col("len")
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    parent = F.when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("owner"))
    chain = tails.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(is_end, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(is_end, own).otherwise(F.lit(NONE)).alias("ends_sha256"))
    return out.unionByName(chain)


def seeded_trie(turns: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """The trie of conversations rebuilt on the first turns (up to `most`, by the id's crc32) of every `every`-th conversation."""
    scratch = Scratch(turns.sparkSession)
    placed = scratch.keep(ordered_turns(turns, scratch))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    return trie(*rebuilt(placed, heads, F.col("conv_id") - F.col("conv_id") % every, most), scratch)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    scratch = Scratch(turns.sparkSession)
    placed = scratch.keep(ordered_turns(turns, scratch))
    return trie(placed.withColumnRenamed("pos", "depth"), placed.groupBy("conv_id").agg(F.max("pos").alias("len")), scratch)
