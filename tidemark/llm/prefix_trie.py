"""The trie of conversation prefixes, with subtree totals by parallel tree contraction.

A node is a distinct sequence of the first d turns (role and text) of a conversation; the root is the empty sequence.
It is named by the exclusive or of two 64-bit hashes of its turns, each taken with its place, so all prefixes of a
conversation come from running aggregates over (place, hash) rows, and a node's parent from its own row. Places and
running aggregates are computed in two steps (within bounded pieces, then over the pieces), so one conversation with
a large share of all turns is spread over tasks. Texts are never shuffled, only their hashes and word counts.

Subtree totals come from :mod:`tidemark.llm.tree_sums`. The conversations that end at a node are rows, not lists.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import partitions_of, written
from tidemark.llm.tree_sums import subtree_sums

PIECE = 512   # turns in a piece of a conversation over which hashes run in one window
SHOWN = 96    # characters by which equal turn numbers of a conversation are ordered, before their hash


def sequenced(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), h1, h2 (hashes of role and text), words: the turns of each conversation in order.

    Turns are ordered by number, NULL first; equal numbers by role and text as one string (its first 96 characters,
    then a hash). NULL roles and texts are empty. Repeated rows are turns of their own. Rows with a NULL conversation
    are left out. Other columns are ignored, whatever their names.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.substring(F.concat(who, F.lit("\0"), said), 1, SHOWN).alias("shown"),
        F.xxhash64(who, said).alias("h1"), F.xxhash64(F.lit("second"), said, who).alias("h2"),
        F.size(F.array_remove(F.split(said, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("words")).where("conv IS NOT NULL")
    # Ranges of (conversation, turn) are numbered by themselves, then shifted by what the ranges before them hold.
    order = [F.col("turn").asc_nulls_first(), F.col("shown"), F.col("h1"), F.col("h2")]
    dealt = written(rows.repartitionByRange(partitions_of(turns), F.col("conv"), *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    here = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    return dealt.withColumn("here", here).join(shift, ["conv", "part"]).select(
        "conv", (F.col("here") + F.col("shift")).cast("long").alias("pos"), "h1", "h2", "words")


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv, length of sequenced turns."""
    return turns.groupBy("conv").agg(F.max("pos").alias("length"))


def grafted(turns: DataFrame, group: int, most: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which the first h turns of conversation c come from conversation c - c % group.

    ``most`` is h as an expression of ``conv``. All of the other conversation's turns are taken if it has fewer, none
    if it is absent; then come c's own turns after its first h.
    """
    turns = written(turns, "sequences")
    found = conversations_of(turns)
    plan = found.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), most.cast("long").alias("h"))
    lengths = found.withColumnsRenamed({"conv": "base", "length": "there"})
    plan = written(plan.join(lengths, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "grafts")
    starts = turns.join(plan.select("base").distinct(), F.col("conv") == F.col("base"), "left_semi")
    heads = starts.withColumnRenamed("conv", "base").join(plan.where("taken > 0"), "base").where("pos <= taken")
    tails = turns.join(plan, "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "h1", "h2", "words"]
    return plan.select("conv"), heads.select(*columns).union(tails.select(*columns))


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the prefix trie.

    ``conversations``: conv, distinct, turnless ones included. ``turns``: conv, pos, h1, h2, words.
    nodes: node (its name), conv_id (smallest member), depth, parent_conv_id (NULL at the root), n_convs, n_children,
    n_leaves, saved_tokens. ends: node, conv_id of each conversation whose whole sequence is the node.
    Without conversations there are no nodes.
    """
    mark = lambda salt, h: F.xxhash64(F.lit(salt), "pos", h)
    steps = turns.select("conv", "pos", "words", ((F.col("pos") - 1) / PIECE).cast("long").alias("piece"),
                         mark("one", "h1").alias("t1"), mark("two", "h2").alias("t2"))
    inside = Window.partitionBy("conv", "piece").orderBy("pos")
    runs = written(steps.select("*", F.bit_xor("t1").over(inside).alias("r1"), F.bit_xor("t2").over(inside).alias("r2")), "runs")
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = runs.groupBy("conv", "piece").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2")).select(
        "conv", "piece", F.bit_xor("x1").over(before).alias("b1"), F.bit_xor("x2").over(before).alias("b2")).where("b1 IS NOT NULL")
    whole = lambda r, b: F.col(r).bitwiseXOR(F.coalesce(F.col(b), F.lit(0)))
    prefixes = runs.join(pieces, ["conv", "piece"], "left").select(
        "conv", "pos", "words", F.struct(whole("r1", "b1").alias("k1"), whole("r2", "b2").alias("k2")).alias("node"), "t1", "t2")
    prefixes = written(prefixes.select("conv", "pos", "words", "node", F.struct(
        F.col("node.k1").bitwiseXOR(F.col("t1")).alias("k1"), F.col("node.k2").bitwiseXOR(F.col("t2")).alias("k2")).alias("parent")), "prefixes")

    root = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    top = conversations.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"), F.lit(None).cast("struct<k1:bigint,k2:bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs",
        F.lit(0).cast("long").alias("words"))
    nodes = prefixes.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("pos").alias("depth"), F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"), F.min("words").alias("words")).unionByName(top)
    nodes = written(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, F.col("node") == F.col("of"), "left").drop("of").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    totals = subtree_sums(nodes.select(
        F.col("node").alias("id"), "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ("n_leaves", "saved_tokens"))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(totals.withColumnRenamed("id", "node"), "node").join(parents, "parent", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    last = prefixes.groupBy("conv").agg(F.max_by("node", "pos").alias("node"))
    ends = conversations.join(last, "conv", "left").select(F.coalesce("node", root).alias("node"), F.col("conv").alias("conv_id"))
    return full, ends


def id_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the node's conversation ids, ascending, joined by commas.

    Ranges of (node, id) are sorted and joined to strings by themselves; a node's strings are then hashed one after
    the other, so that a node with very many ends is never held in memory.
    """
    n = partitions_of(ends)
    rows = ends.select("node.k1", "node.k2", F.col("conv_id").alias("id"))

    def joined(batches):
        for batch in batches:
            k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
            if not len(ids):
                continue
            at = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            said = [",".join(map(str, ids[i:j].tolist())).encode() for i, j in zip(at, [*at[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(ids[at]), pa.array(said, pa.binary())], ["k1", "k2", "id", "said"])

    def hashed(batches):
        name, state = None, None
        for batch in batches:
            out = []
            for a, b, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (a, b) != name:
                    if name:
                        out.append((*name, state.hexdigest()))
                    name, state = (a, b), hashlib.sha256(part)
                else:
                    state.update(b"," + part)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "sha"])
        if name:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*name, state.hexdigest())], ["k1", "k2", "sha"])

    parts = rows.repartitionByRange(n, "k1", "k2", "id").sortWithinPartitions("k1", "k2", "id").mapInArrow(
        joined, "k1 long, k2 long, id long, said binary")
    found = parts.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "id").mapInArrow(hashed, "k1 long, k2 long, sha string")
    return found.select(F.struct("k1", "k2").alias("node"), F.col("sha").alias("ends_sha256"))
