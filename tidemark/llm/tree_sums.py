"""Subtree totals of a forest by parallel tree contraction.

A round first rakes: every leaf's total is known, is logged and is added to its parent. It then compresses: of a node
with one child left and its parent, coins by hash decide whether the node is cut out; its child takes its place and
carries what the node would have added. Chains of n nodes so take O(log n) rounds of joins, and bushy trees fewer than
their depth. When nothing is left, the cut nodes are expanded in reverse order of the rounds: the total of a cut node is
its own sum plus what its child carried plus its child's total, which is known by then.

Each round's rows are written, so lost executors cost one round, and a parent with very many leaves is only ever a
partial sum before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import sized, written


def subtree_sums(nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``id`` and the sum of each of ``values`` (longs) over the node and all below it.

    ``nodes``: id, parent (NULL at roots; else the id of another node), values. Ids are unique and not NULL. No rows
    give no rows. A parent that is not a node gets nothing; links that form a cycle raise ValueError.
    """
    own, up = [f"own_{v}" for v in values], [f"up_{v}" for v in values]
    live = written(nodes.select("id", "parent", *[F.col(v).alias(o) for v, o in zip(values, own)],
                                *[F.lit(0).cast("long").alias(u) for u in up]), "tree")
    raked: list[DataFrame] = []
    cut: list[DataFrame] = []
    left, turn = live.count(), 0
    while left:
        kids = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"))
        marked = written(live.join(kids, F.col("id") == F.col("of"), "left").drop("of"), "marked")
        leaves = marked.where("n IS NULL")
        raked.append(leaves.select("id", *[F.col(o).alias(v) for o, v in zip(own, values)]))
        gains = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(
            F.count("*").alias("gone"), *[F.sum(F.col(o) + F.col(u)).alias(f"gain_{o}") for o, u in zip(own, up)])
        zero = F.lit(0).cast("long")
        rest = written(marked.where("n IS NOT NULL").join(gains, F.col("id") == F.col("of"), "left").select(
            "id", "parent", *[(F.col(o) + F.coalesce(f"gain_{o}", zero)).alias(o) for o in own], *up,
            (F.col("n") - F.coalesce("gone", zero)).alias("n")), "rest")

        def head(key: str) -> Column:
            return F.xxhash64(F.lit(turn), key).bitwiseAND(1) == 1

        # A cut node's parent shows tails and its child's parent (the node) heads: no two neighbours are cut at once.
        goes = (F.col("n") == 1) & F.col("parent").isNotNull() & head("id") & ~F.coalesce(head("parent"), F.lit(False))
        gone = rest.where(goes).select(F.col("id").alias("cut"), F.col("parent").alias("above"),
                                       *[F.col(c).alias(f"cut_{c}") for c in (*own, *up)])
        moved = written(rest.where(~goes).join(gone, F.col("parent") == F.col("cut"), "left"), "moved")
        cut.append(moved.where("cut IS NOT NULL").select(
            "cut", F.col("id").alias("child"), *[(F.col(f"cut_{o}") + F.col(u)).alias(v) for o, u, v in zip(own, up, values)]))
        live = moved.select("id", F.when(F.col("cut").isNull(), F.col("parent")).otherwise(F.col("above")).alias("parent"), *own, *[
            (F.col(u) + F.coalesce(F.col(f"cut_{o}") + F.col(f"cut_{u}"), zero)).alias(u) for o, u in zip(own, up)])
        turn += 1
        before, left = left, live.count()
        if left == before:
            raise ValueError("the links form a cycle")

    def all_of(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    if not raked:
        return nodes.select("id", *[F.col(v).cast("long").alias(v) for v in values])
    known = [raked.pop()]
    cut.pop()  # the last round leaves nothing to cut
    while raked:
        # What a round cut out hangs on nodes that later rounds have settled.
        logged = cut.pop()
        count = logged.count()
        if count:
            below = all_of(known).withColumnsRenamed({v: f"below_{v}" for v in values})
            near = sized(logged, 64) if count < 1 << 18 else logged
            known.append(written(near.join(below, F.col("child") == F.col("id")).select(
                F.col("cut").alias("id"), *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values]), "expanded"))
        known.append(raked.pop())
    return all_of(known)
