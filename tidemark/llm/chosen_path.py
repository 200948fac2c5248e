"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Every distinct shingle set has ``SKETCH`` minwise values. In each of ``trees`` independent trees all sets start at the
root; at a tree node a hash of the node's path chooses which minwise value its sets branch by, and with a chance of
``1 / J - 1`` a second one, so that a pair of similarity J stays together in one child per node on average. The path of
chosen values names the node. The first ``FIRST`` levels are taken at once from the set alone; as sets with little in
common part at once, only few nodes have more than one member then.

Nodes of up to ``LEAF`` sets are compared exhaustively. Larger ones branch ``STEP`` levels further, up to ``ROUNDS``
times, and what is still larger then is compared in bounded blocks. Before that, each set is compared with the best
centre of its nodes, the member that is most often in large company (so the original, not an edited copy), and linked
sets are merged: pairs of one component are never compared, as they cannot change the result.

A pair is compared by the minwise values first (six deviations of slack), then by the full sets. With 16 trees a link
at J = 0.85 exactly is missed in all of them with a chance of 4e-11 where nodes are small after 2 levels, 3e-6 where
they are after 6; closer pairs far less often, and a missed link matters only if no other joins the two.

NULL, empty and blank texts have no shingles, are linked with nothing and are their own component; so are rows with a
NULL key, whose component is NULL and which are kept. Nodes are sets, not keys: rows that repeat a key with other texts
link by each text; all rows stay, one output row each. Columns besides key and text are ignored, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.jaccard_join import linked, sets_of, sums_at
from tidemark.llm.tables import components, sized, written
from tidemark.llm.words import Hasher, mix, pack, unpack

SKETCH = 96   # minwise values of a set
FIRST = 2     # levels taken before nodes are counted
STEP = 4      # levels between later counts
ROUNDS = 1    # times that large nodes branch further
LEAF = 64     # sets of a node that are compared in pairs
BLOCK = 1024  # sets in a block of the comparison of nodes that stay large


def minwise(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[sets, SKETCH] smallest values of the non-empty sets hashes[first[i]: first[i + 1]]."""
    out = np.zeros((len(first) - 1, SKETCH), np.uint32)
    full = np.flatnonzero(np.diff(first))
    seeds = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    if len(full):
        for j, seed in enumerate(seeds):
            x = (hashes ^ seed) * (seed | np.uint64(1))
            x ^= x >> np.uint64(29)
            out[full, j] = np.minimum.reduceat((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32), first[:-1][full])
    return out


def branch(path: np.ndarray, row: np.ndarray, sketch: np.ndarray, again: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(path, row) of the tree nodes ``levels`` below: each row of ``sketch`` goes on from the paths it is at."""
    for _ in range(levels):
        coin = mix(path ^ np.uint64(0xA24BAED4963EE407))
        two = ((coin >> np.uint64(40)).astype(np.float64) / (1 << 24)) < again
        start = np.concatenate([path, path[two]])
        at = (np.concatenate([coin, mix(coin[two])]) % np.uint64(SKETCH)).astype(np.int64)
        row = np.concatenate([row, row[two]])
        path = mix(start + mix(at.astype(np.uint64) * np.uint64(0x100000000) + sketch[row, at]))
    return path, row


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, jaccard: str = "0.85", trees: int = 16) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links), kept."""
    ratio = Fraction(jaccard)
    p, q = ratio.numerator, ratio.denominator
    again = float(1 / ratio) - 1
    agree = int(SKETCH * float(ratio) - 6 * (SKETCH * float(ratio * (1 - ratio))) ** 0.5)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def names(hashes, first):
        one, two = sums_at(mix(hashes + np.uint64(11)), first), sums_at(mix(hashes ^ np.uint64(0xABCDEF0123)), first)
        return mix(one ^ mix(two + np.diff(first).astype(np.uint64))).view(np.int64)

    def describe(batches):
        hasher = Hasher()
        for batch in batches:
            for begin, end, hashes, first in sets_of(hasher, batch.column(1), k):
                size = np.diff(first)
                found = minwise(hashes, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(size, pa.int64()), pa.array(names(hashes, first), mask=size == 0),
                     pa.array([x.tobytes() if n else None for x, n in zip(found, size)], pa.binary())], ["id", "n", "node", "sketch"])

    info = written(plain.mapInArrow(describe, "id long, n long, node long, sketch binary"), "sets")
    nodes = info.where("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("least"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")

    def plant(batches):
        for batch in batches:
            sketch = unpack(batch.column(1), np.uint32).reshape(-1, SKETCH)
            node = batch.column(0).to_numpy()
            for tree in range(trees):
                path, row = branch(np.full(len(node), mix(np.array([tree + 1000], np.uint64))[0]), np.arange(len(node)), sketch, again, FIRST)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[row])], ["path", "node"])

    def grow(batches):
        for batch in batches:
            sketch = unpack(batch.column(2), np.uint32).reshape(-1, SKETCH)
            path, row = branch(batch.column(0).to_numpy().view(np.uint64), np.arange(len(sketch)), sketch, again, STEP)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(batch.column(1).to_numpy()[row])], ["path", "node"])

    def screen(batches):
        for batch in batches:
            x, y = (unpack(batch.column(i), np.uint32).reshape(-1, SKETCH) for i in (2, 3))
            hit = (x == y).sum(axis=1) >= agree
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit))

    def gather(batches):
        hasher = Hasher()
        for batch in batches:
            for _, _, hashes, first in sets_of(hasher, batch.column(0), k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names(hashes, first)), pa.array([pack(hashes[i:j]) for i, j in zip(first[:-1], first[1:])], pa.binary())], ["node", "items"])

    def compare(batches):
        for batch in batches:
            hit = [linked(np.frombuffer(i.as_py(), np.uint64), np.frombuffer(j.as_py(), np.uint64), p, q) for i, j in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    def sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        a = table.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
        b = table.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
        return pairs.join(a, "a").join(b, "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs (a, b)."""
        close = sides(pairs, nodes, "n", "sketch").where(F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p)
        near = written(close.select("a", "b", "sketch_a", "sketch_b").mapInArrow(screen, "a long, b long"), "near")
        wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
        sets = items_of(nodes.join(wanted, "node", "left_semi"))
        return written(sides(near, sets, "items").select("a", "b", "items_a", "items_b").mapInArrow(compare, "a long, b long"), "edges")

    def items_of(some: DataFrame) -> DataFrame:
        """node, items (sorted shingle hashes) of some of the nodes."""
        some = written(some.select("node", F.col("least").alias("id")), "wanted")
        sets = plain.join(sized(some.select("id"), 16), "id", "left_semi").select("text").mapInArrow(gather, "node long, items binary")
        return written(sets.join(sized(some.select("node"), 16), "node", "left_semi").dropDuplicates(["node"]), "items")

    def mixed(df: DataFrame) -> DataFrame:
        """Rows of the paths with more than one label."""
        both = df.groupBy("path").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        return df.join(both.select("path"), "path")

    def labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
        return df.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    ordered = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = labels = None
    rows = written(nodes.select("node", "sketch").mapInArrow(plant, "path long, node long"), "paths")
    for turn in range(ROUNDS + 1):
        counts = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        shared = rows.join(counts, "path")
        shared = mixed(labelled(shared, labels)) if labels else shared.withColumn("label", F.col("node"))
        shared = written(shared, "shared")
        company = shared.groupBy("node").agg(F.sum(F.log2("n")).alias("much"))
        met = shared.join(company, "node")
        centre = met.groupBy("path").agg(F.max(F.struct("much", "node", "label")).alias("c"))
        star = met.join(centre, "path").where("c.label <> label").groupBy("node").agg(F.max("c").alias("c"))
        star = verified(star.select(F.col("c.node").alias("a"), F.col("node").alias("b")).select(*ordered).distinct())
        edges = star if edges is None else edges.union(star)
        labels = written(components(edges), "components")
        apart = written(mixed(labelled(shared.drop("label"), labels)), "apart")
        # Small nodes: all pairs of sets that are still apart.
        small = apart.where(F.col("n") <= LEAF).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("label", "node"))).alias("x"))
        pairs = small.select(F.posexplode("x").alias("i", "m"), "x").select("m", F.explode(F.slice("x", F.col("i") + 2, LEAF)).alias("o"))
        pairs = pairs.where("m.label <> o.label").select(F.col("m.node").alias("a"), F.col("o.node").alias("b")).select(*ordered).distinct()
        edges = edges.union(verified(pairs))
        large = written(apart.where(F.col("n") > LEAF).select("path", "node"), "large")
        if not large.count():
            break
        labels = written(components(edges), "components")
        if turn < ROUNDS:
            rows = written(large.join(nodes, "node").select("path", "node", "sketch").mapInArrow(grow, "path long, node long"), "paths")
        else:
            crowd = labelled(mixed(labelled(large, labels)).select("path", "node"), labels)
            sets = items_of(nodes.join(crowd.select("node").distinct(), "node", "left_semi"))
            edges = edges.union(written(blockwise(crowd, sets, p, q), "edges"))
    final = written(components(edges), "components")
    marked = labelled(info, final)
    least = marked.where("id IS NOT NULL AND label IS NOT NULL").groupBy("label").agg(F.min("id").alias("smallest"))
    out = marked.join(least, "label", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def blockwise(large: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Links (a, b) between sets of other labels in tree nodes that stay large (path, node, label), over whole sets.

    Tree nodes that share sets are one crowd. Sets outside the crowd's largest component are compared with every block
    of the crowd, block by block, so a pair is compared once however many tree nodes it shares.
    """
    first = large.groupBy("path").agg(F.min("node").alias("a"))
    crowd = components(large.join(first, "path").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    crowd = written(crowd.select(F.col("id").alias("node"), F.col("component").alias("crowd")).join(large.select("node", "label").distinct(), "node"), "crowd")
    sizes = crowd.groupBy("crowd", "label").agg(F.count("*").alias("m")).groupBy("crowd").agg(
        F.max_by("label", F.struct("m", "label")).alias("main"), F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"))
    crowd = crowd.join(sizes, "crowd").withColumn("asks", F.col("label") != F.col("main"))
    crowd = written(crowd.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "crowd")
    asking = crowd.where("asks").select("crowd", F.col("block").alias("row")).distinct()
    outer = crowd.where("asks").select("crowd", F.col("block").alias("row"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("col"), "node", "label", F.lit(True).alias("asks"))
    inner = crowd.join(asking, "crowd").select("crowd", "row", F.col("block").alias("col"), "node", "label", F.lit(False).alias("asks"))

    def meet(table: pa.Table) -> pa.Table:
        asks = np.array(table["asks"].to_pylist(), bool)
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        items = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        size = np.array([len(x) for x in items], np.int64)
        others = np.flatnonzero(~asks)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(others):
            value = np.concatenate([items[i] for i in others])
            owner = np.repeat(np.arange(len(others)), size[others])
            order = np.argsort(value)
            value, owner = value[order], owner[order]
            for i in np.flatnonzero(asks):
                lo, hi = np.searchsorted(value, items[i], "left"), np.searchsorted(value, items[i], "right")
                n = hi - lo
                common = np.bincount(owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], minlength=len(others))
                hit = others[(common * q >= p * (size[others] + size[i] - common)) & (label[others] != label[i])]
                a.append(np.full(len(hit), node[i]))
                b.append(node[hit])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    tasks = outer.union(inner).join(sets, "node")
    return tasks.groupBy("crowd", "row", "col").applyInArrow(meet, "a long, b long")
