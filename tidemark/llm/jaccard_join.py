"""Near-duplicate documents by an exact Jaccard join on word shingles, with PartEnum signatures.

Sets of 2^(b-1) < size <= 2^b shingles are of size band b. For each band the shingle domain is cut into n parts by a
hash. A set's signatures are the contents of its non-empty parts (subsets of one part; with n parts and fewer than n
differences this is the enumeration with the fewest signatures). Linked sets of sizes s <= t differ in at most
``(s + t)(1 - J) / (1 + J)`` shingles, each of which spoils one part, so a set with more non-empty parts than that
shares a signature with every partner. Sets near the upper end of their band are also signed for the next one.

Signatures common to many sets (shared passages) are cut exactly: linked sets share at least ``spare + 1`` signatures,
so each set may leave out its ``spare`` most frequent ones and the rarest shared one stays on both sides.

What is compared: equal sets are one node. Each signature's first set is compared with its others, linked sets are
merged, and only sets that are still apart are compared further: in pairs where few share the signature, in bounded
blocks where many do.

NULL, empty and blank texts have no shingles, are linked with nothing and are their own component. Rows with a NULL
key get no component and link nothing. Repeated rows stay, one output row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import components, partitions_of, sized, written
from tidemark.llm.words import Hasher, Words, chunks, mix, pack, text_buffers, unpack

FEW = 32             # sets sharing a signature up to this number are compared in pairs
CELLS = 256          # cells of the histograms by which pairs are screened
BLOCK = 256          # sets in a block of the comparison beyond it
BUCKET = 1_500_000   # signatures that one grouping task holds


def parts_of(band: np.ndarray) -> np.ndarray:
    """Number of parts for a size band: enough that too few non-empty parts have no practical probability."""
    size = np.left_shift(np.int64(1), band.astype(np.int64))
    share = np.select([band <= 5, band == 6, band == 7, band == 8], [1, 1.0, 0.5, 0.4], 0.36)
    return np.where(band <= 5, np.int64(1) << 40, (size * share).astype(np.int64))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, first shingle of each document); short texts are one shingle."""
    hashes, document = words.windows(k)
    counts = np.diff(words.first)
    whole = document[: len(hashes)] == document[k - 1:] if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[whole], document[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            h = words.hash[words.first[d]: words.first[d + 1]]
            extra[i] = (mix(h + np.arange(len(h), dtype=np.uint64)) * np.uint64(2 * len(h) + 1)).sum(dtype=np.uint64)
        hashes, owner = np.concatenate([hashes, mix(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    for i in range(len(counts)):
        hashes[bounds[i]: bounds[i + 1]].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(len(counts) + 1))


def sets_of(hasher: Hasher, column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for first, last in chunks(offsets):
        yield first, last, *shingle_sets(Words(hasher, data, offsets, first, last, True), k)


def sums_at(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signatures(hashes: np.ndarray, first: np.ndarray, jaccard: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, its set, spare signatures of each set in its own band, and in the next)."""
    size = np.diff(first)
    band = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    found, owners, spares = [], [], []
    p, q = jaccard.numerator, jaccard.denominator
    for step in (0, 1):
        level = band + step
        top = np.left_shift(np.int64(1), level)
        # The own band is for partners up to its end; the next one is for sets that have partners beyond it.
        signed = (size > 0) & ((size * q >= p * (top // 2)) | (step == 0))
        partner = np.minimum(top, size * q // p)
        apart = (size + partner) * (q - p) // (q + p)
        count = np.where(signed, size, 0)
        use = np.repeat(signed, size)
        h, owner = hashes[use], np.repeat(np.arange(len(size)), count)
        part = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)).astype(np.int64) % parts_of(level)[owner]
        key = np.lexsort((part, owner)) if len(size) >= 1 << 22 else np.argsort((owner << np.int64(41)) | part)
        h, owner, part = h[key], owner[key], part[key]
        start = np.ones(len(h), bool)
        start[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(start)
        content = np.add.reduceat(mix(h + np.uint64(0x9FB21C651E98DF25)), at) if len(at) else np.zeros(0, np.uint64)
        sig = mix(content ^ mix(part[at].astype(np.uint64) ^ (level[owner[at]].astype(np.uint64) << np.uint64(50))))
        filled = np.bincount(owner[at], minlength=len(size))
        if (signed & (filled <= apart)).any():
            raise ValueError("too few non-empty parts for an exact join: raise the shares in parts_of")
        found.append(sig)
        owners.append(owner[at])
        spares.append(np.where(signed, filled - apart - 1, -1))
    return np.concatenate(found), np.concatenate(owners), spares[0], spares[1]


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    if min(len(a), len(b)) * q < p * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return common * q >= p * (len(a) + len(b) - common)


def histogram(hashes: np.ndarray) -> np.ndarray:
    """Shingles by cell of their hash. Two sets differ by at least as many shingles as their histograms do."""
    return np.minimum(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, jaccard: str = "0.75") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links), n_copies."""
    ratio = Fraction(jaccard)
    p, q = ratio.numerator, ratio.denominator
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def describe(batches):
        hasher = Hasher()
        for batch in batches:
            for begin, end, hashes, first in sets_of(hasher, batch.column(1), k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(np.diff(first), pa.int64()),
                     pa.array(sums_at(mix(hashes + np.uint64(11)), first).view(np.int64)),
                     pa.array(sums_at(mix(hashes ^ np.uint64(0xABCDEF0123)), first).view(np.int64))], ["id", "n", "one", "two"])

    info = written(plain.mapInArrow(describe, "id long, n long, one long, two long"), "sets")
    # Equal sets are one node, named by its smallest key.
    nodes = info.where("n > 0 AND id IS NOT NULL").groupBy("n", "one", "two").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    named = written(info.join(nodes, ["n", "one", "two"], "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"), "copies"), "nodes")
    of = named.where("node IS NOT NULL AND id <> node").select(F.col("id").alias("of"), "node").distinct()
    total = named.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions_of(docs), int(0.75 * total) // BUCKET + 1)

    def sign(batches):
        hasher = Hasher()
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            seen = set()
            for begin, _, hashes, first in sets_of(hasher, batch.column(1), k):
                # Copies within a batch are signed once. A chunk's signatures go on before the next one is hashed.
                marks = sums_at(mix(hashes + np.uint64(11)), first)
                keep = np.zeros(len(marks), bool)
                for i, m in enumerate(marks.tolist()):
                    if first[i + 1] > first[i] and not null[begin + i] and m not in seen:
                        seen.add(m)
                        keep[i] = True
                if not keep.any():
                    continue
                size = np.where(keep, np.diff(first), 0)
                hashes = hashes[np.repeat(keep, np.diff(first))]
                sig, owner, own, above = signatures(hashes, np.concatenate([[0], np.cumsum(size)]), ratio)
                owner = ids[begin + owner]
                signed = ids[begin + np.flatnonzero(keep)]
                spare = np.where(above < 0, own, np.minimum(own, above))[keep]
                bucket = ((sig >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, owner, bucket = sig[order], owner[order], bucket[order]
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*at[1:], len(sig)]
                # Besides the signatures of each bucket, one row has the spare numbers of the chunk's sets.
                home = int(mix(signed[:1].astype(np.uint64))[0] % np.uint64(buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*bucket[at], home], pa.int64()), pa.array([*(pack(sig[i:j]) for i, j in zip(at, ends)), None], pa.binary()),
                     pa.array([*(pack(owner[i:j]) for i, j in zip(at, ends)), pack(signed)], pa.binary()),
                     pa.array([*[None] * len(at), pack(spare)], pa.binary())], ["bucket", "sig", "owner", "spare"])

    def meet(table: pa.Table) -> pa.Table:
        told = table.filter(table["sig"].is_null())
        table = table.filter(table["sig"].is_valid())
        sig, owner = unpack(table["sig"], np.uint64), unpack(table["owner"], np.int64)
        order = np.argsort(sig)
        sig, owner = sig[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(sig)))
        few = (count > 1) & (count <= FEW)
        pairs, times = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for c in np.unique(count[few]):
            rows = np.sort(owner[at[few & (count == c)][:, None] + np.arange(c)], axis=1)
            i, j = np.triu_indices(c, 1)
            one, n = np.unique(np.stack([rows[:, i].ravel(), rows[:, j].ravel()], 1), axis=0, return_counts=True)
            pairs.append(one)
            times.append(n)
        pairs, times = np.concatenate(pairs), np.concatenate(times)
        many = np.repeat(count > FEW, count)
        who, spare = unpack(told["owner"], np.int64), unpack(told["spare"], np.int64)
        # (a, b, n): n signatures shared by two sets; (a, sig, n): one of n sets with it; (a, n): spare signatures.
        return pa.table({
            "a": np.concatenate([pairs[:, 0], owner[many], who]),
            "b": pa.chunked_array([pa.array(pairs[:, 1]), pa.nulls(int(many.sum()) + len(who), pa.int64())]),
            "sig": pa.chunked_array([pa.nulls(len(pairs), pa.int64()), pa.array(sig[many].view(np.int64)), pa.nulls(len(who), pa.int64())]),
            "n": np.concatenate([times, np.repeat(count, count)[many], spare])})

    met = written(
        plain.mapInArrow(sign, "bucket long, sig binary, owner binary, spare binary").groupBy("bucket")
        .applyInArrow(meet, "a long, b long, sig long, n long"), "met")

    def by_node(df: DataFrame, column: str) -> DataFrame:
        return df.join(of.withColumnRenamed("of", "__of"), F.col(column) == F.col("__of"), "left").withColumn(
            column, F.coalesce("node", column)).drop("node", "__of")

    spare = by_node(met.where("b IS NULL AND sig IS NULL").select(F.col("a").alias("id"), F.col("n").alias("spare")), "id").groupBy("id").agg(F.min("spare").alias("spare"))
    shared = by_node(met.where("sig IS NOT NULL").select("sig", F.col("a").alias("id"), F.col("n").alias("freq")), "id").distinct()
    # The spare most frequent signatures of a set decide nothing. (Of two bands the smaller spare number holds.)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("freq"), "sig"))
    shared = written(shared.join(spare, "id").select("*", place.alias("place")), "shared")
    retained = shared.where("place > spare").select("sig", "id")
    # Linked sets share more signatures than either can spare; much shared ones are counted as if all were common.
    room = spare.join(shared.groupBy("id").agg(F.count("*").alias("hot")), "id", "left").select(
        "id", F.struct(F.coalesce("hot", F.lit(0)).alias("hot"), "spare").alias("r"))
    pairs = by_node(by_node(met.where("b IS NOT NULL").select("a", "b", "n"), "a"), "b").where("a <> b").groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))
    pairs = pairs.join(room.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(
        room.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    pairs = written(pairs.where("n + least(ra.hot, rb.hot) > greatest(ra.spare, rb.spare)").select("a", "b"), "pairs")

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(retained.select("id"))
    wanted = written(ids.distinct(), "wanted")

    def gather(batches):
        hasher = Hasher()
        for batch in batches:
            for begin, end, hashes, first in sets_of(hasher, batch.column(1), k):
                parts = [hashes[i:j] for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(map(pack, parts), pa.binary()),
                     pa.array([pack(histogram(x)) for x in parts], pa.binary()), pa.array(np.diff(first), pa.int64())], ["id", "items", "cells", "size"])

    sets = written(plain.join(sized(wanted, 16), "id", "left_semi").mapInArrow(
        gather, "id long, items binary, cells binary, size long").dropDuplicates(["id"]), "items")

    def screen(batches):
        for batch in batches:
            x, y = (unpack(batch.column(i), np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (2, 3))
            hit = np.abs(x - y).sum(axis=1) * (q + p) <= batch.column(4).to_numpy() * (q - p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit))

    def compare(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            hit = [linked(np.frombuffer(i.as_py(), np.uint64), np.frombuffer(j.as_py(), np.uint64), p, q) for i, j in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    def verified(candidates: DataFrame) -> DataFrame:
        def sides(df: DataFrame, *columns: str) -> DataFrame:
            left = sets.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
            right = sets.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
            return df.join(left, "a").join(right, "b")

        near = sides(candidates, "cells", "size").select("a", "b", "cells_a", "cells_b", F.expr("size_a + size_b").alias("size"))
        near = written(near.mapInArrow(screen, "a long, b long"), "near")
        return sides(near, "items").select("a", "b", "items_a", "items_b").mapInArrow(compare, "a long, b long")

    def labelled(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(labels.withColumnsRenamed({"id": "__k", "component": "__c"}), F.col(column) == F.col("__k"), "left").withColumn(
            out, F.coalesce("__c", column)).drop("__k", "__c")

    # First round: of every set only the pair with the smallest partner that shares a signature, and with the
    # first set of each much shared one.
    star = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", "b"))
    centre = retained.groupBy("sig").agg(F.min("id").alias("a"))
    hub = retained.join(centre, "sig").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    edges = written(verified(star.union(hub).distinct()), "edges")
    labels = written(components(edges), "components")
    # Second round: pairs that are still apart.
    apart = labelled(labelled(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b")
    more = verified(apart)
    # Sets around much shared signatures that are not all linked yet, in blocks.
    crowd = components(hub)
    crowd = written(labelled(crowd.select("id", F.col("component").alias("crowd")), labels, "id", "c"), "crowd")
    mains = crowd.groupBy("crowd", "c").agg(F.count("*").alias("m")).groupBy("crowd").agg(
        F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("members"))
    crowd = crowd.join(mains.where("parts > 1"), "crowd").select(
        "id", "crowd", "c", (F.col("c") == F.col("main")).alias("inner"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
        F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK)).cast("int").alias("block"))
    # A set outside the main component is compared with every block of its crowd.
    outer = crowd.where("NOT inner").select("id", "crowd", "c", F.col("block").alias("row"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("col"), F.lit(True).alias("asks"))
    rows = written(crowd.where("NOT inner").select("crowd", F.col("block").alias("row")).distinct(), "asking")
    inner = crowd.join(rows, "crowd").select("id", "crowd", "c", "row", F.col("block").alias("col"), F.lit(False).alias("asks"))
    tasks = outer.union(inner).join(sets.select("id", "items"), "id")

    def block(table: pa.Table) -> pa.Table:
        ids, c, asks = table["id"].to_numpy(), table["c"].to_numpy(), table["asks"].to_pylist()
        items = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        mine, other = [i for i, x in enumerate(asks) if x], [i for i, x in enumerate(asks) if not x]
        a, b = [], []
        if mine and other:
            value = np.concatenate([items[i] for i in other])
            owner = np.repeat(np.arange(len(other)), [len(items[i]) for i in other])
            order = np.argsort(value)
            value, owner = value[order], owner[order]
            sizes, comps = np.array([len(items[i]) for i in other]), c[other]
            for i in mine:
                lo, hi = np.searchsorted(value, items[i], "left"), np.searchsorted(value, items[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(other))
                hit = np.flatnonzero((common * q >= p * (sizes + len(items[i]) - common)) & (comps != c[i]))
                a += [ids[i]] * len(hit)
                b += [ids[other[j]] for j in hit]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = edges.union(more).union(tasks.groupBy("crowd", "row", "col").applyInArrow(block, "a long, b long"))
    final = components(links)
    return labelled(named, final, "node", "component_id").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"))
