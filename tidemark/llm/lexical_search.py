"""Ranked lexical search over bit-sliced Bloom signatures, exact by rescoring.

Index: each document adds, for every term and every level its count reaches (1, 2, 3, 4, 6, 8, 12, ...), a key to a Bloom
signature. Documents are signed with others of about as many keys (powers of two), a block at a time, and a block is
stored in slices: bit j of slice i says whether document j has set bit i. The index also keeps document
lengths and every term's document frequency. All rows are indexed; a signature never grows with the corpus.

Search: for a block of queries and a block of documents, the slices of a term's keys are combined by AND; what is left
overestimates the documents that hold the term, and the level reached overestimates its count there. The weighted sum
over a query's terms is an upper bound of the document's score. The documents with the highest bounds are scored on
their texts; the k-th best of these is a score (and key) to beat. All documents whose bound does not fall short of it are
then scored on their texts, so the result is exact: only documents that provably rank lower are excluded.

The query set is met in blocks of bounded size. Tasks keep the k best rows a query, so no result is gathered in one task.
Equal scores rank by ascending key, NULL keys last. Rows are documents: repeated rows are ranked each, and equal rows of
queries count once. NULL and empty texts have no terms, are not counted as documents and never found; queries without
known terms find nothing. Columns besides keys and texts are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import sized, written
from tidemark.llm.words import LOWER, Hasher, chunks, mix, text_buffers

LEVELS = np.array([1, 2, 3, *(x << i for i in range(38) for x in (4, 6))], np.int64)
HASHES = 6         # bits of a key
WIDTH = 12         # slices for each key of the fullest document of a block
MOST_SLICES = 1 << 24  # beyond, signatures only overestimate more
KEYS = 1 << 20     # keys in a block of documents
TOGETHER = 512     # documents whose bounds are computed at once
QUERIES = 256      # queries in a block
QUERY_BYTES = 4_000_000

IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Index:
    """blocks: ids, digests, sizes (of the documents of a block), band, bits; terms: term, df; totals over documents."""

    blocks: DataFrame
    terms: DataFrame
    n_documents: int
    n_terms: int


def terms_of(hasher: Hasher, data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the terms, first term of each) of documents first..last; ASCII letters are lower-cased."""
    at = offsets[first: last + 1] - offsets[first]
    data = data[offsets[first]: offsets[last]]
    inner = IN_TERM[data]
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    ends[:-1] &= ~inner[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inner[edge]
    ends[edge - 1] = inner[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return hasher.ranges(hasher.sums(LOWER[data]), start, end), np.searchsorted(start, at)


def counted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms of each document, sorted; their counts; first of each document)."""
    hashes = hashes.copy()
    for i, j in zip(first[:-1], first[1:]):
        hashes[i:j].sort()
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(at, first)


def slices_of(keys: np.ndarray, n: int) -> np.ndarray:
    """[keys, HASHES] slices of each key in a signature of n slices."""
    steps = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(keys[:, None] + steps) % np.uint64(n)).astype(np.int64)


def key_of(terms: np.ndarray, level) -> np.ndarray:
    return mix(terms ^ mix(np.atleast_1d(level).astype(np.uint64) + np.uint64(0x51ED27)))


def width_of(band: int) -> int:
    return min(WIDTH << band, MOST_SLICES)


def signed(owner: np.ndarray, keys: np.ndarray, n: int, band: int) -> bytes:
    """The slices of n documents, each a whole number of bytes."""
    slices = width_of(band)
    bits = np.zeros((slices, -(-n // 8) * 8), bool)
    for lo in range(0, len(keys), 1 << 18):
        at = slices_of(keys[lo: lo + (1 << 18)], slices)
        bits[at.ravel(), np.repeat(owner[lo: lo + (1 << 18)], HASHES)] = True
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


INDEX = "term long, df long, ids array<long>, digests array<long>, sizes array<long>, band int, bits binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    body = F.col(text).cast("string")
    plain = docs.select(F.col(key).cast("long"), F.xxhash64(body), body)
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int32(), pa.binary()]
    names = [x.split()[0] for x in INDEX.split(", ")]

    def sign(batches):
        hasher = Hasher()

        def block(band, parts):
            ids, digests, sizes, counts, keys = (np.concatenate(x) if i else sum(x, []) for i, x in enumerate(zip(*parts)))
            bits = signed(np.repeat(np.arange(len(ids)), counts), keys, len(ids), band)
            row = [[None], [None], [ids], [digests.tolist()], [sizes.tolist()], [band], [bits]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            seen, open_blocks, filled = [], {}, {}
            for begin, end in chunks(offsets):
                hashes, first = terms_of(hasher, data, offsets, begin, end)
                size = np.diff(first)
                terms, tf, at = counted(hashes, first)
                seen.append(terms)
                reached = np.searchsorted(LEVELS, tf, "right")
                keys = key_of(np.repeat(terms, reached), np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached))
                key_at = np.concatenate([[0], np.cumsum(reached)])[at]
                n_keys = np.diff(key_at)
                bands = np.ceil(np.log2(np.maximum(n_keys, 1))).astype(np.int64)
                ids = batch.column(0).slice(begin, end - begin).to_pylist()
                digests = batch.column(1).slice(begin, end - begin).to_numpy()
                for band in np.unique(bands[size > 0]).tolist():
                    mine = np.flatnonzero((bands == band) & (size > 0))
                    for part in np.array_split(mine, -(-int(n_keys[mine].sum()) // KEYS)):
                        if not len(part):
                            continue
                        open_blocks.setdefault(band, []).append(([ids[i] for i in part], digests[part], size[part], n_keys[part],
                                                                 np.concatenate([keys[key_at[i]: key_at[i + 1]] for i in part])))
                        filled[band] = filled.get(band, 0) + int(n_keys[part].sum())
                        if filled[band] >= KEYS:
                            yield block(band, open_blocks.pop(band))
                            filled[band] = 0
            for band, parts in open_blocks.items():
                yield block(band, parts)
            if seen:
                terms, df = np.unique(np.concatenate(seen), return_counts=True)
                rest = [pa.nulls(len(terms), t) for t in kinds[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64)), *rest], names)

    table = written(plain.mapInArrow(sign, INDEX), "index")
    blocks = table.where("bits IS NOT NULL").drop("term", "df")
    totals = blocks.agg(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))).first()
    terms = table.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(blocks, written(terms, "terms"), totals[0] or 0, totals[1] or 0)


def search(index: Index, docs: DataFrame, queries: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text",
           query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """query key, rank (from 1), key, score of the ``top`` best documents of each query, scores above 0."""
    body = F.col(query_text).cast("string")
    asked = written(queries.select(F.col(query_key).cast("long").alias("query"), body.alias("text")).where("text IS NOT NULL").distinct(), "queries")
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // QUERIES), -(-size // QUERY_BYTES))
    found = []
    for block in range(n):
        rows = asked.where(F.pmod(F.xxhash64("query", "text"), F.lit(n)) == block).orderBy("query", "text").toArrow()
        found.append(_search_block(index, docs, rows, top, key, text))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("query", query_key)


def _search_block(index: Index, docs: DataFrame, queries: pa.Table, top: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    data, offsets = text_buffers(queries["text"])
    terms, times, first = counted(*terms_of(Hasher(), data, offsets, 0, len(queries)))
    wanted = np.unique(terms)
    near = spark.createDataFrame(pa.table({"term": wanted.view(np.int64)}), "term long")
    known = index.terms.join(sized(near, 8), "term").toArrow()
    df = dict(zip(known["term"].to_pylist(), known["df"].to_pylist()))
    n, total = index.n_documents, max(index.n_terms, 1)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    vocabulary = np.sort(np.array([t for t, w in weight.items() if w > 0], np.int64).view(np.uint64))
    weights = np.array([weight[t] for t in vocabulary.view(np.int64).tolist()], np.int64)
    place = np.searchsorted(vocabulary, terms)
    is_known = np.isin(terms, vocabulary)
    # For each query its terms as places in the vocabulary, and their repeats.
    asks = [(place[i:j][is_known[i:j]], times[i:j][is_known[i:j]]) for i, j in zip(first[:-1], first[1:])]

    def impact(tf, m):
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def norm(sizes):
        return 75 + (25 * sizes * n) // total

    def bounds(batches):
        """(ids, digests, [queries, documents] upper bounds) of up to TOGETHER documents."""
        grid = np.zeros((len(vocabulary), TOGETHER))
        for batch in batches:
            for ids, digests, sizes, band, bits in zip(*(batch.column(i) for i in range(5))):
                ids, digests, sizes = ids.as_py(), np.array(digests.as_py()), np.array(sizes.as_py(), np.int64)
                slices = width_of(band.as_py())
                bits = np.frombuffer(bits.as_buffer(), np.uint8).reshape(slices, -1)
                at = [slices_of(key_of(vocabulary, 0), slices)]
                for lo in range(0, len(ids), TOGETHER):
                    part = bits[:, lo // 8: (lo + TOGETHER) // 8]
                    size = sizes[lo: lo + TOGETHER]
                    held = part[at[0][:, 0]]
                    for i in range(1, HASHES):
                        held = held & part[at[0][:, i]]
                    t, d = np.nonzero(np.unpackbits(held, axis=1, count=len(size), bitorder="little"))
                    level = np.ones(len(t), np.int64)
                    still = np.arange(len(t))
                    while len(still):
                        j = int(level[still[0]])
                        if len(at) <= j:
                            at.append(slices_of(key_of(vocabulary, j), slices))
                        x, y = t[still], d[still]
                        ok = np.ones(len(still), bool)
                        for i in range(HASHES):
                            ok &= (part[at[j][x, i], y >> 3] >> (y & 7).astype(np.uint8) & 1).astype(bool)
                        still = still[ok]
                        level[still] += 1
                    tf = np.minimum(LEVELS[level] - 1, size[d])
                    grid[t, d] = weights[t] * impact(tf, norm(size)[d])
                    out = np.stack([times @ grid[places, : len(size)] for places, times in asks]) if asks else np.zeros((0, len(size)))
                    grid[t, d] = 0
                    yield ids[lo: lo + TOGETHER], digests[lo: lo + TOGETHER], out

    def promising(batches):
        """The ``top`` highest bounds of each query in the partition."""
        kept = None
        for ids, digests, bound in bounds(batches):
            index_of = np.arange(len(ids))
            near = np.argpartition(-bound, top, axis=1)[:, :top] if len(ids) > top else np.broadcast_to(index_of, bound.shape)
            new = np.take_along_axis(bound, near, 1), np.array([x is None for x in ids])[near], np.array([x or 0 for x in ids])[near], digests[near]
            kept = new if kept is None else tuple(np.concatenate([a, b], axis=1) for a, b in zip(kept, new))
            if kept[0].shape[1] > 4 * top:
                best = np.argpartition(-kept[0], top, axis=1)[:, :top]
                kept = tuple(np.take_along_axis(x, best, 1) for x in kept)
        if kept is not None:
            if kept[0].shape[1] > top:
                best = np.argpartition(-kept[0], top, axis=1)[:, :top]
                kept = tuple(np.take_along_axis(x, best, 1) for x in kept)
            q, c = np.nonzero(kept[0] > 0)
            bound, null, ids, digests = (x[q, c] for x in kept)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(bound), pa.array(ids, pa.int64(), mask=null), pa.array(digests)],
                                             ["q", "bound", "id", "digest"])

    slim = index.blocks.select("ids", "digests", "sizes", "band", "bits")
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "id", "digest")
    probe = slim.mapInArrow(promising, "q int, bound double, id long, digest long").withColumn("r", F.row_number().over(best)).where(F.col("r") <= top)
    probe = written(probe.groupBy("id", "digest").agg(F.collect_set("q").alias("asked")), "probe")
    body = F.col(text).cast("string")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(body).alias("digest"), body.alias("text"))

    def scored(batches):
        """The ``top`` best rows of each query in the partition, scored on whole texts."""
        hasher = Hasher()
        kept = [np.zeros(0, np.int64)] * 4
        line = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            asked = batch.column(2)
            q, score, doc = [], [], []
            for begin, end in chunks(offsets):
                hashes, first = terms_of(hasher, data, offsets, begin, end)
                m = norm(np.diff(first))
                words, tf, at = counted(hashes, first)
                for i in range(end - begin):
                    mine = words[at[i]: at[i + 1]]
                    spot = np.minimum(np.searchsorted(vocabulary, mine), max(len(vocabulary) - 1, 0))
                    hit = vocabulary[spot] == mine if len(vocabulary) else np.zeros(len(mine), bool)
                    spot = spot[hit]
                    line[spot] = weights[spot] * impact(tf[at[i]: at[i + 1]][hit].astype(np.int64), m[i])
                    for x in asked[begin + i].as_py():
                        places, times = asks[x]
                        q.append(x)
                        score.append(int(times @ line[places]))
                        doc.append(begin + i)
                    line[spot] = 0
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)[doc] if doc else np.zeros(0, bool)
            ids = batch.column(0).fill_null(0).to_numpy()[doc] if doc else np.zeros(0, np.int64)
            new = [np.array(q, np.int64), np.array(score, np.int64), null.astype(np.int64), ids]
            kept = [np.concatenate([a, b[new[1] > 0]]) for a, b in zip(kept, new)]
            order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
            kept = [x[order] for x in kept]
            start = np.searchsorted(kept[0], kept[0], "left")
            kept = [x[np.arange(len(start)) - start < top] for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[1]), pa.array(kept[3], mask=kept[2] > 0)], ["q", "score", "id"])

    def exact(wanted: DataFrame) -> DataFrame:
        wanted = wanted.withColumnsRenamed({"id": "__id", "digest": "__digest"})
        met = texts.join(sized(wanted, 256), (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("__id")))
        ranked = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        rows = met.select("id", "text", "asked").mapInArrow(scored, "q int, score long, id long")
        return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    first_best = exact(probe).where(F.col("rank") == top).select("q", "score", "id").collect()
    beat = np.zeros(len(asks))
    beat_id = np.full(len(asks), -1.0)  # no key: a bound must be above 0
    for q, score, doc in first_best:
        beat[q], beat_id[q] = score, np.inf if doc is None else doc

    def possible(batches):
        """Documents that may be among the best, each with its queries."""
        for ids, digests, bound in bounds(batches):
            order = np.array([np.inf if x is None else x for x in ids], float)
            open_ = (bound > beat[:, None]) | ((bound == beat[:, None]) & (bound > 0) & (order[None, :] <= beat_id[:, None]))
            some = np.flatnonzero(open_.any(axis=0))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in some], pa.int64()), pa.array(digests[some]),
                     pa.array([np.flatnonzero(open_[:, i]).tolist() for i in some], pa.list_(pa.int32()))], ["id", "digest", "asked"])

    candidates = written(slim.mapInArrow(possible, "id long, digest long, asked array<int>").dropDuplicates(["id", "digest"]), "candidates")
    names = spark.createDataFrame(pa.table({"q": pa.array(range(len(queries)), pa.int32()), "query": queries["query"]}), "q int, query long")
    return exact(candidates).join(F.broadcast(names), "q").select("query", "rank", F.col("id").alias(key), "score")
