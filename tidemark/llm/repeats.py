"""Repeated passages: samples that every long repeat must share, found over all documents.

Of every window of L units (words or bytes) the k-gram with the smallest hash is a sample. Equal windows have equal
samples at equal places, so a window can only be repeated if its sample is. Samples are far fewer than windows; they
are grouped by value over all documents, and only the windows of repeated samples are looked at further.

A batch sends each sample value once, so a value's group has at most one member for each batch, however common it is.
Rows with the same key count as one document; rows with a NULL key have no samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import BROADCAST_BYTES
from tidemark.llm.words import mix, pack, unpack

BUCKET = 500_000  # samples that one grouping task holds


def sliding(x: np.ndarray, w: int, best: Callable) -> np.ndarray:
    """best of x[i: i + w] for every i, by doubling."""
    done = 1
    while done * 2 <= w:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (w - done)], x[w - done:]) if w > done else x


class Samples:
    """Samples of a chunk: ``least`` is each window's smallest hash, ``at`` the places of the samples."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, length: int, k: int):
        """hashes: of the k-gram at each place; bounds: first unit of each document, and the end."""
        w = length - k + 1
        self.document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        n = max(0, int(bounds[-1]) - length + 1)
        self.valid = np.arange(n) + length <= bounds[1:][self.document[:n]]
        self.least, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n:
            self.least = np.where(self.valid, sliding(hashes[: n + w - 1], w, np.minimum), np.uint64(0))
            edge = np.zeros(w - 1, np.uint64)
            most = sliding(np.concatenate([edge, self.least, edge]), w, np.maximum)
            self.at = np.flatnonzero((most == hashes[: len(most)]) & (most > 0))
        self.value = hashes[self.at]


def repeated_samples(docs: DataFrame, chunks_of: Callable[[pa.RecordBatch], Iterator], samples: int) -> DataFrame:
    """id, marks (list of packed uint32 places within the document, each list sorted), of documents with repeated samples.

    ``docs``: id, text. ``chunks_of`` gives (first document, bounds, Samples) for a batch. ``samples``: about how many.
    """
    buckets = samples // BUCKET + 1

    def send(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            value, owner, place = [], [], []
            for first, bounds, s in chunks_of(batch):
                d = s.document[s.at]
                keep = ~null[first + d]
                value.append(s.value[keep])
                owner.append(ids[first + d[keep]])
                place.append((s.at - bounds[d])[keep].astype(np.uint32))
            if not value:
                continue
            value, owner, place = np.concatenate(value), np.concatenate(owner), np.concatenate(place)
            order = np.lexsort((place, owner, value))
            value, owner, place = value[order], owner[order], place[order]
            head = np.ones(len(value), bool)
            head[1:] = value[1:] != value[:-1]
            run = np.cumsum(head) - 1
            other = np.ones(len(value), bool)  # not the same place again
            other[1:] = head[1:] | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
            twice = np.bincount(run[other], minlength=run[-1] + 1 if len(run) else 0)[run] > 1 if len(run) else np.zeros(0, bool)
            direct = homed(owner[twice], place[twice], buckets)
            value, owner, place = value[head], owner[head], place[head]
            bucket = ((value >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            value, owner, place, bucket = value[order], owner[order], place[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*at[1:], len(value)]
            yield pa.RecordBatch.from_arrays([
                pa.array([*bucket[at].tolist(), *direct["home"].to_pylist()], pa.int64()),
                pa.array([*(pack(value[i:j]) for i, j in zip(at, ends)), *[None] * direct.num_rows], pa.binary()),
                pa.array([*(pack(owner[i:j]) for i, j in zip(at, ends)), *direct["owner"].to_pylist()], pa.binary()),
                pa.array([*(pack(place[i:j]) for i, j in zip(at, ends)), *direct["place"].to_pylist()], pa.binary())],
                ["bucket", "value", "owner", "place"])

    def meet(table: pa.Table) -> pa.Table:
        told = unhomed(table.filter(table["value"].is_null()))
        table = table.filter(table["value"].is_valid())
        value, owner, place = unpack(table["value"], np.uint64), unpack(table["owner"], np.int64), unpack(table["place"], np.uint32)
        order = np.lexsort((place, owner, value))
        value, owner, place = value[order], owner[order], place[order]
        same = value[1:] == value[:-1]
        other = same & ((owner[1:] != owner[:-1]) | (place[1:] != place[:-1]))
        run = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(value) else np.zeros(0, np.int64)
        many = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        many[run[1:][other]] = True
        hit = many[run] if len(run) else np.zeros(0, bool)
        return homed(np.concatenate([owner[hit], told[0]]), np.concatenate([place[hit], told[1]]), buckets)

    return by_home(docs.mapInArrow(send, "bucket long, value binary, owner binary, place binary").groupBy("bucket").applyInArrow(
        meet, "home long, owner binary, place binary"), "marks")


def homed(owner: np.ndarray, place: np.ndarray, homes: int) -> pa.Table:
    """(document, place) pairs, packed into a row for each home of documents. A place is a number or a pair of them."""
    home = (mix(owner.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    owner, place, home = owner[order], place[order], home[order]
    at = np.flatnonzero(np.diff(home, prepend=-1))
    ends = [*at[1:], len(home)]
    return pa.table({"home": pa.array(home[at], pa.int64()), "owner": pa.array([pack(owner[i:j].astype(np.int64)) for i, j in zip(at, ends)], pa.binary()),
                     "place": pa.array([pack(place[i:j].astype(np.uint32)) for i, j in zip(at, ends)], pa.binary())})


def unhomed(table: pa.Table, wide: int = 1) -> tuple[np.ndarray, np.ndarray]:
    place = unpack(table["place"], np.uint32)
    return unpack(table["owner"], np.int64), place.reshape(-1, wide) if wide > 1 else place


def by_home(rows: DataFrame, name: str, finish: Callable[[np.ndarray], np.ndarray] | None = None, wide: int = 1) -> DataFrame:
    """One row for each document: id and its places, as a list of one packed array."""

    def settle(table: pa.Table) -> pa.Table:
        found = by_document(*unhomed(table, wide))
        return pa.table({"id": pa.array([f[0] for f in found], pa.int64()),
                         name: pa.array([[pack((finish(f[1]) if finish else f[1]).astype(np.uint32))] for f in found], pa.list_(pa.binary()))})

    return rows.groupBy("home").applyInArrow(settle, f"id long, {name} array<binary>")


def by_document(owner: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """(document, its values …), values sorted by the first array or its first column."""
    order = np.lexsort((values[0] if values[0].ndim == 1 else values[0][:, 0], owner))
    owner, values = owner[order], [v[order] for v in values]
    at = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1)) if len(owner) else np.zeros(0, np.int64)
    return [(int(owner[i]), *(v[i:j] for v in values)) for i, j in zip(at, [*at[1:], len(owner)])]


def places(column, dtype=np.uint32) -> list[np.ndarray]:
    """The places of each row of a list<binary> column."""
    return [np.frombuffer(b"".join(x.as_py() or ()), dtype) for x in column]


def beside(docs: DataFrame, extra: DataFrame, column: str, how: str = "left") -> DataFrame:
    """docs joined with a written table of id and a list of binaries; broadcast if its measured bytes allow it."""
    total = extra.agg(F.sum(F.expr(f"aggregate({column}, 40L, (n, b) -> n + length(b) + 16)"))).first()[0] or 0
    extra = extra.withColumnRenamed("id", "__id")
    return docs.join(F.broadcast(extra) if total <= BROADCAST_BYTES else extra, F.col("id") == F.col("__id"), how).drop("__id")


def runs(places: np.ndarray, length: int) -> np.ndarray:
    """Flat array of (start, end) of the maximal stretches covered by [p, p + length) for sorted places."""
    if not len(places):
        return np.zeros(0, np.uint32)
    p = places.astype(np.int64)
    new = np.flatnonzero(np.diff(p) > length) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(p)]]) - 1
    return np.stack([p[first], p[last] + length], 1).ravel().astype(np.uint32)


def merged(stretches: np.ndarray) -> np.ndarray:
    """Maximal stretches of a flat array of (start, end)."""
    s = stretches.reshape(-1, 2).astype(np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    if not len(s):
        return s
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    return np.stack([s[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(s)) - 1]], 1)

