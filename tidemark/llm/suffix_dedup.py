"""Exact substring removal by suffix buckets and sample ranks.

A byte goes if a string of ``length`` bytes over it starts anywhere else too. The suffixes that matter are cut into
buckets: all suffixes that reach the same repeated sample (see ``repeats``) after the same number of bytes. Samples are
a difference cover by content: two suffixes with ``length`` equal bytes have a common sample at the same distance, so
both come to one bucket with their contexts, and nothing else of the texts is needed. A fixed cover modulo v would have
the same property with about ten times as many samples.

One bucket is worked off at a time. Samples' ranks (names of their k-grams) are known before; suffixes that tie on them
are told apart by a 64-bit hash of their ``length`` bytes, each from two prefix sums, instead of by comparing bytes.
Contexts that are equal in full are sent once by each batch, with a mark that they occur twice. A bucket of more than
``LARGE`` contexts (a line that very many texts share, in differing surroundings) is not worked off as a whole: its
suffixes are dealt anew by the hash of their ``length`` bytes, and each batch sends equal ones once, so a group has at
most one of them for each batch.

NULL is an empty text. Matches never cross rows of different keys. Rows with the same key count as one document; rows
with a NULL key are kept whole and match nothing. What is kept may cut a code point; so kept bytes are binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repeats import Samples, beside, by_home, homed, merged, places, repeated_samples
from tidemark.llm.tables import sized, written
from tidemark.llm.words import Hasher, chunks, mix, pack, text_buffers, unpack

GRAM = 64
BLOCK = 2_000        # contexts that are worked on at a time
SENT = 20_000        # contexts among which equal ones are sent once
BUCKET = 10_000      # contexts that one grouping task is to hold
LARGE = 30_000       # contexts of a bucket beyond which its suffixes are dealt by their own hash
WINDOWS = 1_000_000  # suffixes among which equal ones are sent once, and that one grouping task is to hold


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept (binary)."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    left = length - GRAM        # most bytes of a window before its sample
    width = left + length

    def chunks_of(batch):
        hasher = Hasher()
        data, offsets = text_buffers(batch.column(1))
        for first, last in chunks(offsets, 1_000_000):
            part = data[offsets[first]: offsets[last]]
            bounds = offsets[first: last + 1] - offsets[first]
            sums = hasher.sums(part)
            start = np.arange(max(0, len(part) - GRAM + 1))
            yield first, bounds, Samples(hasher.ranges(sums, start, start + GRAM), bounds, length, GRAM), part

    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = written(repeated_samples(plain, lambda b: (x[:3] for x in chunks_of(b)), size * 2 // (left + 2)), "marks")
    marked = marks.agg(F.sum(F.expr("aggregate(marks, 0L, (n, b) -> n + length(b) DIV 4)"))).first()[0] or 0
    buckets = marked // BUCKET + 1

    def contexts(batches):
        hasher = Hasher(5)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks_of = places(batch.column(2))
            rows = [[] for _ in range(7)]
            for first, bounds, s, part in chunks_of(batch):
                padded = np.concatenate([np.zeros(left, np.uint8), part, np.zeros(length, np.uint8)])
                at = np.concatenate([bounds[d] + np.unique(marks_of[first + d]).astype(np.int64) for d in range(len(bounds) - 1)])
                view = np.lib.stride_tricks.sliding_window_view(padded, width)
                columns = np.arange(width) - left
                hasher.grow(width)
                # Runs of one letter make every place a sample: so in slices, whatever their number.
                for i in range(0, len(at), BLOCK):
                    here = at[i: i + BLOCK]
                    value, d = s.value[np.searchsorted(s.at, here)], s.document[here]
                    # The windows that a sample is the smallest of: from ``low`` to ``high`` bytes before it.
                    low, high = owned(s, here, value, left)
                    fits = high >= low
                    here, value, d, low, high = (x[fits] for x in (here, value, d, low, high))
                    before = np.minimum(here - bounds[d], left)
                    after = np.minimum(bounds[d + 1] - here, length)
                    content = view[here]
                    # Only what its own windows cover: so the inside of a passage looks alike wherever the passage stands.
                    content[(columns < -np.minimum(before, high)[:, None]) | (columns >= np.minimum(after, length - low)[:, None])] = 0
                    name = mix((hasher.codes[content] * hasher.power[:width]).sum(axis=1, dtype=np.uint64) ^ mix(value))
                    name = mix(name + low.astype(np.uint64) * np.uint64(1 << 20) + high.astype(np.uint64))
                    for x, y in zip(rows, (value, ids[first + d].astype(np.int64), (here - bounds[d]).astype(np.int64), low, high, content, name)):
                        x.append(y)
                    if sum(map(len, rows[0])) >= SENT:
                        yield sent(rows)
                        rows = [[] for _ in range(7)]
            if rows[0]:
                yield sent(rows)

    def sent(rows):
        value, owner, place, low, high, content, name = (np.concatenate(x) for x in rows)
        order = np.lexsort((place, owner, name))
        head = np.ones(len(order), bool)
        head[1:] = name[order][1:] != name[order][:-1]
        run = np.cumsum(head) - 1
        o, p = owner[order], place[order]
        other = np.zeros(len(order), bool)
        other[1:] = ~head[1:] & ((o[1:] != o[:-1]) | (p[1:] != p[:-1]))
        double = np.bincount(run, weights=other)[run] > 0
        # A context that occurs twice here: all its windows repeat, wherever it stands.
        twice = order[double]
        told = homed(owner[twice], np.stack([place[twice] - high[twice], place[twice] - low[twice] + length], 1), buckets)
        pick, pair = order[head], double[head]
        bucket = (value[pick] % np.uint64(buckets)).astype(np.int64)
        fixed = np.stack([value[pick].view(np.int64), owner[pick], place[pick], low[pick], high[pick], pair.astype(np.int64)], 1)
        return pa.RecordBatch.from_arrays([
            pa.array([*bucket.tolist(), *told["home"].to_pylist()], pa.int64()), pa.array([*(pack(x) for x in fixed), *told["owner"].to_pylist()], pa.binary()),
            pa.array([*(pack(x) for x in content[pick]), *[None] * told.num_rows], pa.binary()),
            pa.array([*[None] * len(pick), *told["place"].to_pylist()], pa.binary())], ["bucket", "fixed", "content", "cut"])

    def owned(s, at, value, reach):
        """For each sample the nearest and farthest window start before it of which it is the smallest."""
        low = np.full(len(at), reach + 1)
        high = np.full(len(at), -1)
        # Windows whose smallest hash is the sample's form one stretch.
        for step in range(0, len(at), 4096):
            i = at[step: step + 4096]
            begin = i[:, None] - np.arange(reach + 1)
            inside = (begin >= 0) & (begin < len(s.least))
            own = inside & (s.least[np.clip(begin, 0, max(0, len(s.least) - 1))] == value[step: step + 4096, None])
            some = own.any(axis=1)
            low[step: step + 4096] = np.where(some, own.argmax(axis=1), reach + 1)
            high[step: step + 4096] = np.where(some, reach - own[:, ::-1].argmax(axis=1), -1)
        return low, high

    def bucket_repeats(table: pa.Table) -> pa.Table:
        hasher = Hasher(11)
        owners, stretches = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        fixed = unpack(table["fixed"], np.int64).reshape(-1, 6)
        contents = unpack(table["content"], np.uint8).reshape(-1, width)
        order = np.argsort(fixed[:, 0], kind="stable")
        begin = 0
        while begin < len(order):
            # Whole groups of one sample value, up to a block or one larger group.
            end = min(begin + BLOCK, len(order))
            if end < len(order):
                whole = np.flatnonzero(np.diff(fixed[order[begin: end + 1], 0]))
                end = begin + int(whole[-1]) + 1 if len(whole) else begin + int((fixed[order[begin:], 0] == fixed[order[begin], 0]).sum())
            pick = order[begin:end]
            begin = end
            f = fixed[pick]
            owner, stretch = told(f, repeated_windows(hasher, f, contents, pick))
            owners.append(owner)
            stretches.append(stretch)
        return homed(np.concatenate(owners), np.concatenate(stretches), buckets)

    def told(f: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and maximal stretches of the windows that are hit."""
        row, far = np.nonzero(hit)
        return joined(f[row, 1], f[row, 2] - far)

    def joined(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and maximal stretches of the windows that start at ``place``."""
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + length)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner))[: len(first)] - 1
        return owner[first], np.stack([place[first], place[last] + length], 1)

    far = np.arange(left + 1)

    def names(hasher: Hasher, f: np.ndarray, content: np.ndarray) -> np.ndarray:
        """[context, distance]: hash of the window that starts so far before the sample, with sample and distance."""
        hasher.grow(width + 1)
        sums = np.zeros((len(f), width + 1), np.uint64)
        np.cumsum(hasher.codes[content] * hasher.power[:width], axis=1, out=sums[:, 1:])
        start = left - far
        h = (sums[:, start + length] - sums[:, start]) * hasher.inverse[start]
        return mix((h ^ mix(f[:, 0].astype(np.uint64))[:, None]).ravel()).reshape(h.shape) + far.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def owns(f: np.ndarray) -> np.ndarray:
        return (far >= f[:, 3:4]) & (far <= f[:, 4:5])

    def repeated_windows(hasher: Hasher, f: np.ndarray, contents: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """[context, distance]: whether the window that starts so far before the sample occurs in another place."""
        n = len(f)
        mine = owns(f)
        hit = mine & (f[:, 5:6] > 0)
        named = np.concatenate([names(hasher, f[i: i + BLOCK], contents[pick[i: i + BLOCK]]) for i in range(0, n, BLOCK)])
        step = max(1, BLOCK * len(far) // n)  # distances at a time; windows at different ones are never equal
        for j in range(0, len(far), step):
            row, distance = np.nonzero(mine[:, j: j + step])
            distance += j
            again = repeated(named[row, distance], f[row, 1], f[row, 2], f[row, 5] > 0)
            hit[row[again], distance[again]] = True
        return hit

    def repeated(name: np.ndarray, owner: np.ndarray, place: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Whether a name stands in two places or is marked by any. Copies of one place (repeated rows) are no repeat."""
        order = np.argsort(name, kind="stable")
        n, o, p = name[order], owner[order], place[order]
        same = n[1:] == n[:-1]
        run = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(n) else np.zeros(0, np.int64)
        many = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        many[run[1:][same & ((o[1:] != o[:-1]) | (p[1:] != p[:-1]))]] = True
        many[run[pair[order]]] = True
        out = np.zeros(len(name), bool)
        out[order] = many[run] if len(run) else False
        return out

    def windows(batches):
        """The suffixes of contexts, by their own hash; those found twice here are told at once."""
        hasher = Hasher(11)
        rows, held = [[] for _ in range(4)], 0
        for batch in batches:
            for fixed, content in zip(batch.column(0), batch.column(1)):
                f = np.frombuffer(fixed.as_buffer(), np.int64).reshape(-1, 6)
                c = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, width)
                for i in range(0, len(f), BLOCK):
                    g = f[i: i + BLOCK]
                    row, distance = np.nonzero(owns(g))
                    for x, y in zip(rows, (names(hasher, g, c[i: i + BLOCK])[row, distance], g[row, 1], g[row, 2] - distance, g[row, 5] > 0)):
                        x.append(y)
                    held += len(row)
                    if held >= WINDOWS:
                        yield dealt(*(np.concatenate(x) for x in rows))
                        rows, held = [[] for _ in range(4)], 0
        if held:
            yield dealt(*(np.concatenate(x) for x in rows))

    def dealt(name: np.ndarray, owner: np.ndarray, place: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
        again = repeated(name, owner, place, pair)
        direct = homed(*joined(owner[again], place[again]), buckets)
        name, one = np.unique(name, return_index=True)
        owner, place, again = owner[one], place[one], again[one]
        bucket = (name % np.uint64(groups)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = [*at[1:], len(order)]
        cut = lambda x: [pack(x[order[i:j]]) for i, j in zip(at, ends)]
        return pa.RecordBatch.from_arrays([
            pa.array([*bucket[order][at].tolist(), *direct["home"].to_pylist()], pa.int64()),
            pa.array([*cut(name), *[None] * direct.num_rows], pa.binary()),
            pa.array([*cut(owner), *direct["owner"].to_pylist()], pa.binary()),
            pa.array([*cut(place.astype(np.uint32)), *direct["place"].to_pylist()], pa.binary()),
            pa.array([*cut(again.astype(np.uint8)), *[None] * direct.num_rows], pa.binary())], ["bucket", "name", "owner", "place", "pair"])

    def window_repeats(table: pa.Table) -> pa.Table:
        name, owner, place, pair = (unpack(table[c], kind) for c, kind in (("name", np.uint64), ("owner", np.int64), ("place", np.uint32), ("pair", np.uint8)))
        again = repeated(name, owner, place, pair > 0)
        return homed(*joined(owner[again], place[again].astype(np.int64)), buckets)

    sent_rows = written(beside(plain, marks, "marks", "inner").select("id", "text", "marks").mapInArrow(
        contexts, "bucket long, fixed binary, content binary, cut binary"), "contexts")
    told_form = "home long, owner binary, place binary"
    found = sent_rows.where("content IS NULL").selectExpr("bucket AS home", "fixed AS owner", "cut AS place")
    groups_of = sent_rows.where("content IS NOT NULL").select("bucket", "fixed", "content")
    large = written(groups_of.groupBy("bucket").agg(F.expr("sum(octet_length(fixed) DIV 48)").alias("n")).where(F.col("n") > LARGE), "large")
    many = large.agg(F.sum("n")).first()[0] or 0
    if many:
        groups = many * (left + 1) // WINDOWS + 1
        few = sized(large.select("bucket"), 16)
        spread = written(groups_of.join(few, "bucket", "left_semi").select("fixed", "content").mapInArrow(
            windows, "bucket long, name binary, owner binary, place binary, pair binary"), "windows")
        found = found.union(spread.where("name IS NULL").select("bucket", "owner", "place")).union(
            spread.where("name IS NOT NULL").groupBy("bucket").applyInArrow(window_repeats, told_form))
        groups_of = groups_of.join(few, "bucket", "left_anti")
    found = found.union(groups_of.groupBy("bucket").applyInArrow(bucket_repeats, told_form))
    cuts = written(by_home(found, "cuts", lambda p: merged(p).ravel(), wide=2), "cuts")

    def remove(batches):
        for batch in batches:
            rows = []
            for t, c in zip(batch.column(1), places(batch.column(2))):
                data = np.frombuffer((t.as_py() or "").encode(), np.uint8)
                spans = c.reshape(-1, 2).astype(np.int64)
                stay = np.ones(len(data), bool)
                for i, j in spans:
                    stay[i:j] = False
                rows.append((len(data), int((~stay).sum()), len(spans), data[stay].tobytes()))
            if rows:
                n, gone, spans, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return beside(plain, cuts, "cuts").select("id", "text", "cuts").mapInArrow(
        remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", key)
