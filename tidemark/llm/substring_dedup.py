"""Substring dedup by words: prefix-partitioned suffix trees over the suffixes that can repeat.

A suffix is a document's words from one place on. Suffixes whose first ``window`` words hold no repeated sample (see
``repeats``) are leaves above that depth and are left out. The others are split by a prefix of their words: one word,
or four where the first word is so frequent that its suffixes would not fit a group; counts of first words come from
all documents. Each group's suffixes are sorted by 128 bits of hash of their first ``window`` words, which lays its
subtrees side by side; the runs are the internal nodes at that depth, and all but the first leaf of each are repeats.
Suffixes that repeat within a batch are settled there, so a suffix comes to its group at most once for each batch.

A document's NULL text has no words. Rows with the same key count as one document. Rows with a NULL key are kept whole
and match nothing. Texts of fewer than ``window`` words are kept whole; kept words are joined by one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repeats import Samples, beside, by_home, homed, places, repeated_samples, runs, unhomed
from tidemark.llm.tables import written
from tidemark.llm.words import Hasher, Words, chunks, mix, pack, text_buffers, unpack

GRAM = 8
FIRST = 4096         # bins of first words
GROUP = 250_000    # suffixes that a group is to hold


def gram_hashes(words: Words, k: int) -> np.ndarray:
    h, _ = words.windows(k)
    return h


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_text, and the columns named in ``keep``."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def chunks_of(batch, column=1):
        hasher = Hasher()
        data, offsets = text_buffers(batch.column(column))
        for first, last in chunks(offsets):
            words = Words(hasher, data, offsets, first, last, False)
            yield first, words.first, Samples(gram_hashes(words, GRAM), words.first, window, GRAM), words

    def count_first(batches):
        counts = np.zeros(FIRST, np.int64)
        for batch in batches:
            for _, _, _, words in chunks_of(batch):
                counts += np.bincount((words.hash >> np.uint64(9)).astype(np.int64) % FIRST, minlength=FIRST)
        yield pa.RecordBatch.from_arrays([pa.array(range(FIRST)), pa.array(counts)], ["bin", "n"])

    firsts = np.zeros(FIRST, np.int64)
    for r in plain.mapInArrow(count_first, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        firsts[r["bin"]] = r["n"] or 0
    total = int(firsts.sum())
    marks = written(repeated_samples(plain, lambda b: (x[:3] for x in chunks_of(b)), total // 6), "marks")
    share = GROUP
    homes = total // 4 // GROUP + 1
    parts = np.maximum(1, -(-firsts // 4 // share))        # groups of each bin of first words
    base = np.concatenate([[0], np.cumsum(parts)[:-1]])
    light = np.flatnonzero(parts == 1)
    # Light bins share groups.
    base[light] = int(parts.sum()) + light % max(1, int(firsts[light].sum() // 4 // share) + 1)

    def suffixes(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marked = places(batch.column(2))
            rows = [[] for _ in range(5)]
            for first, bounds, s, words in chunks_of(batch):
                at = np.concatenate([bounds[d] + marked[first + d].astype(np.int64) for d in range(len(bounds) - 1)]) if len(bounds) > 1 else np.zeros(0, np.int64)
                # Windows whose smallest sample is marked: samples are compared by (document, value).
                hit = np.zeros(len(s.least), bool)
                value = mix(s.least ^ mix(s.document[: len(s.least)].astype(np.uint64)))
                known = np.unique(mix(gram_hashes(words, GRAM)[at] ^ mix(s.document[at].astype(np.uint64)))) if len(at) else np.zeros(0, np.uint64)
                if len(known):
                    spot = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    hit = (known[spot] == value) & s.valid
                i = np.flatnonzero(hit)
                one, _ = words.windows(window)
                extra = np.zeros(len(i), np.uint64)
                for j in range(window):
                    extra = mix(extra + words.hash[i + j])
                start = (words.hash[i] >> np.uint64(9)).astype(np.int64) % FIRST
                four = mix(words.hash[i] + words.hash[i + 1] * np.uint64(3) + words.hash[i + 2] * np.uint64(5) + words.hash[i + 3] * np.uint64(7))
                group = base[start] + (four % parts[start].astype(np.uint64)).astype(np.int64)
                d = s.document[i]
                for x, y in zip(rows, (one[i], extra, ids[first + d].astype(np.int64), (i - bounds[d]).astype(np.uint32), group)):
                    x.append(y)
            if not rows[0]:
                continue
            one, two, owner, place, group = (np.concatenate(x) for x in rows)
            order = np.lexsort((place, owner, two, one))
            one, two, owner, place, group = (x[order] for x in (one, two, owner, place, group))
            again = np.zeros(len(one), bool)
            again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            told = homed(*later(again, owner, place), homes)
            one, two, owner, place, group = (x[~again] for x in (one, two, owner, place, group))
            order = np.argsort(group, kind="stable")
            one, two, owner, place, group = (x[order] for x in (one, two, owner, place, group))
            at = np.flatnonzero(np.diff(group, prepend=-1))
            ends = [*at[1:], len(group)]
            column = lambda x: [pack(x[i:j]) for i, j in zip(at, ends)]
            yield pa.RecordBatch.from_arrays([
                pa.array([*group[at].tolist(), *told["home"].to_pylist()], pa.int64()),
                pa.array([*column(one), *[None] * told.num_rows], pa.binary()), pa.array([*column(two), *[None] * told.num_rows], pa.binary()),
                pa.array([*column(owner), *told["owner"].to_pylist()], pa.binary()), pa.array([*column(place), *told["place"].to_pylist()], pa.binary())],
                ["group", "one", "two", "owner", "place"])

    def later(again, owner, place):
        """The repeats of runs, without those at the very place of their run's first."""
        run = np.maximum.accumulate(np.where(again, 0, np.arange(len(again)))) if len(again) else np.zeros(0, np.int64)
        other = again & ((owner != owner[run]) | (place != place[run]))
        return owner[other], place[other]

    def subtrees(table: pa.Table) -> pa.Table:
        told = unhomed(table.filter(table["one"].is_null()))
        table = table.filter(table["one"].is_valid())
        one, two = unpack(table["one"], np.uint64), unpack(table["two"], np.uint64)
        owner, place = unpack(table["owner"], np.int64), unpack(table["place"], np.uint32)
        order = np.lexsort((place, owner, two, one))
        one, two, owner, place = one[order], two[order], owner[order], place[order]
        again = np.zeros(len(one), bool)
        again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        more = later(again, owner, place)
        return homed(np.concatenate([more[0], told[0]]), np.concatenate([more[1], told[1]]), homes)

    # Nearly every document has some repeated sample, so this join is a shuffle at any size.
    found = plain.join(marks.hint("merge").withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).select("id", "text", "marks").mapInArrow(
        suffixes, "group long, one binary, two binary, owner binary, place binary").groupBy("group").applyInArrow(
        subtrees, "home long, owner binary, place binary")
    cuts = written(by_home(found, "cuts", lambda p: runs(np.unique(p), window)), "cuts")

    def remove(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for t, c in zip(batch.column("text"), places(batch.column("cuts"))):
                words = (t.as_py() or "").encode().split()
                left = words
                if len(c):
                    keep_word = np.ones(len(words), bool)
                    for i, j in c.reshape(-1, 2):
                        keep_word[i:j] = False
                    left = [words[i] for i in np.flatnonzero(keep_word)]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            fields = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(fields, ["row", "n_words", "n_removed", "kept_text"])

    wide = docs.select(F.col(key).cast("long").alias("id"), F.struct(F.col(key), *keep).alias("row"), F.col(text).alias("text"))
    schema = wide.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return beside(wide, cuts, "cuts").select("row", "text", "cuts").mapInArrow(remove, schema).select("row.*", "n_words", "n_removed", "kept_text")
