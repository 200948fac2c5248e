"""Packing token sequences: shortest-pack-first over the histogram of piece lengths.

Documents are cut every ``limit`` ids; so all pieces but a document's last are full. The histogram has at most
``limit`` bins, whatever the number of documents. From the longest length to the shortest, each bin's pieces go to the
packing patterns with most room left (the shortest packs), as many at once as pattern and bin allow; where none has room,
new patterns begin. Pieces are then joined back by their rank among those of their length.

Ids are those that the tokenizer gives for the whole text, as its pre-tokenizer never looks across white space: each
distinct word of a task is encoded once. NULL and empty texts are the end id alone. Repeated rows stay, each packed for
itself.
"""

from __future__ import annotations

import heapq
import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import written
from tidemark.llm.words import Hasher, Words, chunks, text_buffers

END = 2
MEMORY = 1 << 21   # words whose ids a task remembers
SALT_ROWS = 50_000  # pieces of one length that one task ranks


class WordIds:
    """Token ids of words, in one flat array. Remembers a bounded number of words by their hashes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Words that differ in case only have the same ids if the tokenizer lower-cases what it reads.
        self.lower = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str()).get("normalizer"))
        self.clear()

    def clear(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and each word's number
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)   # ids of word i: first[i], first[i + 1]

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; number of ids of each word)."""
        hashes, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.hash) + len(hashes) > MEMORY:
            self.clear()
        spot = np.searchsorted(self.hash, hashes)
        fresh = np.ones(len(hashes), bool)
        inside = spot < len(self.hash)
        fresh[inside] = self.hash[spot[inside]] != hashes[inside]
        if fresh.any():
            # One thread: the other cores have tasks of their own.
            data = words.bytes.tobytes()
            texts = [data[i:j].decode("utf-8", "replace") for i, j in zip(words.start[at[fresh]].tolist(), words.end[at[fresh]].tolist())]
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            sizes = np.array([len(x) for x in found], np.int64)
            number = len(self.first) - 1 + np.arange(len(found))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            self.place = np.insert(self.place, spot[fresh], number)
            self.hash = np.insert(self.hash, spot[fresh], hashes[fresh])
        word = self.place[np.searchsorted(self.hash, hashes)][inverse]
        size = self.first[word + 1] - self.first[word]
        end = np.cumsum(size)
        return self.ids[np.repeat(self.first[word] - (end - size), size) + np.arange(int(size.sum()))], size


def pack_histogram(counts: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in them) for all pieces of a length histogram."""
    packs: list[tuple[int, int, int, list[int]]] = []  # heap by least room taken: (-room, order, number, lengths)
    order = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, _, number, lengths = heapq.heappop(packs)
                used = min(number, left)
                order += 2
                heapq.heappush(packs, (room + length, order, used, [*lengths, length]))
                if used < number:
                    heapq.heappush(packs, (room, order + 1, number - used, lengths))
            else:
                each = limit // length
                # As many of this length together as fit, before the rest begins one more pattern.
                used, size = (left // each, each) if left >= each else (1, left)
                order += 1
                heapq.heappush(packs, (-(limit - size * length), order, used, [length] * size))
                left -= used * size
                continue
            left -= used
    return [(number, lengths) for _, _, number, lengths in sorted(packs, key=lambda p: p[1])]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def cut(batches):
        ids_of, hasher = WordIds(tokenizer), Hasher()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for begin, end in chunks(offsets):
                words = Words(hasher, data, offsets, begin, end, ids_of.lower)
                ids, size = ids_of(words)
                bounds = np.concatenate([[0], np.cumsum(size)])[words.first]
                rows = []
                for i in range(end - begin):
                    mine = np.append(ids[bounds[i]: bounds[i + 1]], np.uint32(END)).astype("<u4")
                    for start in range(0, len(mine), limit):
                        part = mine[start: start + limit]
                        rows.append((begin + i, start, len(part), zlib.crc32(part.tobytes()), len(mine)))
                at, start, length, crc, total = (pa.array(x, pa.int64()) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), start, length, crc, total], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    pieces = written(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        cut, "key long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``limit`` rows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    given = dict.fromkeys(histogram, 0)
    sequence = 0
    for number, lengths in pack_histogram(histogram, limit):
        at = 0
        for length in lengths:
            # Ranks given[length] and on of this length go to the packs of this pattern, at this offset.
            slots.setdefault(length, []).append((given[length], sequence, at))
            given[length] += number
            at += length
        sequence += number
    places = docs.sparkSession.createDataFrame(
        pa.table({"size": pa.array(list(slots), pa.int64()), **{n: pa.array([[s[i] for s in x] for x in slots.values()], pa.list_(pa.int64()))
                                                               for i, n in enumerate(("ranks", "sequences", "offsets"))}}))
    salts = max(1, max(histogram.values(), default=0) // SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "start", "ids_crc32"), F.lit(salts)))
    ahead = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        F.col("length").alias("l"), F.col("salt").alias("s"),
        F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "start")) - 1
    ranked = salted.withColumn("number", number).join(ahead, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn(
        "rank", F.col("number") + F.col("ahead"))
    found = ranked.join(F.broadcast(places), F.col("length") == F.col("size")).withColumn(
        "slot", F.expr("CAST(aggregate(ranks, 0, (n, r) -> n + CAST(r <= rank AS INT)) - 1 AS INT)"))
    return found.select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        F.expr("sequences[slot] + rank - ranks[slot]").alias("sequence_id"), F.expr("offsets[slot]").alias("offset"))
