"""Exact substring removal against brute force where one line stands in most texts, and on long runs of one letter."""

import random
from collections import defaultdict

import pytest

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import remove_repeats

LENGTH = 400


def brute(texts):
    """doc → (n_bytes, n_removed, n_spans, kept) by comparing all strings."""
    places = defaultdict(set)
    data = {k: (t or "").encode() for k, t in texts.items()}
    for k, b in data.items():
        for i in range(len(b) - LENGTH + 1):
            places[b[i: i + LENGTH]].add((k, i))
    gone = {k: [False] * len(b) for k, b in data.items()}
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                gone[k][i: i + LENGTH] = [True] * LENGTH
    return {k: (len(b), sum(gone[k]), sum(g and not (i and gone[k][i - 1]) for i, g in enumerate(gone[k])),
                bytes(c for c, g in zip(b, gone[k]) if not g)) for k, b in data.items()}


def texts():
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    line, passage = prose(139), prose(600)
    rows = [f"{prose(rng.randint(0, 400))}{line}{prose(rng.randint(0, 400))}" for _ in range(60)]  # one line, other surroundings
    rows += [f"{prose(rng.randint(0, 90))}{line}{passage}{prose(rng.randint(0, 90))}" for _ in range(15)]  # the line and more
    rows += [rows[0], rows[0], rows[61], prose(700), None, "", "x" * 3000, "x" * 399, "x" * 400, "ab" * 700, line * 5]
    return dict(enumerate(rows))


@pytest.mark.parametrize("large, windows, sent", [(30_000, 1_000_000, 20_000), (0, 1_000_000, 20_000), (5, 3_000, 10), (40, 500, 50)])
def test_equal_to_brute_force(spark, monkeypatch, large, windows, sent):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
    monkeypatch.setattr(suffix_dedup, "SENT", sent)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 25)
    rows = texts()
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows.items()], "doc_id long, text string, bucket string, name int").repartition(6)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(docs).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_null_keys_where_buckets_are_large(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", 0)
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "short")], "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0)]  # one document, and rows without a key match nothing
