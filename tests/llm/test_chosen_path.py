import random

import pytest

from tidemark.llm import chosen_path
from tidemark.llm.chosen_path import similar_sets
from tests.llm.test_operators import TEXTS, SCHEMA, low, words_of


def shingles(text):
    w = words_of(low(text))
    return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    """{(id, text): (n, component)} of rows (id, text)."""
    sets = {r: shingles(r[1]) for r in rows}
    keys = [r for r in sets if sets[r] and r[0] is not None]
    label = {r: i for i, r in enumerate(keys)}
    where = {}
    for r in keys:
        for s in sets[r]:
            where.setdefault(s, []).append(r)
    for a in keys:
        for b in {x for s in sets[a] for x in where[s]}:
            n = len(sets[a] & sets[b])
            if label[a] != label[b] and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    # Rows of one key and other texts are nodes of their own.
    least = {}
    for r in keys:
        least[label[r]] = min(least.get(label[r], r[0]), r[0])
    return {r: (len(sets[r]), least[label[r]] if r in label else r[0]) for r in sets}


def check(df, rows):
    expected = brute_force(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1, r.kept) for r in df.collect())
    assert got == sorted((i is None, i or 0, expected[i, t][0], expected[i, t][1] or -1, i is None or i == expected[i, t][1]) for i, t in rows)


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.randint(0, 10 ** 6)}"
    return " ".join(w)


def test_against_brute_force(spark):
    rng = random.Random(11)
    base = " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(400))
    rows = [(3 * i, t) for i, t in enumerate(TEXTS)] + [(1000 + i, edited(rng, base, rng.randint(1, 12))) for i in range(150)] + [(2000, base)]
    rows += [(None, base), (None, None), (9, base), (9, TEXTS[11]), (9, TEXTS[11]), (4000, "a b c d e f"), (4001, "A B C D E f")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "w", 1, "z") for i, t in rows], SCHEMA).repartition(5)
    check(similar_sets(df), rows)
    assert similar_sets(df.where("false")).count() == 0


@pytest.mark.parametrize("leaf, block", [(2, 8)])
def test_large_nodes_branch_and_end_in_blocks(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    rng = random.Random(12)
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, edited(rng, base, rng.randint(3, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(similar_sets(df), rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(similar_sets(df), [(r.doc_id, r.text) for r in df.collect()])
