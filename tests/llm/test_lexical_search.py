import collections
import math
import random
import re

import duckdb

from tidemark.llm import lexical_search, queries
from tidemark.llm.lexical_search import build_index, search
from tests.llm.test_operators import TEXTS, SCHEMA, low

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(docs, items, top=20):
    held = [(i, collections.Counter(TERM.findall(low(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        scores = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in TERM.findall(low(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(-1 if item is None else item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def result(df):
    return sorted(((-1 if r.item_id is None else r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "KEYS", 3000)
    monkeypatch.setattr(lexical_search, "TOGETHER", 16)
    monkeypatch.setattr(lexical_search, "QUERIES", 4)
    rng = random.Random(4)
    docs = [(3 * i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[11]), (9, TEXTS[11]), (9, TEXTS[11]), (9, "other x2 words")]
    docs += [(1000 + i, TEXTS[9]) for i in range(60)] + [(2000 + i, "x " * i + "Éé-Ä a_b") for i in range(60)]
    items = [(i, " ".join(rng.choice(TEXTS[rng.choice([9, 11, 25, 40])].split() or ["q"]) for _ in range(rng.randint(1, 40)))) for i in range(9)]
    items += [(20, None), (21, ""), (22, "nowhere-found"), (23, TEXTS[11]), (None, "one two Words"), (25, "x x X éé"), (25, "x x X éé"), (26, TEXTS[-3])]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "w", 1, "z") for i, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, "d", 5, 1) for i, t in items], "item_id long, text string, doc_id string, score int, q int")
    assert result(search(build_index(df), df, asked)) == brute_force(docs, items)
    none = df.where("false")
    assert search(build_index(none), none, asked).count() == 0
    assert search(build_index(df), df, asked.where("false")).count() == 0


def test_query_against_its_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    sql = queries.ORACLES["op11_lexical_search"].replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'").replace(
        "FROM benchmark", f"FROM '{sf_dir}/benchmark.parquet'")
    expected = duckdb.sql(sql).fetchall()
    found = queries.QUERIES["op11_lexical_search"](spark, sf_dir)
    assert result(found) == sorted(expected, key=str)
