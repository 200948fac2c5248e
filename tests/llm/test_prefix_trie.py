import hashlib
import random
import zlib

import pytest

from tidemark.llm import queries
from tidemark.llm.prefix_trie import grafted, id_digests, prefix_trie, sequenced
from tidemark.llm.tree_sums import subtree_sums
from tests.llm.test_operators import words_of

SCHEMA = "conv_id long, turn long, role string, text string, pos int, node string, words string"


def rebuilt(rows):
    found = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in found.items()}
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = plain.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute_force(rows):
    members, ends = {}, {}
    for c, seq in rebuilt(rows).items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * len(words_of(node[-1][1]) if node else []) + sum(saved[x] for x in below)
    return sorted((min(members[x]), len(x), min(members[x[:-1]]) if x else None, len(members[x]), len(children.get(x, [])), leaves[x], saved[x],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(x, [])))).encode()).hexdigest()) for x in members)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def trie(turns):
    from pyspark.sql import functions as F

    nodes, ends = prefix_trie(*grafted(sequenced(turns), 20, F.crc32(F.col("conv").cast("string").cast("binary")) % 4))
    return nodes.join(id_digests(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def made_rows():
    rng = random.Random(3)
    rows = [(None, 1, "user", "lost"), (40, None, None, None), (40, None, "user", ""), (41, 5, "a", "x"), (41, 5, "a", "x"), (41, 5, "a", "b c")]
    said = [None, "", " \n", "one", "two words", "drei  wörter hier", "long " * 3000]
    for c in [*range(0, 60, 3), 205, 207, 1000, 1001, 1003]:
        rows += [(c, rng.choice([None, 1, 2, 3, 4]), rng.choice(["user", "bot", None]), rng.choice(said)) for _ in range(rng.randint(1, 7))]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(40) for t in range(5)]             # one conversation many times
    rows += [(777, t, "user", f"turn {t % 50}") for t in range(1400)]                            # a long chain
    return [(*r, 1, "n", "w") for r in rows]


def test_trie_against_plain_python(spark):
    rows = made_rows()
    assert result(trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute_force(rows)


def test_no_conversations(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_its_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.QUERIES["op13_prefix_trie"](spark, sf_dir)) == brute_force(rows)


def test_subtree_sums(spark):
    rng = random.Random(8)
    parent = {0: None, 1: None, **{i: rng.choice([i - 1, i - 1, i - 1, rng.randrange(i)]) for i in range(2, 400)}}
    total = {i: i * 7 % 11 for i in parent}
    rows = [(i, p, total[i]) for i, p in parent.items()]
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    found = subtree_sums(spark.createDataFrame(rows, "id long, parent long, v long"), ("v",))
    assert dict(map(tuple, found.collect())) == total
    with pytest.raises(ValueError):
        subtree_sums(spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "id long, parent long, v long"), ("v",)).collect()
