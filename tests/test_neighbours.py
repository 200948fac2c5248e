import numpy as np
import pyarrow as pa
import pytest

from tidemark.learning import neighbours as N


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), int(i % 3)) for i, v in enumerate(x)], "id long, v array<double>, y int")


def brute_force(train, query, k):
    out = {}
    for i, v in enumerate(query):
        d = np.sqrt(((train - v) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(d)), d))[:k]
        out[100_000 + i] = [(int(j), int(j % 3), round(float(d[j]), 9)) for j in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["place"])):
        out.setdefault(r["id"], []).append((r["neighbour"], r["y"], round(r["distance"], 9)))
    return out


@pytest.mark.parametrize("block, pivots, k", [(50, 12, 7), (4096, 128, 3), (3, 1, 40)])
def test_equal_to_all_pairs(spark, monkeypatch, block, pivots, k):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "PIVOTS", pivots)
    rng = np.random.default_rng(3)
    train = np.concatenate([rng.normal(c, 1, (60, 5)) for c in range(0, 40, 8)] + [np.zeros((80, 5)), rng.integers(0, 3, (100, 5)).astype(float)])
    query = np.concatenate([rng.normal(8, 2, (15, 5)), np.zeros((2, 5)), rng.normal(500, 1, (3, 5)), rng.integers(0, 3, (10, 5)).astype(float)])
    got = N.nearest_neighbours(frame(spark, train), frame(spark, query, 100_000), "id", "v", k, "y")
    assert result(got) == brute_force(train, query, k)


def test_few_points_and_none(spark):
    train, query = np.arange(6.0).reshape(3, 2), np.ones((2, 2))
    got = N.nearest_neighbours(frame(spark, train), frame(spark, query, 100_000), "id", "v", 5, "y")
    assert result(got) == brute_force(train, query, 5)
    none = frame(spark, train).where("id < 0")
    assert N.nearest_neighbours(none, frame(spark, query), "id", "v", 5, "y").count() == 0
    assert N.nearest_neighbours(frame(spark, train), none, "id", "v", 5, "y").count() == 0


def test_clustered_vectors_meet_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 100)
    monkeypatch.setattr(N, "PIVOTS", 60)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, (20, 8))
    train = np.concatenate([rng.normal(c, 1, (200, 8)) for c in centres])
    query = np.concatenate([rng.normal(c, 1, (5, 8)) for c in centres])
    got, visits = N.neighbours_and_visits(frame(spark, train), frame(spark, query, 100_000), "id", "v", 7, "y")
    assert result(got) == brute_force(train, query, 7)
    met = visits.selectExpr("sum(queries * points) AS pairs").head()["pairs"]
    assert met < 0.1 * len(train) * len(query)


def test_queries_are_sent_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(N, "SENT", 50)
    rng = np.random.default_rng(6)
    pivots, query = rng.normal(0, 1, (40, 30)), rng.normal(0, 1, (60, 30))
    cells = N._Cells(pivots, dict.fromkeys(range(40), 10), dict.fromkeys(range(40), 9.0), {}, 3)
    batch = pa.RecordBatch.from_pydict({"q_key": np.arange(60), "q_vec": query.tolist(), "own_cell": np.zeros(60, np.int32),
                                        "own_ring": np.zeros(60, np.int64), "radius": np.full(60, 99.0)})
    sent = list(N._sent(batch, cells))
    assert max(b.num_rows for b in sent) == 50
    assert sorted((k, c) for b in sent for k, c in zip(b["q_key"].to_pylist(), b["cell"].to_pylist())) == [(k, c) for k in range(60) for c in range(1, 40)]


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_near_points_are_exact(shift):
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(0, 1, (300, 4)), np.zeros((40, 4)), rng.normal(0, 1e-7, (60, 4))]) + shift
    points[5, 0] = np.nan
    queries = np.concatenate([rng.normal(0, 1, (20, 4)), np.zeros((3, 4))]) + shift
    for radius in (np.inf, 0.5):
        q, p, d = N._near(queries, points, np.full(len(queries), radius), 7)
        for i, x in enumerate(queries):
            exact = np.sqrt(((points - x) ** 2).sum(axis=1))
            best = [j for j in np.lexsort((np.arange(len(exact)), exact))[:7] if not exact[j] > radius]
            inside = d[q == i] <= radius
            assert p[q == i][inside].tolist() == best and d[q == i][inside].tolist() == exact[best].tolist()
