import math

import numpy as np
import pytest

from tidemark.learning import stability as S

NAMES = ["a", "b", "c", "flat"]


def made(spark, n=500):
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(0, 3, n), rng.normal(5, 1, n), rng.normal(0, 1, n)
    y = (a + 0.3 * (b - 5) + rng.normal(0, 1, n) > 0).astype(int)
    rows = [(i, float(a[i]) if i % 50 else None, float(b[i]), float(c[i]), 7.0, int(y[i]) if i % 99 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, a double, b double, c double, flat double, label int").repartition(6)


def plain_lasso(rows, weights, share, factors):
    """Coordinate descent over the rows themselves, without sums of products."""
    n = sum(weights)
    columns = [[r[j] for r in rows] for j in range(len(rows[0]))]
    scaled = []
    for col in columns[:-1]:
        m = sum(w * x for w, x in zip(weights, col)) / n
        s = math.sqrt(max(sum(w * (x - m) ** 2 for w, x in zip(weights, col)) / n, 0))
        scaled.append([(x - m) / s if s > 1e-9 else 0.0 for x in col])
    m = sum(w * y for w, y in zip(weights, columns[-1])) / n
    y = [v - m for v in columns[-1]]
    s = math.sqrt(sum(w * v * v for w, v in zip(weights, y)) / n)
    y = [v / s for v in y]
    most = max(abs(sum(w * x * v for w, x, v in zip(weights, col, y))) / n for col in scaled)
    beta = [0.0] * len(scaled)
    for _ in range(300):
        for j, col in enumerate(scaled):
            if not any(col):
                continue
            rest = [v - sum(beta[k] * scaled[k][i] for k in range(len(beta)) if k != j) for i, v in enumerate(y)]
            pull = sum(w * x * v for w, x, v in zip(weights, col, rest)) / n
            beta[j] = math.copysign(max(abs(pull) - share * most * factors[j], 0), pull)
    return beta


def test_resamples_equal_plain_python(spark):
    rows, df = made(spark)
    got = {}
    for r in S.resampled_weights(df, NAMES, key="k", rounds=150, seed=3).collect():
        got.setdefault(r["resample"], {})[r["feature"]] = r["weight"]
    assert sorted(got) == list(range(150))
    known = [r for r in rows if r[-1] is not None]
    mean = float(np.mean([r[1] for r in known if r[1] is not None]))
    full = [(mean if r[1] is None else r[1], *r[2:]) for r in known]
    hashes = {r["k"]: r["h"] for r in df.selectExpr("k", "xxhash64(k) AS h").collect()}
    weights = S.poisson_weights(np.array([hashes[r[0]] for r in known], np.int64).view(np.uint64), 150, 3)
    for b in (0, 77, 149):
        want = plain_lasso(full, weights[:, b].tolist(), 0.2, S.penalty_factors(b, 4, 0.5, 3).tolist())
        assert [got[b][c] for c in NAMES] == pytest.approx(want, abs=1e-8)


def test_frequencies_tell_features_apart(spark):
    _, df = made(spark)
    frequency = {r["feature"]: r["frequency"] for r in S.stability_frequencies(df, NAMES, key="k").collect()}
    assert frequency["a"] == 1.0 and frequency["flat"] == 0.0 and frequency["c"] < 0.5
    assert S.stability_frequencies(df.where("false"), NAMES, key="k").where("frequency > 0").count() == 0


def test_weights_are_poisson():
    w = S.poisson_weights(np.arange(4000, dtype=np.uint64), 50, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
