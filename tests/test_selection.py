import math

import numpy as np
import pandas as pd
import pytest

from tidemark.learning import preprocess as R
from tidemark.operators import profile as P


def simpson(f, a, b, n=20_000):
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return (b - a) / n / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


@pytest.mark.parametrize("freedom", [1, 2, 3, 4, 5, 8, 11])
def test_chi2_tail_is_the_integral_of_the_density(freedom):
    scale = 2 ** (freedom / 2) * math.gamma(freedom / 2)
    for x in (0.5, 2.0, 9.0, 30.0):
        want = simpson(lambda t: t ** (freedom / 2 - 1) * np.exp(-t / 2) / scale, x, 300)
        assert R.chi2_tail(x, freedom) == pytest.approx(want, rel=1e-6)
    assert R.chi2_tail(0, freedom) == 1.0


def test_chi2_scores_and_choice(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 300)
    pdf = pd.DataFrame({"y": y, "a": y * 2.0 + rng.random(300), "b": rng.random(300), "none": 0.0, "c": (y == 2) * 1.0})
    df = spark.createDataFrame(pdf).selectExpr("CASE WHEN b < 0.05 THEN NULL ELSE y END AS y", "CASE WHEN b > 0.9 THEN NULL ELSE a END AS a", "b", "none", "c")
    known = pdf[pdf.b >= 0.05]
    got = dict((c, (x, p)) for c, x, p in R.chi2_scores(df, ["b", "a", "none", "c"], "y"))
    for c, rows in (("a", known[known.b <= 0.9]), ("b", known), ("c", known)):
        o = rows.groupby("y")[c].sum()
        e = rows.groupby("y")[c].count() / len(rows) * rows[c].sum()
        assert got[c][0] == pytest.approx(((o - e) ** 2 / e).sum()) and got[c][1] == pytest.approx(R.chi2_tail(got[c][0], 3))
    assert got["none"] == (None, None)
    assert R.select_best(df, ["b", "a", "none", "c"], "y", top=2, score="chi2") == ["a", "c"]
    assert R.select_best(df, ["b", "a", "none", "c"], "y", percentile=0.75, score="chi2") == ["b", "a", "c"]
    with pytest.raises(ValueError):
        R.chi2_scores(df.selectExpr("y", "-a AS a"), ["a"], "y")


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 4)) @ np.diag([5, 3, 1, 0.1]) @ np.linalg.qr(rng.normal(0, 1, (4, 4)))[0]
    df = spark.createDataFrame([(i, i % 2, *r.tolist()) for i, r in enumerate(x)] + [(999, 1, None, 0.0, 0.0, 0.0)], "id long, y int, a double, b double, c double, d double")
    got = P.project(df, list("abcd"), ["id", "y"]).orderBy("id").toPandas()
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred)[2][:2]
    for k, axis in enumerate(axes):
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        np.testing.assert_allclose(got[f"pc{k + 1}"][:200], centred @ axis, atol=1e-9)
    assert np.isnan(got["pc1"][200]) and got["y"].tolist()[:2] == [0, 1]
    fitted = P.fit_projection(df, list("abcd"))
    assert P.project(df.where("id < 3"), list("abcd"), ["id"], fitted=fitted).count() == 3
