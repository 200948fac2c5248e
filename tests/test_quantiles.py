import numpy as np
import pandas as pd
import pytest

from tidemark.operators import quantiles as Q
from tidemark.operators import profile as P
from tidemark.operators.metrics import ranked_areas


@pytest.fixture
def values():
    rng = np.random.default_rng(5)
    n = 60_000
    group = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str))
    v = np.round(rng.lognormal(3, 1, n), 2)
    v[rng.random(n) < 0.3] = 10.0  # one value holds many rows
    v[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"g": group, "v": v})


def with_nulls(spark, pdf):
    return spark.createDataFrame(pdf).selectExpr("g", "nanvl(v, NULL) AS v")


@pytest.mark.parametrize("whole_below", [20_000, 0, 500])
def test_quantiles_equal_pandas(spark, values, monkeypatch, whole_below):
    monkeypatch.setattr(Q, "WHOLE_BELOW", max(whole_below, 15_000) if whole_below else 15_000)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = Q.exact_quantiles(with_nulls(spark, values), ["g"], "v", probs).toPandas().set_index("g")
    want = values.groupby("g")["v"].quantile(list(probs)).unstack()
    for p in probs:
        np.testing.assert_allclose(got[Q._prob_name(p)].sort_index(), want[p].sort_index(), rtol=1e-12)
    one = Q.exact_quantiles(with_nulls(spark, values), [], "v", probs).head()
    np.testing.assert_allclose(list(one), values["v"].quantile(list(probs)), rtol=1e-12)


def test_modes_take_the_smallest(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("b", None), ("b", 7)], "g string, v int")
    got = {r["g"]: (r["mode"], r["mode_count"]) for r in Q.exact_modes(df, ["g"], "v").collect()}
    assert got == {"a": (1, 2), "b": (7, 1)}


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_equal_pandas(spark, values, descending):
    pdf = values.dropna()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank(ascending=not descending)).drop_duplicates(["g", "v"]).set_index(["g", "v"])["r"].sort_index()
    got = Q.average_ranks(spark.createDataFrame(pdf), "v", ["g"], "r", descending).toPandas().set_index(["g", "v"])["r"].sort_index()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_running_totals(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, 2), (1.0, 3), (2.0, 5), (None, 9), (4.0, 1)], "x double, w long")
    rows = sorted(tuple(r) for r in Q.running_totals(df, "x", {"w": F.col("w")}).select("x", "w", "w_before", "w_upto").collect())
    assert rows == [(1.0, 5, 0, 5), (2.0, 5, 5, 10), (4.0, 1, 10, 11)]


def test_spearman(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(500), "a": rng.integers(0, 30, 500), "b": rng.random(500)})
    pdf["c"] = pdf["a"] + pdf["b"] * 10
    want = pdf[["a", "b", "c"]].rank().corr()
    got = P.pairwise_spearman(spark.createDataFrame(pdf), ["id"], ["a", "b", "c"]).collect()
    for r in got:
        assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-12)


def test_areas_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, y int")
    row = ranked_areas(df, "score", "y").head()
    assert row["roc_auc"] == pytest.approx(0.875)  # one tied pair counts half
    assert row["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_normality_against_known_value(spark):
    # A sample with population skewness 0 and excess kurtosis 0 of 100 values is all but normal.
    row = P.add_normality(spark.sql("SELECT 100L AS n, 0D AS g1, 0D AS g2")).head()
    assert row["k2"] < 0.5 and row["p_value"] > 0.75
    assert P.add_normality(spark.sql("SELECT 5L AS n, 0D AS g1, 0D AS g2")).count() == 0


@pytest.mark.parametrize("rows_per_range", [50_000, 20])
def test_kendall_equals_all_pairs(spark, monkeypatch, rows_per_range):
    from tidemark.operators import concordance as K

    monkeypatch.setattr(K, "ROWS_PER_RANGE", rows_per_range)
    rng = np.random.default_rng(9)
    x = np.where(rng.random(600) < 0.35, 3.0, rng.integers(0, 50, 600))  # one value holds a third of the rows
    y = np.round(x + rng.normal(0, 20, 600))
    want = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    dx, dy = (x[:, None] != x).sum(), (y[:, None] != y).sum()
    got = K.kendall_tau(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").head()
    assert got["n"] == 600 and got["tau"] == pytest.approx(want.sum() / np.sqrt(float(dx) * float(dy)), abs=1e-12)


def test_quantiles_of_every_kind_of_double(spark, monkeypatch):
    monkeypatch.setattr(Q, "WHOLE_BELOW", 0)
    monkeypatch.setattr(Q, "PARTS", 4)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(0, 1, 300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf] * 3, 1 + rng.random(500) * 1e-9])
    pdf = pd.DataFrame({"g": np.where(rng.random(len(v)) < 0.5, "a", None), "h": rng.integers(0, 2, len(v)), "v": v})
    probs = tuple(i / 16 for i in range(17))
    got = {(r["g"], r["h"]): r for r in Q.exact_quantiles(spark.createDataFrame(pdf), ["g", "h"], "v", probs).collect()}
    assert len(got) == 4
    for (g, h), rows in pdf.groupby(["g", "h"], dropna=False):
        ordered = np.sort(rows["v"].to_numpy())
        for p in probs:
            pos = p * (len(ordered) - 1)
            low, high = ordered[int(np.floor(pos))], ordered[int(np.ceil(pos))]
            with np.errstate(invalid="ignore"):
                want = low + (high - low) * (pos - np.floor(pos))
            np.testing.assert_equal(got[None if pd.isna(g) else g, h][Q._prob_name(p)], want)


def test_quantiles_shuffle_counts_only(spark, monkeypatch):
    """With almost no room for automatic broadcasts, rows still meet the wanted buckets where they are read."""
    plans, write = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        rows = spark.range(60_000).selectExpr("CAST(id % 3 AS STRING) AS g", "xxhash64(id) / 1e13D AS v")
        Q.exact_quantiles(rows, ["g"], "v", (0.25, 0.5)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rescans = [plan for name, plan in plans if name == "ranks"][1:]
    assert rescans
    for plan in rescans:
        below = plan[plan.index("FileScan"):] if "BroadcastHashJoin" not in plan else plan[plan.index("BroadcastHashJoin"):]
        assert "BroadcastHashJoin" in plan and "hashpartitioning(__g" not in below


def test_spearman_over_the_complete_rows_of_each_pair(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": range(400), "a": rng.integers(0, 20, 400) * 1.0, "b": rng.random(400), "flat": 3.0})
    pdf["c"] = pdf["a"] - pdf["b"] * 9
    gap = rng.random(400) < 0.3
    pdf.loc[gap, "a"] = pdf.loc[gap, "b"] = np.nan       # the same gaps
    pdf.loc[rng.random(400) < 0.4, "c"] = np.nan
    columns = ["a", "b", "c", "flat"]
    want = pdf[columns].corr(method="spearman")
    df = spark.createDataFrame(pdf).selectExpr("id", *[f"nanvl({c}, NULL) AS {c}" for c in columns])
    assert P.gap_classes(df, ["id"], columns) == {"a": "a", "b": "a", "c": "c", "flat": None}
    got = {(r["a"], r["b"]): r["r"] for r in P.pairwise_spearman(df, ["id"], columns).collect()}
    assert len(got) == 6
    for (a, b), r in got.items():
        assert r is None if "flat" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-12)
