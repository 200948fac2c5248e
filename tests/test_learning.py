import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.learning import classifiers as C
from tidemark.learning import neighbours as K
from tidemark.learning import preprocess as R
from tidemark.learning import search as H
from tidemark.operators import metrics as M
from tidemark.session import scratch_dir

FEATURES = ["a_b_one_number", "a_b_two_number"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 400
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"keys_company_id": range(n), "label": y, FEATURES[0]: y * 2.0 + rng.random(n), FEATURES[1]: rng.random(n)})
    df = spark.createDataFrame(pdf).withColumn("keys_company_stage", F.expr("CASE WHEN keys_company_id % 2 = 0 THEN 'Seed' ELSE 'Series A' END"))
    return df.withColumn(FEATURES[1], F.expr(f"CASE WHEN keys_company_id % 9 <> 0 THEN {FEATURES[1]} END")).cache()


@pytest.mark.parametrize("algorithm", C.ALGORITHMS)
def test_every_algorithm_learns(rows, algorithm):
    fitted = C.fit(rows, FEATURES, algorithm, {"max_iter": 20}, {"transform": "sqrt"})
    scores = H.evaluate(fitted.predict(rows))
    assert scores["f1"] > 0.9 and scores["roc_score"] > 0.9 and scores["rows"] == 400


def test_pca_and_weights(rows):
    forest = C.fit(rows, FEATURES, "RF", {"n_estimators": 5}, {"scaler": None, "components": 1}, extractor=False)
    weights = dict(C.feature_weights(forest, FEATURES))
    assert weights[FEATURES[0]] > 0.8
    reduced = C.fit(rows, FEATURES, "LR", {}, {"scaler": "robust", "components": 1})
    assert len(reduced.model.coefficients) == 1
    assert C.feature_weights(C.fit(rows, FEATURES, "NB"), FEATURES) == []
    with pytest.raises(ValueError):
        C.estimator("XX", {}, 1, 1, "k")


def test_fisher_and_stability(rows):
    filled = R.impute(rows, FEATURES, "mean")
    direction = dict(C.fisher_direction(filled, FEATURES))
    assert abs(direction[FEATURES[0]]) > 0.95
    frequency = dict(C.stability_selection(rows, FEATURES, rounds=2))
    assert frequency[FEATURES[0]] == 1.0
    assert R.select_best(filled, FEATURES, "label", top=1) == [FEATURES[0]]


def test_search_and_finalists(rows):
    log = H.grid_search(rows, FEATURES, "LR", {"C": [0.01, 1.0], "penalty": ["l2"]}, {"scaler": "standard"}, folds=2)
    assert log.count() == 4
    path = scratch_dir(log.sparkSession, "log")
    H.append_log(log, path)
    H.append_log(log, path)
    assert log.sparkSession.read.parquet(path).count() == 8
    best, again = H.select_finalist(log, [rows], FEATURES, "f1", top_n=1, folds=2)
    assert best["algorithm"] == "LR" and again.count() >= 2

    matrix = H.experiment_matrix(rows, rows, FEATURES, best, lambda kind: F.col("label"), ["Extra_Stage"], [None, "Seed", "Nobody"], [1.0])
    assert {(r["context"]["stage"], r["context"]["dataset"]) for r in matrix.collect()} == {
        ("All", "train"), ("All", "test"), ("Seed", "train"), ("Seed", "test")}


def test_random_search_is_seeded():
    import random

    picks = [H.sample(H.PREP_SPACE, random.Random(4)) for _ in range(2)]
    assert picks[0] == picks[1] and 1 <= picks[0]["components"] < 100
    assert len(H.grid({"a": [1, 2], "b": [3]})) == 2


@pytest.mark.parametrize("block", [4096, 40])
def test_neighbours_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (150, 4)), rng.normal(3, 1, (150, 4))])  # one crowded cell
    x[5] = x[6]
    pdf = pd.DataFrame({"id": range(300), "v": list(x.tolist()), "y": [int(i % 3) for i in range(300)]})
    df = spark.createDataFrame(pdf, "id long, v array<double>, y int")
    got = K.nearest_neighbours(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), "id", "v", 5, "y").toPandas()
    train, query = pdf[pdf.id % 4 != 0], pdf[pdf.id % 4 == 0]
    assert len(got) == 5 * len(query)
    for q, part in got.groupby("id"):
        d = np.sqrt(((np.array(train.v.tolist()) - np.array(pdf.v[q])) ** 2).sum(axis=1))
        want = train.id.to_numpy()[np.lexsort((train.id.to_numpy(), d))[:5]]
        assert part.sort_values("place").neighbour.tolist() == want.tolist()


def test_vote_ties_and_exact_hits(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 0, 1.0), (2, 1, 0.0), (2, 0, 0.1), (2, 0, 0.1)], "id int, y int, distance double")
    assert {r["id"]: r["prediction"] for r in K.vote(df, "id", "y").collect()} == {1: 0, 2: 0}
    assert {r["id"]: r["prediction"] for r in K.vote(df, "id", "y", weighted=True).collect()} == {1: 0, 2: 1}


def test_scores_by_hand(spark):
    df = spark.sql("SELECT * FROM VALUES (1,1),(1,1),(1,0),(0,1),(0,0),(0,0),(0,0) AS t(y_true, y_pred)")
    row = M.scores(df, metrics=("accuracy", "precision", "recall", "f1", "mcc", "kappa", "roc_label", "prc_label")).head()
    assert row["accuracy"] == pytest.approx(5 / 7) and row["f1"] == pytest.approx(2 / 3)
    assert row["mcc"] == pytest.approx((2 * 3 - 1) / np.sqrt(3 * 3 * 4 * 4)) and row["roc_label"] == pytest.approx((2 / 3 + 3 / 4) / 2)
    assert row["prc_label"] == pytest.approx((2 / 3) * (2 / 3) + (1 / 3) * (3 / 7))
    assert row["kappa"] == pytest.approx((5 / 7 - 25 / 49) / (1 - 25 / 49))


def test_scores_without_positives(spark):
    row = M.scores(spark.sql("SELECT 0 AS y_true, 0 AS y_pred")).head()
    assert row["mcc"] == 0.0 and row["f1"] is None


def test_exact_imputer_and_scalers(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1.0D), (2, 1.0D), (3, 4.0D), (4, CAST(NULL AS DOUBLE)) AS t(id, x)")
    fills = {s: R.impute(df, ["x"], s).where("id = 4").head()["x"] for s in R.STRATEGIES}
    assert fills == {"mean": 2.0, "median": 1.0, "mode": 1.0}
    assert R.scale(df, ["x"], "minmax").where("id = 3").head()["x"] == 1.0
    same = spark.sql("SELECT 1 AS id, 5.0D AS x")
    assert R.scale(same, ["x"], "standard").head()["x"] == 0.0


def test_gaussian_split(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": np.concatenate([rng.normal(0, 1, 100), rng.normal(50, 1, 100)])})
    out = C.gaussian_split(spark.createDataFrame(pdf), "x")
    assert out.where("(split = 'Young') = (x > 25)").count() == 200


