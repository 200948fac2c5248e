import numpy as np
import pytest

from tidemark.learning import classifiers as C
from tidemark.learning import search as H
from tidemark.learning.balance import repeated_rows


def made(spark, n=600):
    rng = np.random.default_rng(5)
    y = (rng.random(n) < 0.08).astype(int)
    x = rng.normal(0, 1, (n, 2)) + y[:, None] * [[2.5, 0]]
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "keys_company_id long, a double, b double, label int")


def test_classes_become_equal_and_no_row_goes(spark):
    df = made(spark)
    out = repeated_rows(df, "label", "keys_company_id", 3)
    n = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    plain = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    assert n[0] == plain[0] and abs(n[1] - n[0]) < 0.1 * n[0]
    assert out.select("keys_company_id").distinct().count() == 600
    again = repeated_rows(df.repartition(7), "label", "keys_company_id", 3)
    assert out.exceptAll(again).count() == 0 and again.exceptAll(out).count() == 0
    assert repeated_rows(df.where("false"), "label", "keys_company_id").count() == 0


def test_net_finds_the_rare_class(spark):
    fitted = C.fit(made(spark).cache(), ["a", "b"], "ANN", {"hidden": 8}, {"scaler": "standard"})
    scored = fitted.predict(made(spark))
    recall = scored.where("label = 1").selectExpr("avg(prediction) AS r").head()["r"]
    assert recall > 0.75 and H.evaluate(scored)["roc_score"] > 0.85
    assert fitted.model.rounds and min(fitted.model.rounds) < 0.6


def test_net_has_a_space():
    import random

    picked = H.sample(H.CLASSIFIER_SPACE["ANN"], random.Random(1))
    assert set(picked) == {"hidden", "tol", "seed"} and picked["hidden"] in (25, 50, 100, 200)


def test_cells_of_one_class_are_reported(spark):
    from pyspark.sql import functions as F

    rows = made(spark).withColumn("keys_company_stage", F.expr("CASE WHEN label = 0 AND keys_company_id % 2 = 0 THEN 'Seed' ELSE 'Series A' END")).cache()
    winner = {"algorithm": "NB", "params": {}, "prep": {}}
    log = H.experiment_matrix(rows, rows, ["a", "b"], winner, lambda kind: F.col("label"), ["x"], ["Seed", "Series A"], [1.0], unfitted=True)
    got = {(r["context"]["stage"], r["context"]["dataset"]): (r["rows"], r["f1"]) for r in log.collect()}
    assert len(got) == 4 and got["Seed", "train"] == (rows.where("keys_company_stage = 'Seed'").count(), None)
    assert got["Series A", "test"][1] is not None


def test_feature_without_values_counts_as_zero(spark):
    rows = made(spark).selectExpr("*", "CAST(NULL AS DOUBLE) AS gone")
    fitted = C.fit(rows, ["a", "gone"], "LR", {}, {"imputer": "median", "scaler": "standard"})
    assert abs(dict(C.feature_weights(fitted, ["a", "gone"]))["gone"]) < 1e-9
    assert fitted.predict(rows.withColumn("gone", rows["a"])).count() == 600
