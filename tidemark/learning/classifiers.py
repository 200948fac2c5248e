"""Pipelines of preprocessing and classifier on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier)
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, Imputer, MinMaxScaler, RobustScaler, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.learning.balance import BalancedNet
from tidemark.learning.neighbours import nearest_neighbours, vote
from tidemark.learning.stability import stability_frequencies
from tidemark.operators.metrics import class_weights, fold_column

ALGORITHMS = ("NB", "RF", "LR", "KNN", "DT", "SVM", "ANN")


def add_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights beside every row; the table of classes is tiny and joined by its size."""
    return df.join(class_weights(df, label).select(label, "weight"), label)


def preprocessing(features: Sequence[str], imputer: str = "median", transform: str | None = None, scaler: str | None = "standard",
                  components: int | None = None, empty: Sequence[str] = ()) -> list:
    """Imputer, absolute value and transform, scaler and (without it, for readable weights) extractor.

    ``empty`` features have no value in the rows that are fitted; they count as 0 everywhere.
    """
    filled = [f"{f}__i" for f in features]
    known = [f for f in features if f not in empty]
    stages: list = []
    if known:
        stages.append(Imputer(strategy=imputer, inputCols=known, outputCols=[f"{f}__i" for f in known]))
    if empty:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"0D AS {f}__i" for f in empty) + " FROM __THIS__"))
    wrap = {None: "abs({})", "log1p": "log1p(abs({}))", "sqrt": "sqrt(abs({}))"}[transform]
    stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"{wrap.format(c)} AS {c}t" for c in filled) + " FROM __THIS__"))
    last = "assembled"
    stages.append(VectorAssembler(inputCols=[f"{c}t" for c in filled], outputCol=last))
    if scaler is not None:
        kinds = {"standard": lambda **k: StandardScaler(withMean=True, withStd=True, **k),
                 "robust": lambda **k: RobustScaler(withCentering=True, lower=0.25, upper=0.75, **k), "minmax": MinMaxScaler}
        stages.append(kinds[scaler](inputCol=last, outputCol="scaled"))
        last = "scaled"
    if components is not None:
        # PCA projects without centring, so the mean is taken off first.
        stages.append(StandardScaler(inputCol=last, outputCol="centred", withMean=True, withStd=False))
        stages.append(PCA(k=min(components, len(features)), inputCol="centred", outputCol="extracted"))
        last = "extracted"
    stages[-1].setOutputCol("features")
    return stages


@dataclass
class Fitted:
    """A fitted pipeline; ``predict`` gives ``prediction`` and ``score`` (of class 1)."""

    prep: PipelineModel
    model: object

    def predict(self, df: DataFrame) -> DataFrame:
        ready = self.prep.transform(df)
        out = self.model.transform(ready)
        if "score" not in out.columns:
            out = out.withColumn("score", vector_to_array("probability").getItem(1))
        return out.select(*df.columns, F.col("prediction").cast("int").alias("prediction"), "score")


class CalibratedSVM:
    """Linear SVM whose margins become probabilities by a logistic curve fitted on held-out folds."""

    def __init__(self, params: Mapping, key: str, folds: int = 3):
        self.params, self.key, self.folds = params, key, folds

    def _svc(self, rows: int) -> LinearSVC:
        return LinearSVC(regParam=1.0 / (self.params.get("C", 1.0) * rows), weightCol="weight", maxIter=self.params.get("max_iter", 50))

    @staticmethod
    def _margin(df: DataFrame) -> DataFrame:
        return df.withColumn("margin", vector_to_array("rawPrediction").getItem(1))

    def fit(self, df: DataFrame) -> "CalibratedSVM":
        rows = df.count()
        folded = df.withColumn("__fold", fold_column(self.key, self.folds))
        held = None
        for f in range(self.folds):
            part = self._svc(rows).fit(folded.where(F.col("__fold") != f)).transform(folded.where(F.col("__fold") == f))
            one = self._margin(part).select("margin", "label")
            held = one if held is None else held.unionByName(one)
        assembler = VectorAssembler(inputCols=["margin"], outputCol="m")
        self.curve = LogisticRegression(featuresCol="m", labelCol="label").fit(assembler.transform(held))
        self.svc = self._svc(rows).fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        slope, shift = float(self.curve.coefficients[0]), float(self.curve.intercept)
        margins = self._margin(self.svc.transform(df))
        return margins.withColumn("score", F.expr(f"1 / (1 + exp(-({slope}D * margin + {shift}D)))")).withColumn(
            "prediction", F.expr("CAST(score > 0.5D AS DOUBLE)"))


class NeighbourVote:
    """k nearest neighbours with uniform or inverse-distance votes."""

    def __init__(self, params: Mapping, key: str):
        self.params, self.key = params, key

    def fit(self, df: DataFrame) -> "NeighbourVote":
        self.train = df.select(self.key, vector_to_array("features").alias("v"), F.col("label").cast("int").alias("label"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        queries = df.select(self.key, vector_to_array("features").alias("v"))
        near = nearest_neighbours(self.train, queries, self.key, "v", self.params.get("n_neighbors", 5), "label")
        votes = vote(near, self.key, "label", self.params.get("weights") == "distance")
        return df.join(votes, self.key).withColumn("score", F.expr("CASE WHEN prediction = 1 THEN share ELSE 1 - share END"))


def estimator(algorithm: str, params: Mapping, features: int, rows: int, key: str):
    """A classifier by its short name. Needs the columns features, label and weight."""
    p = dict(params)
    if algorithm == "NB":
        return NaiveBayes(modelType="gaussian")
    if algorithm == "LR":
        return LogisticRegression(elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0, regParam=1.0 / (p.get("C", 1.0) * rows),
                                  weightCol="weight", maxIter=p.get("max_iter", 50), standardization=False)
    if algorithm == "DT":
        return DecisionTreeClassifier(maxDepth=p.get("max_depth", 5), impurity=p.get("criterion", "gini"), weightCol="weight", seed=p.get("seed", 0))
    if algorithm == "RF":
        return RandomForestClassifier(numTrees=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 5), impurity=p.get("criterion", "gini"),
                                      featureSubsetStrategy="sqrt", weightCol="weight", seed=p.get("seed", 0))
    if algorithm == "SVM":
        return CalibratedSVM(p, key)
    if algorithm == "ANN":
        return BalancedNet(p, key, features)
    if algorithm == "KNN":
        return NeighbourVote(p, key)
    raise ValueError(f"unknown algorithm {algorithm!r}; known are {ALGORITHMS}")


def fit(df: DataFrame, features: Sequence[str], algorithm: str, params: Mapping | None = None, prep: Mapping | None = None,
        key: str = "keys_company_id", extractor: bool = True) -> Fitted:
    """Fit preprocessing and classifier on rows with ``label``. ``extractor=False`` drops the PCA step."""
    options = dict(prep or {})
    if not extractor:
        options.pop("components", None)
    weighted = add_weights(df)
    present = df.agg(F.count("*").alias("__rows"), *[F.count(f).alias(f) for f in features]).head()
    empty = [f for f in features if not present[f]]
    ready_model = Pipeline(stages=preprocessing(features, **options, empty=empty)).fit(weighted)
    ready = ready_model.transform(weighted)
    width = min(options.get("components") or len(features), len(features))
    model = estimator(algorithm, params or {}, width, present["__rows"], key).fit(ready)
    return Fitted(ready_model, model)


def feature_weights(fitted: Fitted, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, weight) of a fitted forest, tree or linear model; empty for the others."""
    model = fitted.model.svc if isinstance(fitted.model, CalibratedSVM) else fitted.model
    for attribute in ("featureImportances", "coefficients"):
        if hasattr(model, attribute):
            return list(zip(features, (float(x) for x in getattr(model, attribute).toArray())))
    return []


def gaussian_split(df: DataFrame, value: str, names: tuple[str, str] = ("Young", "Mature"), seed: int = 0) -> DataFrame:
    """Rows split in two by a Gaussian mixture over ``value``; the component of the larger mean is ``names[0]``."""
    ready = VectorAssembler(inputCols=[value], outputCol="__v").transform(df.where(f"{value} IS NOT NULL"))
    model = GaussianMixture(k=2, featuresCol="__v", predictionCol="__c", probabilityCol="__p", seed=seed).fit(ready)
    means = [float(g.mean[0]) for g in model.gaussians]
    late = means.index(max(means))
    return model.transform(ready).withColumn(
        "split", F.when(F.col("__c") == late, names[0]).otherwise(names[1])).drop("__v", "__c", "__p")


def fisher_direction(df: DataFrame, features: Sequence[str], label: str = "label") -> list[tuple[str, float]]:
    """Linear discriminant of two classes: pooled covariance solved for the difference of the means.

    The sums are taken on the cluster; only d × d numbers come back.
    """
    import numpy as np

    names = list(features)
    d = len(names)
    cells = [f"sum({a} * {b}) AS p{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *[F.expr(f"sum({a}) AS s{i}") for i, a in enumerate(names)], *[F.expr(c) for c in cells]).collect()
    pooled, means, total = np.zeros((d, d)), {}, 0
    for r in rows:
        s = np.array([r[f"s{i}"] for i in range(d)], dtype=float)
        m = s / r["n"]
        moments = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
        pooled += moments - r["n"] * np.outer(m, m)
        means[r[label]] = m
        total += r["n"]
    w = np.linalg.lstsq(pooled / (total - 2), means[1] - means[0], rcond=None)[0]
    return list(zip(names, (w / np.linalg.norm(w)).tolist()))


def stability_selection(df: DataFrame, features: Sequence[str], rounds: int = 100, share: float = 0.2,
                        key: str = "keys_company_id", seed: int = 0) -> list[tuple[str, float]]:
    """How often each feature keeps a weight in randomised lasso fits on resamples of the rows, in the order of ``features``."""
    found = stability_frequencies(df, features, key=key, rounds=rounds, share=share, seed=seed)
    frequency = {r["feature"]: r["frequency"] for r in found.collect()}
    return [(f, frequency.get(f, 0.0)) for f in features]
