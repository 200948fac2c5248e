"""Random and grid search, finalist selection and the evaluation matrix. Every fit is a Spark job."""

from __future__ import annotations

import itertools
import json
import random
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.learning.classifiers import fit
from tidemark.operators.encode import fraction_rows
from tidemark.operators.metrics import fold_column, ranked_areas, scores
from tidemark.operators.summarize import rank_candidates
from tidemark.session import materialize

# The search space. Pairs (low, high) are whole-number ranges, lists are choices.
PREP_SPACE = {"imputer": ["mean", "median", "mode"], "transform": [None, "log1p", "sqrt"],
              "scaler": [None, "standard", "robust", "minmax"], "components": (1, 100)}
CLASSIFIER_SPACE = {
    "NB": {},
    "RF": {"n_estimators": (10, 100), "max_depth": (5, 20), "criterion": ["gini", "entropy"]},
    "LR": {"C": [10 ** (-3 + 0.8 * i) for i in range(6)], "penalty": ["l1", "l2"]},
    "KNN": {"n_neighbors": (5, 20), "weights": ["uniform", "distance"]},
    "DT": {"max_depth": (5, 20), "criterion": ["gini", "entropy"]},
    "SVM": {"C": [10.0 ** (i - 5) for i in range(6)]},
    "ANN": {"hidden": [25, 50, 100, 200], "tol": [10 ** (-5 + 0.4 * i) for i in range(6)], "seed": (0, 1000)},
}
LOG_SCHEMA = ("candidate string, algorithm string, params string, fold int, f1 double, mcc double, kappa double, prc double, roc double, "
              "prc_score double, roc_score double, seconds double, rows bigint, context map<string,string>")


def sample(space: Mapping, rng: random.Random) -> dict:
    """One random choice from a space; high ends of ranges are exclusive."""
    return {k: rng.randrange(*v) if isinstance(v, tuple) else rng.choice(v) for k, v in space.items()}


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    names = sorted(space)
    return [dict(zip(names, values)) for values in itertools.product(*(space[n] for n in names))]


def candidate_id(algorithm: str, params: Mapping, prep: Mapping) -> str:
    return json.dumps({"algorithm": algorithm, "params": dict(params), "prep": dict(prep)}, sort_keys=True)


def evaluate(predicted: DataFrame) -> dict:
    """Scores of a predicted frame, from hard predictions and from probabilities.

    The predictions are written once, so that the model is not applied again for every pass.
    """
    predicted = materialize(predicted.select("label", "prediction", "score"), "predicted")
    hard = scores(predicted, [], ("f1", "mcc", "kappa", "prc_label", "roc_label"), "label", "prediction").head().asDict()
    soft = ranked_areas(predicted, "score", "label").head()
    return {"f1": hard["f1"], "mcc": hard["mcc"], "kappa": hard["kappa"], "prc": hard["prc_label"], "roc": hard["roc_label"],
            "prc_score": soft["average_precision"], "roc_score": soft["roc_auc"], "rows": (soft["p"] or 0) + (soft["q"] or 0)}


def fit_and_score(train: DataFrame, test: DataFrame, features, algorithm, params, prep, fold=None, context=None, key="keys_company_id", extractor=True) -> dict:
    start = time.monotonic()
    fitted = fit(train, features, algorithm, params, prep, key, extractor)
    seconds = time.monotonic() - start
    row = {"candidate": candidate_id(algorithm, params, prep), "algorithm": algorithm, "params": json.dumps(dict(params), sort_keys=True),
           "fold": fold, "seconds": seconds, "context": {k: str(v) for k, v in (context or {}).items()}}
    return row | evaluate(fitted.predict(test))


def to_log(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """Fit log: one small row per fit."""
    names = [c.split(" ")[0] for c in LOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOG_SCHEMA)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def cross_validate(df: DataFrame, features, algorithm: str, params: Mapping, prep: Mapping, folds: int, context=None, key="keys_company_id",
                   extractor=True) -> list[dict]:
    folded = df.withColumn("__fold", fold_column(key, folds))
    return [fit_and_score(folded.where(F.col("__fold") != f).drop("__fold"), folded.where(F.col("__fold") == f).drop("__fold"),
                          features, algorithm, params, prep, f, context, key, extractor) for f in range(folds)]


def search(df: DataFrame, features, candidates: Sequence[tuple[str, Mapping, Mapping]], folds: int = 3, parallelism: int = 4, context=None,
           key="keys_company_id") -> DataFrame:
    """Cross-validated scores of every candidate. ``df`` should be materialised: it is read by every fit."""
    def one(c):
        return cross_validate(df, features, c[0], c[1], c[2], folds, context, key)

    with ThreadPoolExecutor(parallelism) as pool:
        rows = [r for batch in pool.map(one, candidates) for r in batch]
    return to_log(df.sparkSession, rows)


def random_search(df: DataFrame, features, algorithms: Sequence[str], iterations: int, folds: int = 3, seed: int = 0, parallelism: int = 4,
                  prep_space: Mapping | None = None, spaces: Mapping | None = None, context=None) -> DataFrame:
    rng = random.Random(seed)
    prep_space, spaces = prep_space or PREP_SPACE, spaces or CLASSIFIER_SPACE
    picked = [(a, sample(spaces[a], rng), sample(prep_space, rng)) for a in algorithms for _ in range(iterations)]
    return search(df, features, picked, folds, parallelism, context)


def grid_search(df: DataFrame, features, algorithm: str, space: Mapping[str, Sequence], prep: Mapping, folds: int = 3, parallelism: int = 4) -> DataFrame:
    return search(df, features, [(algorithm, p, prep) for p in grid(space)], folds, parallelism)


def finalists(log: DataFrame, criterion: str, top_n: int) -> list[dict]:
    """The ``top_n`` best candidates by median score; of equally ranked ones the first by name."""
    ranked = rank_candidates(log, "candidate", criterion)
    return [json.loads(r["candidate"]) for r in ranked.orderBy("rank", "candidate").limit(top_n).collect()]


def select_finalist(create_log: DataFrame, datasets: Sequence[DataFrame], features, criterion: str = "prc", top_n: int = 3, folds: int = 3,
                    parallelism: int = 4) -> tuple[dict, DataFrame]:
    """Re-score the finalists on further datasets; the best by median wins. Returns it with the new log."""
    chosen = [(c["algorithm"], c["params"], c["prep"]) for c in finalists(create_log, criterion, top_n)]
    logs = None
    for i, df in enumerate(datasets):
        log = search(df, features, chosen, folds, parallelism, {"dataset": i})
        logs = log if logs is None else logs.unionByName(log)
    return finalists(logs, criterion, 1)[0], logs


def experiment_matrix(
    train: DataFrame, test: DataFrame, features, winner: Mapping, label_of: Callable[[str], object], label_types: Sequence[str],
    stages: Sequence[str | None], fractions: Sequence[float], key: str = "keys_company_id", context=None, parallelism: int = 4,
    unfitted: bool = False,
) -> DataFrame:
    """Fit the winner for every label type, stage and training fraction; score it on training and test rows.

    The extractor is left out, so that weights belong to features. A cell without both classes in training, or without
    rows to score, is not fitted; ``unfitted`` keeps its rows all the same, with the number of rows and no scores.
    """
    def cell(args) -> list[dict]:
        kind, stage, fraction = args
        part, held = (
            (df if stage is None else df.where(F.col("keys_company_stage") == stage)).withColumn("label", label_of(kind)) for df in (train, test))
        part = fraction_rows(part, f"pmod(xxhash64({key}), 1000)", [fraction]).drop("fraction")
        shared = {"candidate": candidate_id(**winner), "algorithm": winner["algorithm"], "params": json.dumps(winner["params"], sort_keys=True)}

        def row(name: str) -> dict:
            return shared | {"context": {"label_type": kind, "stage": stage or "All", "fraction": str(fraction), "dataset": name, **(context or {})}}

        sides = (("train", part), ("test", held))
        if part.select("label").distinct().count() < 2 or held.isEmpty():
            return [row(name) | {"rows": frame.count()} for name, frame in sides] if unfitted else []
        model = fit(part, features, winner["algorithm"], winner["params"], winner["prep"], key, extractor=False)
        return [row(name) | evaluate(model.predict(frame)) for name, frame in sides]

    with ThreadPoolExecutor(parallelism) as pool:
        rows = [r for batch in pool.map(cell, itertools.product(label_types, stages, fractions)) for r in batch]
    return to_log(train.sparkSession, rows)
