"""Class balance by repetition, for models without weights, and the neural net that needs it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import fold_column
from tidemark.session import materialize

HIDDEN_UNITS = 100
HELD_OUT = 10  # one in so many rows tells when to stop


def repeated_rows(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Rows repeated until all classes are about equally large; no row is dropped, and the largest class stays as it is.

    A row of a class with 1 / w of the largest class's rows comes floor(w) times, and once more where a hash of its key
    falls below the rest, so the same rows give the same copies. Class sizes are a scalar map; rows are not shuffled.
    """
    sizes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("c")).agg(F.count("*").alias("n"))
    times = sizes.agg(F.expr("map_from_entries(collect_list(struct(c, 1D * n)))").alias("m")).select(
        F.expr("transform_values(m, (c, n) -> array_max(map_values(m)) / n)")).scalar()
    chance = f"(pmod(xxhash64({key}, {seed}), 1000003) / 1000003D)"
    copies = f"CAST(floor(__w) AS INT) + CAST({chance} < __w - floor(__w) AS INT)"
    weighted = df.where(F.col(label).isNotNull()).withColumn("__w", F.element_at(times, F.col(label).cast("string")))
    return weighted.withColumn("__i", F.explode(F.expr(f"sequence(1, {copies})"))).drop("__w", "__i")


class BalancedNet:
    """One hidden layer fitted on balanced rows, in rounds that go on from the last weights.

    A round has ``round_iter`` steps. Fitting ends when the loss of held-out rows has not fallen by ``tol`` for
    ``patience`` rounds (the best weights stay), when a round's own steps converge, or after ``max_iter`` steps if given.
    """

    def __init__(self, params: Mapping, key: str, features: int):
        self.params, self.key = dict(params), key
        self.layers = [features, self.params.get("hidden", HIDDEN_UNITS), 2]
        self.rounds: list[float] = []  # held-out loss by round

    def fit(self, df: DataFrame) -> "BalancedNet":
        p, seed = self.params, self.params.get("seed", 0)
        folded = df.select(self.key, "features", "label", fold_column(self.key, HELD_OUT).alias("__f"))
        folded = materialize(repeated_rows(folded, "label", self.key, seed), "balanced")
        train, held = folded.where("__f > 0"), folded.where("__f = 0")
        if not train.take(1) or not held.take(1):
            train = held = folded
        steps, left = p.get("round_iter", 50), p.get("max_iter")
        weights, best, stale = None, float("inf"), 0
        while stale < p.get("patience", 2) and (left is None or left > 0):
            now = steps if left is None else min(steps, left)
            net = MultilayerPerceptronClassifier(layers=self.layers, maxIter=now, tol=p.get("step_tol", 1e-6), seed=seed)
            if weights is not None:
                net = net.setInitialWeights(weights)
            model = net.fit(train)
            weights = model.weights
            loss = self._loss(model, held)
            self.rounds.append(loss)
            if loss < best - p.get("tol", 1e-4):
                stale = 0
            else:
                stale += 1
            if loss < best:
                best, self.model = loss, model
            left = None if left is None else left - now
            if len(model.summary().objectiveHistory) <= now:  # converged within the round
                break
        return self

    @staticmethod
    def _loss(model, held: DataFrame) -> float:
        p = F.greatest(vector_to_array("probability").getItem(F.col("label").cast("int")), F.lit(1e-15))
        return model.transform(held).agg(F.avg(-F.log(p)).alias("loss")).head()["loss"]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)
