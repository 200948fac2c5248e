"""Stability selection: how often a randomised lasso keeps each feature over many resamples of the rows.

All resamples are made in one scan (after one for the means). A row counts w times in resample b, w being a Poisson number drawn from a hash of its
key and b; per task, the weighted sums of products of all columns are added up for all resamples together (one matrix
product a batch), and only these, (columns + 2)² numbers a resample, are shuffled. Each resample's lasso is then solved
from its sums by coordinate descent, in parallel over resamples, with every feature's penalty enlarged by a random
factor. Features are standardised by the resample's own moments.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 2048  # rows whose products are held at once
MOST = 12     # Poisson numbers of mean 1 beyond this have a chance below 1e-10


def _bits(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _chance(seeds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """[keys, seeds] numbers in [0, 1)."""
    return (_bits(_bits(keys)[:, None] + _bits(seeds)[None]) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def poisson_weights(keys: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """[keys, rounds] Poisson numbers of mean 1."""
    upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(MOST)])
    return np.searchsorted(upto, _chance(np.arange(rounds, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1), keys), "right").astype(np.float64)


def lasso(moments: np.ndarray, share: float, factors: np.ndarray, steps: int = 10_000, least: float = 1e-12) -> np.ndarray:
    """Lasso weights of standardised columns and label from the sums of products of (1, columns, label).

    ``share``: penalty as a share of the smallest one that leaves no feature; ``factors``: per feature, enlarging it.
    A column without spread has weight 0. Runs until no weight moves by more than ``least``.
    """
    n, d = moments[0, 0], len(moments) - 2
    weights = np.zeros(d)
    if n < 2:
        return weights
    mean = moments[0] / n
    cov = moments / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    spread = np.where(spread > 1e-12 * np.maximum(1, np.abs(mean)), spread, np.inf)
    gram, score = (cov / np.outer(spread, spread))[1:-1, 1:-1], (cov[:, -1] / (spread * spread[-1]))[1:-1]
    penalty = share * np.abs(score).max(initial=0) * factors
    for _ in range(steps):
        moved = 0.0
        for j in range(d):
            if np.isinf(spread[j + 1]):
                continue
            pull = score[j] - gram[j] @ weights + weights[j]
            new = math.copysign(max(abs(pull) - penalty[j], 0.0), pull)
            moved, weights[j] = max(moved, abs(new - weights[j])), new
        if moved <= least:
            break
    return weights


def resampled_weights(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "keys_company_id", rounds: int = 100,
                      share: float = 0.2, weakness: float = 0.5, seed: int = 0) -> DataFrame:
    """(resample, feature, weight) of ``rounds`` randomised lasso fits. NULL features take the column's mean; rows with a NULL label are left out."""
    d, names = len(features) + 2, list(features)
    known = df.where(F.col(label).isNotNull())
    means = known.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)])).scalar()
    # Centred by the means of all rows, so that sums of products of large numbers keep their digits.
    rows = known.withColumn("__m", means).select(
        F.xxhash64(F.col(key)).alias("__h"), *[F.expr(f"coalesce(CAST({c} AS DOUBLE) - __m.m{i}, 0D) AS __{i}") for i, c in enumerate(names)],
        F.col(label).cast("double").alias("__y"))
    upper = np.triu_indices(d)

    def sums(frames):
        total = np.zeros((rounds, len(upper[0])))
        for frame in frames:
            x = np.concatenate([np.ones((len(frame), 1)), frame.iloc[:, 1:].to_numpy(np.float64)], axis=1)
            keys = frame["__h"].to_numpy(np.int64).view(np.uint64)
            for i in range(0, len(x), BATCH):
                part = x[i: i + BATCH]
                total += poisson_weights(keys[i: i + BATCH], rounds, seed).T @ (part[:, upper[0]] * part[:, upper[1]])
        yield pd.DataFrame({"resample": np.repeat(np.arange(rounds), total.shape[1]), "cell": np.tile(np.arange(total.shape[1]), rounds), "value": total.ravel()})

    cells = rows.mapInPandas(sums, "resample long, cell long, value double").groupBy("resample", "cell").agg(F.sum("value").alias("value"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        b = int(frame["resample"].iloc[0])
        moments = np.zeros((d, d))
        cell = frame["cell"].to_numpy()
        moments[upper[0][cell], upper[1][cell]] = moments[upper[1][cell], upper[0][cell]] = frame["value"].to_numpy()
        factors = penalty_factors(b, d - 2, weakness, seed)
        return pd.DataFrame({"resample": b, "feature": names, "weight": lasso(moments, share, factors)})

    return cells.groupBy("resample").applyInPandas(solve, "resample long, feature string, weight double")


def penalty_factors(resample: int, features: int, weakness: float, seed: int) -> np.ndarray:
    """Factors from 1 to 1 / ``weakness`` by which a resample's penalties are enlarged."""
    draw = _chance(np.array([resample + seed * 1_000_003 + 500_000_009], np.uint64), np.arange(features, dtype=np.uint64))[:, 0]
    return 1 / (weakness + (1 - weakness) * draw)


def stability_frequencies(df: DataFrame, features: Sequence[str], **options) -> DataFrame:
    """(feature, frequency): the share of resamples in which the feature keeps a weight."""
    weights = resampled_weights(df, features, **options)
    return weights.groupBy("feature").agg(F.avg((F.abs("weight") > 1e-9).cast("double")).alias("frequency"))
