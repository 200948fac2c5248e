"""Imputing, scaling and feature scores with exact statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_modes, exact_quantiles, melt

STRATEGIES = ("mean", "median", "mode")


def _as_struct(long: DataFrame, columns: Sequence[str], value: str):
    """(column, value) rows as a one-row struct, for use as a scalar."""
    picks = ", ".join(f"max(CASE WHEN column = '{c}' THEN {value} END) AS {c}" for c in columns)
    return long.agg(F.expr(f"struct({picks})")).scalar()


def fit_imputer(df: DataFrame, columns: Sequence[str], strategy: str) -> DataFrame:
    """(column, fill): mean, exact median, or the smallest of the most frequent values."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {STRATEGIES}")
    long = melt(df, [], columns)
    if strategy == "mean":
        return long.groupBy("column").agg(F.avg("value").alias("fill"))
    if strategy == "median":
        return exact_quantiles(long, ["column"], "value", [0.5]).withColumnRenamed("p50", "fill")
    return exact_modes(long, ["column"], "value", "fill").select("column", "fill")


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "median", fitted: DataFrame | None = None) -> DataFrame:
    fills = _as_struct(fitted if fitted is not None else fit_imputer(df, columns, strategy), columns, "fill")
    others = [c for c in df.columns if c not in columns]
    return df.withColumn("__f", fills).selectExpr(*others, *[f"coalesce(CAST({c} AS DOUBLE), __f.{c}) AS {c}" for c in columns])


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(column, center, spread): standard by population deviation, robust by quartiles, minmax by ends."""
    long = melt(df, [], columns)
    if kind == "standard":
        return long.groupBy("column").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("spread"))
    if kind == "minmax":
        return long.groupBy("column").agg(F.min("value").alias("center"), (F.max("value") - F.min("value")).alias("spread"))
    if kind == "robust":
        return exact_quantiles(long, ["column"], "value", (0.25, 0.5, 0.75)).selectExpr("column", "p50 AS center", "p75 - p25 AS spread")
    raise ValueError(f"unknown scaler {kind!r}")


def scale(df: DataFrame, columns: Sequence[str], kind: str, fitted: DataFrame | None = None) -> DataFrame:
    """Scaled columns; a column without spread is only centred."""
    fit = fitted if fitted is not None else fit_scaler(df, columns, kind)
    long = fit.selectExpr("column", "struct(center, CASE WHEN spread = 0 THEN 1D ELSE spread END AS spread) AS s")
    values = _as_struct(long, columns, "s")
    others = [c for c in df.columns if c not in columns]
    return df.withColumn("__s", values).selectExpr(*others, *[f"(CAST({c} AS DOUBLE) - __s.{c}.center) / __s.{c}.spread AS {c}" for c in columns])


def variances(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """(column, variance, kept): population variance against a threshold."""
    structs = ", ".join(f"struct('{c}' AS column, var_pop({c}) AS variance)" for c in columns)
    return df.agg(F.expr(f"array({structs})").alias("s")).selectExpr("inline(s)").selectExpr("*", f"coalesce(variance > {threshold}D, false) AS kept")


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way F statistic of every column against the classes, from sums per class."""
    per_class = melt(df.where(f"{label} IS NOT NULL"), [label], columns).where("value IS NOT NULL").groupBy("column", label).agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    per_column = per_class.groupBy("column").agg(
        F.sum("n").alias("total"), F.count("*").alias("k"), F.expr("sum(n * v)").alias("within"),
        F.expr("sum(n * m * m) - pow(sum(n * m), 2) / sum(n)").alias("between"))
    return per_column.selectExpr("column", "try_divide(between / (k - 1), within / (total - k)) AS f")


def chi2_tail(x: float, freedom: int) -> float:
    """Chance that a chi² number of ``freedom`` degrees exceeds ``x``: the closed form, built up two degrees at a time."""
    if x <= 0:
        return 1.0
    half = x / 2
    if freedom % 2:
        tail, term, a = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 1.5
    else:
        tail, term, a = math.exp(-half), math.exp(-half) * half, 2.0
    for _ in range((freedom - 1) // 2):
        tail += term
        term *= half / a
        a += 1
    return min(tail, 1.0)


def chi2_scores(df: DataFrame, columns: Sequence[str], label: str) -> list[tuple[str, float | None, float | None]]:
    """(column, chi², p) of non-negative columns: sums per class against sums in proportion to the classes.

    One aggregate gives the class sums of all columns; classes x columns numbers come back. NULL values and rows with a
    NULL label are left out; a column without a sum has no score. Negative values raise ValueError.
    """
    sums = [F.struct(F.sum(F.col(c).cast("double")).alias("s"), F.min(F.col(c).cast("double")).alias("low"), F.count(c).alias("n")).alias(f"c{i}")
            for i, c in enumerate(columns)]
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(*sums).collect()
    out = []
    for i, c in enumerate(columns):
        cells = [r[f"c{i}"] for r in rows if r[f"c{i}"]["n"]]
        if any(x["low"] < 0 for x in cells):
            raise ValueError(f"chi² needs values of 0 or more: {c}")
        total, count = sum(x["s"] for x in cells), sum(x["n"] for x in cells)
        if not total or len(cells) < 2:
            out.append((c, None, None))
            continue
        score = sum((x["s"] - total * x["n"] / count) ** 2 / (total * x["n"] / count) for x in cells)
        out.append((c, score, chi2_tail(score, len(cells) - 1)))
    return out


def best_columns(scores: Sequence[tuple], top: int | None = None, percentile: float | None = None) -> list[str]:
    """Names of the ``top`` columns, or of that share of them, by score; ties by place, in the order given. Without a score: never."""
    known = [(-s[1], i, s[0]) for i, s in enumerate(scores) if s[1] is not None]
    n = top if top is not None else int(len(scores) * (percentile if percentile is not None else 0.1))
    return [name for _, _, name in sorted(sorted(known)[:n], key=lambda x: x[1])]


def mutual_information(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Mutual information (nats) of binned columns with the classes, from joint counts."""
    joint = melt(df, [label], columns).where(f"value IS NOT NULL AND {label} IS NOT NULL").groupBy("column", "value", label).agg(F.count("*").alias("n"))
    by_value = joint.groupBy("column", "value").agg(F.sum("n").alias("nv"))
    by_class = joint.groupBy("column", label).agg(F.sum("n").alias("nc"))
    total = joint.groupBy("column").agg(F.sum("n").alias("t"))
    terms = joint.join(by_value, ["column", "value"]).join(by_class, ["column", label]).join(total, "column")
    return terms.groupBy("column").agg(F.expr("sum(n / t * ln(1.0D * n * t / (1.0D * nv * nc)))").alias("mi"))


def select_best(df: DataFrame, columns: Sequence[str], label: str, top: int | None = None, percentile: float | None = None,
                categorical: bool = False, score: str | None = None) -> list[str]:
    """Names of the best columns by F test, by a test of independence for categorical columns, or with ``score="chi2"`` by class sums."""
    if score == "chi2":
        return best_columns(chi2_scores(df, columns, label), top, percentile)
    selector = UnivariateFeatureSelector(featuresCol="v", labelCol=label, outputCol="o",
                                         selectionMode="numTopFeatures" if top is not None else "percentile")
    selector.setFeatureType("categorical" if categorical else "continuous").setLabelType("categorical")
    selector.setSelectionThreshold(top if top is not None else percentile)
    model = selector.fit(VectorAssembler(inputCols=list(columns), outputCol="v").transform(df))
    return [columns[i] for i in sorted(model.selectedFeatures)]
