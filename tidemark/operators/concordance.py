"""Kendall rank correlation without listing pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_RANGE = 50_000
MAX_RANGES = 512


def dominated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted number of pairs where one point is smaller in both coordinates, by halving along x."""
    order = np.argsort(x, kind="stable")
    stack, total = [(x[order], y[order], weight[order])], 0.0
    while stack:
        xs, ys, ws = stack.pop()
        if len(xs) < 2 or xs[0] == xs[-1]:
            continue
        middle = xs[len(xs) // 2]
        # Equal values stay on one side, and neither side is empty.
        cut = int(np.searchsorted(xs, middle, "left")) or int(np.searchsorted(xs, middle, "right"))
        by_y = np.argsort(ys[:cut], kind="stable")
        upto = np.concatenate([[0.0], np.cumsum(ws[:cut][by_y])])
        total += float((ws[cut:] * upto[np.searchsorted(ys[:cut][by_y], ys[cut:], "left")]).sum())
        stack += [(xs[:cut], ys[:cut], ws[:cut]), (xs[cut:], ys[cut:], ws[cut:])]
    return total


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Exact tau-b of two numeric columns over the rows where both are present: one row (n, tau).

    Rows are first added up per distinct (x, y). Both axes are cut into value ranges, frequent values
    getting a range of their own. Pairs whose ranges differ on both axes follow from the table of range
    counts; the others are counted inside one range of one axis at a time, and a range of a single value
    has none, so no task gets more than an even share (about ``ROWS_PER_RANGE`` distinct points, until
    ``MAX_RANGES`` ranges are reached; the table of counts must stay small enough for the driver).
    """
    points = df.where(f"{x} IS NOT NULL AND {y} IS NOT NULL").groupBy(
        F.expr(f"CAST({x} AS DOUBLE)").alias("x"), F.expr(f"CAST({y} AS DOUBLE)").alias("y")).agg(F.count("*").alias("c"))
    size = points.agg(F.count("*").alias("k"), F.sum("c").alias("n")).head()
    ranges = max(8, min(MAX_RANGES, math.ceil(size["k"] / ROWS_PER_RANGE)))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = points.agg(F.array_distinct(F.percentile_approx("x", probs, 10_000)).alias("x"),
                      F.array_distinct(F.percentile_approx("y", probs, 10_000)).alias("y")).select(F.struct("x", "y")).scalar()

    def placed(v: str) -> str:
        # Even numbers are open ranges, odd numbers the cut values themselves.
        return f"coalesce(2 * size(filter(cuts.{v}, c -> c < {v})) + CAST(array_contains(cuts.{v}, {v}) AS INT), 0) AS b{v}"

    cells = points.withColumn("cuts", cuts).selectExpr("x", "y", "c", placed("x"), placed("y"))
    table = np.zeros((2 * ranges + 1, 2 * ranges + 1))
    for r in cells.groupBy("bx", "by").agg(F.sum("c").alias("c")).collect():  # ranges x ranges numbers
        table[r["bx"], r["by"]] = r["c"]
    below = np.zeros_like(table)
    below[1:, 1:] = table.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]
    concordant = float((table * below).sum())

    def count(first: str, second: str):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"pairs": [dominated(pdf[first].to_numpy(float), pdf[second].to_numpy(float), pdf["c"].to_numpy(float))]})

        return one

    within_x = cells.where("bx % 2 = 0").groupBy("bx").applyInPandas(count("x", "y"), "pairs double")
    within_y = cells.where("by % 2 = 0").groupBy("by").applyInPandas(count("bx", "y"), "pairs double")
    inside = within_x.unionByName(within_y).agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("p")).select("p").scalar()

    def tied(*by: str):
        same = points.groupBy(*by).agg(F.sum("c").alias("t"))
        return same.agg(F.expr("sum(1.0D * t * (t - 1) / 2)").alias("v")).scalar()

    n = size["n"] or 0
    one = df.sparkSession.range(1).select(
        F.lit(n).alias("n"), F.lit(n * (n - 1) / 2).alias("n0"), tied("x").alias("n1"), tied("y").alias("n2"), tied("x", "y").alias("n3"),
        (F.lit(concordant) + inside).alias("conc"))
    return one.selectExpr("n", "try_divide(2 * conc - (n0 - n1 - n2 + n3), sqrt(n0 - n1) * sqrt(n0 - n2)) AS tau")
