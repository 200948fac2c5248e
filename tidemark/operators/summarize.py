"""Grouped reports: shares, cross-tabs, descriptive tables, modes, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import average_ranks, exact_quantiles

OVERALL = "Overall"


def shares(df: DataFrame, group: str, value: str, scale: float = 100.0) -> DataFrame:
    """Count of each value per group and its share of the group."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    # One row per (group, value) reaches the window, not one per input row.
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)) * F.lit(scale))


def with_overall(df: DataFrame, group: str, out: str | None = None, label: str = OVERALL) -> DataFrame:
    """Every row in its own group and once more under ``label``; null groups stay apart from it."""
    name = out or group
    return df.selectExpr("*", f"explode(array({group}, '{label}')) AS __g").drop(*([group] if name == group else [])).withColumnRenamed("__g", name)


def rolled_up(df: DataFrame, group: str, aggs: Sequence[Column], label: str = OVERALL) -> DataFrame:
    """Aggregates per group and for all rows; a real NULL group is not confused with the total row."""
    # Grouping by a copy keeps the group column itself usable inside the aggregates.
    g = df.withColumn("__r", F.col(group).cast("string"))
    out = g.rollup("__r").agg(F.grouping("__r").alias("__total"), *aggs)
    return out.withColumn(group, F.when(F.col("__total") == 1, F.lit(label)).otherwise(F.col("__r"))).drop("__r", "__total")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, normalize: bool = False, prefix: str = "v_") -> DataFrame:
    """Counts per (row, column value) with a total row and a total column, optionally as row shares."""
    cells = [F.count(F.when(F.col(column) == v, 1)).alias(f"{prefix}{v}") for v in values]
    out = rolled_up(df.where(F.col(row).isNotNull() & F.col(column).isNotNull()), row, [*cells, F.count("*").alias("total")], "All")
    if normalize:
        names = [f"{prefix}{v}" for v in values]
        out = out.select(row, *[(F.col(c) / F.col("total")).alias(c) for c in names], "total")
    return out


def transition_matrix(df: DataFrame, source: str, target: str, targets: Sequence[str], prefix: str = "to_") -> DataFrame:
    """Share of each target among the rows of a source, in percent, one column per target."""
    cells = [(F.count(F.when(F.col(target) == v, 1)) * 100.0 / F.count("*")).alias(prefix + v.lower().replace(" ", "_").replace("+", "_plus").replace("-", "_"))
             for v in targets]
    return df.groupBy(source).agg(*cells, F.count("*").alias("n"))


def top_categories(df: DataFrame, tokens: str, n: int = 10) -> DataFrame:
    """Most frequent entries of an array expression; a row counts for each of its entries."""
    return (df.selectExpr(f"explode({tokens}) AS category").groupBy("category").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "category").limit(n))


def group_quantiles(df: DataFrame, group: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of several columns per group: one row per group, ``{column}_p25`` ….

    The columns are stacked, so one sketch and one selection serve all of them.
    """
    long = df.selectExpr(*group, *[f"CAST({c} AS DOUBLE) AS {c}" for c in columns]).unpivot(list(group), list(columns), "__col", "__val")
    q = exact_quantiles(long, [*group, "__col"], "__val", probs)
    names = [c for c in q.columns if c not in (*group, "__col")]
    picks = [F.max(F.when(F.col("__col") == c, F.col(p))).alias(f"{c}_{p}") for c in columns for p in names]
    return q.groupBy(*group).agg(*picks)


def rank_candidates(df: DataFrame, candidate: str, score: str, top_n: int | None = None) -> DataFrame:
    """Candidates by median score, best first, ties sharing the average rank, with a dense id.

    The median per candidate is over its fits; ranks are over candidates, of which there are few
    compared with fits, and are taken by value ranges rather than in one task. ``top_n`` keeps that
    many rows, or all when there are fewer; candidates that tie at the cut go in by name.
    """
    medians = exact_quantiles(df, [candidate], score, [0.5]).withColumnRenamed("p50", "median_score")
    ranks = average_ranks(medians, "median_score", out="rank", descending=True)
    ranked = medians.join(ranks, "median_score")
    return ranked if top_n is None else ranked.orderBy(F.desc("median_score"), candidate).limit(top_n)


def first_and_last(df: DataFrame, key: str, at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """First and last event per key with chosen columns of each; mergeable, so hot keys are no trouble."""
    order = f"struct({at}, {tie})"
    row = "struct(" + ", ".join([at, *columns]) + ")"
    agg = df.groupBy(key).agg(F.expr(f"min_by({row}, {order})").alias("a"), F.expr(f"max_by({row}, {order})").alias("z"))
    return agg.selectExpr(key, *[f"a.{c} AS first_{c}" for c in (at, *columns)], *[f"z.{c} AS last_{c}" for c in (at, *columns)])
