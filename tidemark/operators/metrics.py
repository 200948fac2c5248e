"""Classification scores as aggregates: confusion counts, curves, reports, result logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import running_totals

# Metrics of a confusion table, as SQL over tp, fp, fn, tn. NULL where undefined.
_N = "(tp + fp + fn + tn)"
METRICS = {
    "accuracy": f"try_divide(tp + tn, {_N})",
    "precision": "try_divide(tp, tp + fp)",
    "recall": "try_divide(tp, tp + fn)",
    "f1": "try_divide(2 * tp, 2 * tp + fp + fn)",
    "mcc": "coalesce(try_divide(1.0D * tp * tn - 1.0D * fp * fn, sqrt(1.0D * (tp + fp) * (tp + fn)) * sqrt(1.0D * (tn + fp) * (tn + fn))), 0D)",
    "kappa": f"try_divide({_N} * 1.0D * (tp + tn) - (1.0D * (tp + fp) * (tp + fn) + 1.0D * (tn + fn) * (tn + fp)), "
             f"1.0D * {_N} * {_N} - (1.0D * (tp + fp) * (tp + fn) + 1.0D * (tn + fn) * (tn + fp)))",
    # Areas of hard 0/1 predictions: a curve with a single inner point.
    "roc_label": "(try_divide(tp, tp + fn) + try_divide(tn, tn + fp)) / 2",
    "prc_label": f"coalesce(try_divide(tp, tp + fn) * try_divide(tp, tp + fp), 0D) + try_divide(fn, tp + fn) * try_divide(tp + fn, {_N})",
}


def confusion(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    """The four counts as aggregate columns. Rows without truth or prediction count nowhere."""
    def count(truth: int, guess: int, name: str) -> Column:
        return F.expr(f"count_if({y_true} = {truth} AND {y_pred} = {guess})").alias(name)

    return [count(1, 1, "tp"), count(0, 1, "fp"), count(1, 0, "fn"), count(0, 0, "tn")]


def scores(df: DataFrame, groups: Sequence[str] = (), metrics: Sequence[str] = ("prc_label", "roc_label", "f1", "kappa", "mcc"),
           y_true: str = "y_true", y_pred: str = "y_pred", digits: int | None = None) -> DataFrame:
    """Chosen metrics of hard predictions per group."""
    counts = df.groupBy(*groups).agg(*confusion(y_true, y_pred))
    wrap = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    return counts.selectExpr(*groups, *[f"{wrap(METRICS[m])} AS {m}" for m in metrics])


def class_report(df: DataFrame, groups: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class and as the support-weighted average ``total``."""
    counts = df.groupBy(*groups).agg(*confusion(y_true, y_pred))
    # For class 0 the roles of the two classes are swapped.
    classes = counts.selectExpr(
        *groups, "inline(array(struct('1' AS class, tp AS tp, fp AS fp, fn AS fn, tp + fn AS support), "
                 "struct('0' AS class, tn AS tp, fn AS fp, fp AS fn, tn + fp AS support)))")
    # An undefined value counts as 0, as in the usual printed reports.
    per_class = classes.selectExpr(*groups, "class", "support", *[
        f"coalesce({METRICS[m]}, 0D) AS {m}" for m in ("precision", "recall", "f1")])
    total = per_class.groupBy(*groups).agg(
        F.lit("total").alias("class"), *[F.expr(f"try_divide(sum({m} * support), sum(support))").alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"))
    return per_class.unionByName(total)


def score_counts(df: DataFrame, score: str, truth: str, groups: Sequence[str] = ()) -> DataFrame:
    """Running positives and negatives by falling score: one row per distinct score."""
    return running_totals(
        df.where(f"{truth} IS NOT NULL"), score,
        {"pos": F.col(truth).cast("long"), "neg": (1 - F.col(truth)).cast("long")}, groups, descending=True)


def _totals(df: DataFrame, score: str, truth: str, groups: Sequence[str]) -> DataFrame:
    return df.where(f"{truth} IS NOT NULL AND {score} IS NOT NULL").groupBy(*groups).agg(
        F.expr(f"sum(CAST({truth} AS BIGINT))").alias("p"), F.expr(f"sum(CAST(1 - {truth} AS BIGINT))").alias("q"))


def _with_totals(run: DataFrame, totals: DataFrame, groups: Sequence[str]) -> DataFrame:
    if groups:
        return run.join(totals, list(groups))
    return run.withColumn("__t", totals.select(F.struct("p", "q")).scalar()).selectExpr("*", "__t.p AS p", "__t.q AS q").drop("__t")


def roc_points(df: DataFrame, score: str, truth: str, groups: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at every distinct score, falling."""
    run = _with_totals(score_counts(df, score, truth, groups), _totals(df, score, truth, groups), groups)
    return run.selectExpr(*groups, f"{score} AS threshold", "try_divide(neg_upto, q) AS fpr", "try_divide(pos_upto, p) AS tpr")


def pr_points(df: DataFrame, score: str, truth: str, groups: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score, falling."""
    run = _with_totals(score_counts(df, score, truth, groups), _totals(df, score, truth, groups), groups)
    return run.selectExpr(*groups, f"{score} AS threshold", "pos_upto / (pos_upto + neg_upto) AS precision", "try_divide(pos_upto, p) AS recall")


def ranked_areas(df: DataFrame, score: str, truth: str, groups: Sequence[str] = ()) -> DataFrame:
    """ROC area (ties count half) and average precision from scores, without listing any pair."""
    run = score_counts(df, score, truth, groups)
    sums = run.groupBy(*groups).agg(
        F.expr("sum(neg * (pos_before + pos / 2.0D))").alias("__auc"), F.expr("sum(pos * pos_upto / (pos_upto + neg_upto))").alias("__ap"),
        F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return sums.selectExpr(*groups, "try_divide(__auc, 1.0D * p * q) AS roc_auc", "try_divide(__ap, p) AS average_precision", "p", "q")


def fold_column(key: str, k: int) -> Column:
    """Fold 0 … k-1 of a row by a hash of its key: the same in every run and on every cluster."""
    return F.expr(f"CAST(pmod(xxhash64({key}), {k}) AS INT)")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes · rows of the class)."""
    counts = df.where(f"{label} IS NOT NULL").groupBy(label).agg(F.count("*").alias("n"))
    # One row per class reaches the window.
    w = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


def explode_results(df: DataFrame, arrays: Sequence[str], repeated: Sequence[str]) -> DataFrame:
    """One row per element of parallel arrays, with the scalars of the row repeated."""
    return df.selectExpr(*repeated, f"inline(arrays_zip({', '.join(arrays)}))")


def labelled_results(df: DataFrame, names: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Readable names for coded columns; codes without a name become NULL."""
    def lookup(column: str, words: Mapping[str, str]) -> str:
        pairs = ", ".join(f"'{k}', '{v}'" for k, v in words.items())
        return f"element_at(map({pairs}), {column}) AS {column}"

    return df.selectExpr(*[lookup(c, names[c]) if c in names else c for c in df.columns])


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "score")


def learning_curve(df: DataFrame, size: str, kind: str, score: str) -> DataFrame:
    """Mean and population deviation of a score per training size and set."""
    return df.groupBy(size, kind).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count("*").alias("n"))


def binned_curve(df: DataFrame, group: str, x: str, y: str, bins: int = 100) -> DataFrame:
    """Curves thinned to ``bins`` equal steps of x in 0 … 1, keeping the largest y of each step."""
    step = f"least({bins}, 1 + CAST(floor({x} * {bins}) AS INT)) AS bin"
    return df.selectExpr(group, step, x, y).groupBy(group, "bin").agg(F.max(y).alias(y), F.min(x).alias(x))


def weight_shares(df: DataFrame, group: str, factor: str, weight: str) -> DataFrame:
    """Weight of each factor within its group, as a share of the group, largest first."""
    summed = df.groupBy(group, factor).agg(F.sum(weight).alias("weight"))
    # One row per factor of a group reaches the window.
    return summed.withColumn("share", F.expr(f"try_divide(weight, sum(weight) OVER (PARTITION BY {group}))")).orderBy(group, F.desc("share"), factor)
