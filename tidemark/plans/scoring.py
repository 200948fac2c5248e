"""Queries: scores, curves, reports and result logs, checkable without training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import summarize as Z
from tidemark.plans import base as B
from tidemark.plans.registry import query
from tidemark.plans.summarizing import fits
from tidemark.sources.bindings import define_view, with_views

# A deterministic stand-in for predictions: the truth is a document's quality, the score its length.
define_view("scored", """
    SELECT l.doc_id, lang, source, quality AS y_true, (n_chars % 100) / 100.0::DOUBLE AS score,
           CASE WHEN (n_chars % 100) / 100.0::DOUBLE > 0.4 THEN 1 ELSE 0 END AS y_pred
    FROM labels l JOIN documents d USING (doc_id)""")


def scored(t):
    return t.labels.join(t.documents.drop("text"), "doc_id").selectExpr(
        "doc_id", "lang", "source", "quality AS y_true", "(n_chars % 100) / 100.0D AS score",
        "CASE WHEN (n_chars % 100) / 100.0D > 0.4D THEN 1 ELSE 0 END AS y_pred")


_CONF = ", ".join(f"count(*) FILTER (WHERE y_true = {a} AND y_pred = {b}) AS {n}" for a, b, n in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")))
_N = "(tp + fp + fn + tn)"
_SCORES_SQL = {
    "accuracy": f"(tp + tn) / {_N}", "precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)",
    "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
    "mcc": "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * 1.0) * sqrt((tn + fp) * (tn + fn) * 1.0), 0), 0.0)",
    "kappa": f"((tp + tn) / {_N} - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ({_N} * {_N})) / nullif(1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ({_N} * {_N}), 0)",
    "roc_label": "(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2",
    "prc_label": f"coalesce(tp / nullif(tp + fn, 0) * tp / nullif(tp + fp, 0), 0.0) + fn / nullif(tp + fn, 0) * (tp + fn) / {_N}",
}


@query("binary_scores", with_views("scored", f"""
    WITH c AS (SELECT lang, {_CONF} FROM scored GROUP BY 1)
    SELECT lang, {", ".join(f"round({_SCORES_SQL[m]}, 6) AS {m}" for m in ("prc_label", "roc_label", "f1", "kappa", "mcc"))} FROM c"""))
def binary_scores(t):
    return M.scores(scored(t), ["lang"], digits=6)


_RUN = """s AS (SELECT score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM scored GROUP BY 1),
    c AS (SELECT score AS threshold, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
                 sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM s)"""


@query("roc_curve", with_views("scored", f"WITH {_RUN} SELECT threshold, round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr FROM c"))
def roc_curve(t):
    return M.roc_points(scored(t), "score", "y_true").selectExpr("threshold", "round(fpr, 6) AS fpr", "round(tpr, 6) AS tpr")


@query("pr_curve", with_views("scored", f"WITH {_RUN} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM c"))
def pr_curve(t):
    return M.pr_points(scored(t), "score", "y_true").selectExpr("threshold", "round(precision, 6) AS precision", "round(recall, 6) AS recall")


@query("auc_rank", with_views("scored", """
    WITH r AS (SELECT lang, y_true, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS rk,
                      sum(y_true) OVER (PARTITION BY lang ORDER BY score DESC) / count(*) OVER (PARTITION BY lang ORDER BY score DESC) AS pr FROM scored)
    SELECT lang, round((sum(rk) FILTER (WHERE y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2) / nullif(sum(y_true) * sum(1 - y_true), 0), 6) AS roc_auc,
           round(avg(pr) FILTER (WHERE y_true = 1), 6) AS average_precision FROM r GROUP BY 1"""))
def auc_rank(t):
    return M.ranked_areas(scored(t), "score", "y_true", ["lang"]).selectExpr(
        "lang", "round(roc_auc, 6) AS roc_auc", "round(average_precision, 6) AS average_precision")


@query("confusion_by_group", with_views("scored", f"""
    WITH c AS (SELECT coalesce(source, 'Overall') AS source, {_CONF} FROM scored GROUP BY ROLLUP (source))
    SELECT source, tp, fp, fn, tn, round({_SCORES_SQL['accuracy']}, 6) AS accuracy FROM c"""))
def confusion_by_group(t):
    counts = Z.rolled_up(scored(t), "source", M.confusion())
    return counts.selectExpr("source", "tp", "fp", "fn", "tn", f"round({M.METRICS['accuracy']}, 6) AS accuracy")


@query("class_report", with_views("scored", f"""
    WITH c AS (SELECT lang, {_CONF} FROM scored GROUP BY 1),
    k AS (SELECT lang, '1' AS class, tp AS a, fp AS b, fn AS d FROM c UNION ALL SELECT lang, '0', tn, fn, fp FROM c),
    m AS (SELECT lang, class, coalesce(a / nullif(a + b, 0), 0) AS precision, coalesce(a / nullif(a + d, 0), 0) AS recall,
                 coalesce(2 * a / nullif(2 * a + b + d, 0), 0) AS f1, a + d AS support FROM k)
    SELECT lang, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
    UNION ALL SELECT lang, 'total', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                     round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m GROUP BY 1"""))
def class_report(t):
    return M.class_report(scored(t), ["lang"]).selectExpr(
        "lang", "class", "round(precision, 6) AS precision", "round(recall, 6) AS recall", "round(f1, 6) AS f1", "support")


@query("f1_by_group", with_views("fits", f"""
    WITH pair AS (SELECT 'Combined' AS method, classifier, y_true, y_pred FROM fits UNION ALL
                  SELECT 'Individual', classifier, y_true, CASE WHEN prc > 0.09 THEN 1 ELSE 0 END FROM fits),
    c AS (SELECT method, coalesce(classifier, 'Overall') AS classifier, {_CONF} FROM pair GROUP BY method, ROLLUP (classifier))
    SELECT method, classifier, round({_SCORES_SQL['f1']}, 6) AS f1 FROM c"""))
def f1_by_group(t):
    f = fits(t)
    both = f.selectExpr("'Combined' AS method", "classifier", "y_true", "y_pred").unionByName(
        f.selectExpr("'Individual' AS method", "classifier", "y_true", "CASE WHEN prc > 0.09D THEN 1 ELSE 0 END AS y_pred"))
    return M.scores(Z.with_overall(both, "classifier"), ["method", "classifier"], ["f1"], digits=6)


@query("metrics_long", with_views("fits", " UNION ALL ".join(
    f"SELECT fit_id, feature_date, '{m}' AS metric, round({m}, 6) AS score FROM fits WHERE window_years = 2" for m in ("f1", "mcc", "prc"))))
def metrics_long(t):
    rows = fits(t).where("window_years = 2").selectExpr("fit_id", "feature_date", *[f"round({m}, 6) AS {m}" for m in ("f1", "mcc", "prc")])
    return M.long_metrics(rows, ["fit_id", "feature_date"], ["f1", "mcc", "prc"])


@query("explode_results", """
    SELECT p_partkey AS fit_id, p_brand AS classifier, word, upper(word) AS guess FROM (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS word FROM part)""")
def explode_results(t):
    rows = t.part.selectExpr("p_partkey AS fit_id", "p_brand AS classifier", "split(p_name, ' ') AS word", "split(upper(p_name), ' ') AS guess")
    return M.explode_results(rows, ["word", "guess"], ["fit_id", "classifier"])


# Readable names of event kinds and imputers, standing for classifiers and strategies.
_NAMES = {"classifier": {"view": "Logistic Regression", "click": "Random Forest", "signup": "Decision Tree", "purchase": "Naive Bayes"},
          "imputer": {"p0": "Mean", "p1": "Median", "p2": "Mode"}}


def _case(column):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES[column].items()) + f" END AS {column}"


@query("result_labels", with_views("fits", f"""
    SELECT fit_id, {_case('classifier')}, {_case('imputer')}, feature_date, CAST(feature_date + CAST(window_years * 364 AS INTEGER) AS DATE) AS label_date,
           CAST(CAST(floor(floor(window_years * 364 / 30) / 12) AS INTEGER) AS VARCHAR) || ' Years' AS "window" FROM fits"""))
def result_labels(t):
    from tidemark.operators.slicing import window_label

    rows = fits(t).selectExpr("fit_id", "classifier", "imputer", "feature_date", "date_add(feature_date, CAST(window_years * 364 AS INT)) AS label_date")
    return M.labelled_results(rows, _NAMES).withColumn("window", window_label(F.col("feature_date"), F.col("label_date")))


_STAGE_OF = "CASE l_linenumber % 6 WHEN 0 THEN 'Pre-Seed' WHEN 1 THEN 'Seed' WHEN 2 THEN 'Series A' WHEN 3 THEN 'Series B' WHEN 4 THEN 'Series C' ELSE 'Series D+' END"


@query("weights_by_group", f"""
    WITH w AS (SELECT {_STAGE_OF} AS stage, split_part('confidence_context_' || lower(l_returnflag) || '_x_number', '_', 3) AS factor, l_discount AS weight FROM lineitem),
    e AS (SELECT CASE WHEN stage IN ('Pre-Seed', 'Seed') THEN 'Early' WHEN stage IN ('Series A', 'Series B') THEN 'Mid' ELSE 'Late' END AS phase, factor, sum(weight) AS weight FROM w GROUP BY 1, 2)
    SELECT phase, factor, round(weight, 4) AS weight, round(weight / sum(weight) OVER (PARTITION BY phase), 6) AS share FROM e""")
def weights_by_group(t):
    """Line items stand for fitted feature weights: the factor is the third token of the feature name."""
    w = t.lineitem.selectExpr(
        f"{_STAGE_OF} AS stage", "split_part(concat('confidence_context_', lower(l_returnflag), '_x_number'), '_', 3) AS factor", "l_discount AS weight")
    phase = w.withColumn("phase", L.ladder([("stage IN ('Pre-Seed', 'Seed')", "Early"), ("stage IN ('Series A', 'Series B')", "Mid")], "Late"))
    return M.weight_shares(phase, "phase", "factor", "weight").selectExpr("phase", "factor", "round(weight, 4) AS weight", "round(share, 6) AS share")


@query("learning_curve", with_views("fits", """
    SELECT params AS size, imputer AS dataset, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, count(*) AS n FROM fits GROUP BY 1, 2"""))
def learning_curve(t):
    rows = fits(t).selectExpr("params AS size", "imputer AS dataset", "f1")
    return M.learning_curve(rows, "size", "dataset", "f1").selectExpr("size", "dataset", "round(mean, 6) AS mean", "round(std, 6) AS std", "n")


@query("binned_curve", with_views("fits", """
    WITH b AS (SELECT classifier, least(100, 1 + CAST(floor(auc * 2 * 100) AS INTEGER)) AS bin, auc * 2 AS x, prc AS y FROM fits),
    a AS (SELECT classifier, max(prc) AS best FROM fits GROUP BY 1)
    SELECT classifier, bin, round(max(y), 6) AS y, round(min(x), 6) AS x, round(max(best), 6) AS best FROM b JOIN a USING (classifier) GROUP BY 1, 2"""))
def binned_curve(t):
    rows = fits(t).selectExpr("classifier", "auc * 2 AS x", "prc AS y")
    best = rows.groupBy("classifier").agg(F.max("y").alias("best"))
    return M.binned_curve(rows, "classifier", "x", "y").join(best, "classifier").selectExpr(
        "classifier", "bin", "round(y, 6) AS y", "round(x, 6) AS x", "round(best, 6) AS best")


@query("class_weights", "SELECT quality, n, round(total / (k * n), 6) AS weight FROM (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k FROM labels GROUP BY 1)")
def class_weights(t):
    return M.class_weights(t.labels, "quality").withColumn("weight", F.round("weight", 6))


@query("fold_assign", """
    SELECT CAST(o_orderkey * 7919 % 5 AS INTEGER) AS fold, CASE WHEN o_orderkey * 7919 % 2 = 0 THEN 'train' ELSE 'test' END AS half, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1, 2""")
def fold_assign(t):
    return t.orders.groupBy(F.expr("CAST(o_orderkey * 7919 % 5 AS INT)").alias("fold"), F.expr("CASE WHEN o_orderkey * 7919 % 2 = 0 THEN 'train' ELSE 'test' END").alias("half")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("prediction_profiles", with_views("one_forecast", f"""
    WITH p AS (SELECT keys_company_id, keys_company_name_id, keys_company_stage, outcome_stage, {B.EXTRA_STAGE_SQL} AS y_true,
                      CASE WHEN {B.ROUNDS} >= 3 THEN 1 ELSE 0 END AS y_pred,
                      {" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in (B.AGE, B.RAISED, f"{B.CODE}a"))} AS missing FROM one_forecast)
    SELECT *, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS correct FROM p"""))
def prediction_profiles(t):
    df = B.forecast_frame(t).withColumn("y_true", L.label())
    guesses = B.forecast_frame(t).selectExpr("keys_company_id", f"CASE WHEN {B.ROUNDS} >= 3 THEN 1 ELSE 0 END AS y_pred")
    missing = " + ".join(f"CAST({c} IS NULL AS INT)" for c in (B.AGE, B.RAISED, f"{B.CODE}a"))
    return df.join(guesses, "keys_company_id").selectExpr(
        "keys_company_id", "keys_company_name_id", "keys_company_stage", "outcome_stage", "y_true", "y_pred", f"{missing} AS missing",
        "CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS correct")
