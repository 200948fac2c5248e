"""Queries: preprocessing, classifiers, search, evaluation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.learning import classifiers as C
from tidemark.learning import preprocess as R
from tidemark.learning import search as H
from tidemark.learning.neighbours import nearest_neighbours, vote
from tidemark.learning.stability import stability_frequencies
from tidemark.operators import labels as L
from tidemark.operators.metrics import fold_column
from tidemark.plans import base as B
from tidemark.plans.registry import query
from tidemark.session import materialize
from tidemark.sources.bindings import with_views

_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("impute_median", """
    SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END, (SELECT quantile_cont(CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END, 0.5) FROM part)) AS price,
           coalesce(CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END, (SELECT quantile_cont(CASE WHEN p_partkey % 3 <> 0 THEN p_size END, 0.5) FROM part)) AS size FROM part""")
def impute_median(t):
    rows = t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price", "CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS size")
    return R.impute(rows, ["price", "size"], "median")


def _scaled(t, kind):
    rows = t.customer.selectExpr("c_custkey", "c_acctbal", "CAST(c_nationkey AS DOUBLE) AS nation")
    return R.scale(rows, ["c_acctbal", "nation"], kind).selectExpr("c_custkey", "round(c_acctbal, 6) AS c_acctbal", "round(nation, 6) AS nation")


def _scaled_sql(center, spread):
    def one(c, name):
        return f"round(({c} - (SELECT {center.format(c=c)} FROM customer)) / (SELECT {spread.format(c=c)} FROM customer), 6) AS {name}"
    return f"SELECT c_custkey, {one('c_acctbal', 'c_acctbal')}, {one('c_nationkey', 'nation')} FROM customer"


@query("scale_minmax", _scaled_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(t):
    return _scaled(t, "minmax")


@query("scale_robust", _scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(t):
    return _scaled(t, "robust")


@query("scale_standard", _scaled_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(t):
    return _scaled(t, "standard")


@query("variance_filter", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_pop({c}), 6) AS variance, var_pop({c}) > 0.2 AS kept FROM lineitem" for c in _LINE))
def variance_filter(t):
    return R.variances(t.lineitem, _LINE, 0.2).withColumn("variance", F.round("variance", 6))


@query("anova_f", "WITH x AS (SELECT l_returnflag AS y, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), " + ", ".join(
    f"""c{i} AS (SELECT y, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM x GROUP BY y),
    r{i} AS (SELECT '{c}' AS "column", (sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f FROM c{i})"""
    for i, c in enumerate(_LINE)) + " " + " UNION ALL ".join(f'SELECT "column", round(f, 3) AS f FROM r{i}' for i in range(len(_LINE))))
def anova_f(t):
    return R.anova_f(t.lineitem, _LINE, "l_returnflag").withColumn("f", F.round("f", 3))


_CHI = {"quantity": "l_quantity", "price": "l_extendedprice / 1000", "discount": "l_discount * 100", "tax": "l_tax * 100",
        "line": "CAST(l_linenumber AS DOUBLE)", "late": "CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END"}


@query("chi2_select", f"WITH x AS (SELECT l_returnflag AS y, {', '.join(f'{e} AS {c}' for c, e in _CHI.items())} FROM lineitem), l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, y, count({c}) AS n, sum({c}) AS s FROM x GROUP BY y" for c in _CHI) + """),
    e AS (SELECT col, s, sum(s) OVER (PARTITION BY col) * n / sum(n) OVER (PARTITION BY col) AS e FROM l),
    c AS (SELECT col, sum((s - e) * (s - e) / e) AS chi2, count(*) - 1 AS freedom FROM e GROUP BY col)
    SELECT col AS "column", round(chi2, 6) AS chi2, CAST(freedom AS BIGINT) AS freedom, round(exp(-chi2 / 2), 9) AS p, row_number() OVER (ORDER BY chi2 DESC) <= 3 AS selected FROM c""")
def chi2_select(t):
    """Three classes, so two degrees of freedom."""
    rows = t.lineitem.selectExpr("l_returnflag", *[f"{e} AS {c}" for c, e in _CHI.items()])
    scores = R.chi2_scores(rows, list(_CHI), "l_returnflag")
    best = R.best_columns(scores, top=3)
    return t.spark.createDataFrame([(c, x, 2, p, c in best) for c, x, p in scores], "column string, chi2 double, freedom long, p double, selected boolean").selectExpr(
        "column", "round(chi2, 6) AS chi2", "freedom", "round(p, 9) AS p", "selected")


@query("mutual_information", "WITH x AS (SELECT l_returnflag AS y, CAST(floor(l_quantity / 10) AS DOUBLE) AS quantity, CAST(l_linenumber AS DOUBLE) AS line FROM lineitem), " + ", ".join(
    f"""j_{c} AS (SELECT {c} AS v, y, count(*) AS n FROM x GROUP BY 1, 2),
    m_{c} AS (SELECT n, sum(n) OVER (PARTITION BY v) AS nv, sum(n) OVER (PARTITION BY y) AS nc, sum(n) OVER () AS t FROM j_{c})""" for c in ("quantity", "line"))
    + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(sum(n / t * ln(n * t / (nv * nc))), 9) AS mi FROM m_{c}" for c in ("quantity", "line")))
def mutual_information(t):
    rows = t.lineitem.selectExpr("l_returnflag", "floor(l_quantity / 10) AS quantity", "l_linenumber AS line")
    return R.mutual_information(rows, ["quantity", "line"], "l_returnflag").withColumn("mi", F.round("mi", 9))


@query("knn_vote", """
    WITH p AS (SELECT q.vec_id, t.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS d, t.vec_id AS other
               FROM embeddings q JOIN embeddings t ON q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS place FROM p QUALIFY place <= 7),
    v AS (SELECT vec_id, label, count(*) AS votes, sum(1 / d) AS weight FROM n GROUP BY 1, 2)
    SELECT vec_id, arg_min(label, (-votes, label)) AS uniform_vote, round(max(votes) / sum(votes), 6) AS uniform_share,
           arg_min(label, (-round(weight, 9), label)) AS distance_vote, round(max(weight) / sum(weight), 6) AS distance_share FROM v GROUP BY 1""")
def knn_vote(t):
    """Every fifth vector is a query, all the others are the training set."""
    vectors = t.embeddings.selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v", "label")
    near = materialize(nearest_neighbours(vectors.where("vec_id % 5 <> 0"), vectors.where("vec_id % 5 = 0"), "vec_id", "v", 7, "label"), "neighbours")
    plain, weighted = vote(near, "vec_id", "label"), vote(near, "vec_id", "label", weighted=True)
    return plain.selectExpr("vec_id", "prediction AS uniform_vote", "round(share, 6) AS uniform_share").join(
        weighted.selectExpr("vec_id", "prediction AS distance_vote", "round(share, 6) AS distance_share"), "vec_id")


#: All features of the flagship's rows.
FEATURES = [B.AGE, B.ROUNDS, B.RAISED, B.PATENTS, B.STAFF, *[f"{B.CODE}{c}" for c in B.ROUND_CODES], *[f"{B.SEGMENT}{s}" for s in B.SEGMENTS]]


def learning_rows(t, pairs=B.ONE_PAIR, fitted_on=None):
    """The forecast dataset with its label, written once: every fit reads it again. Later slices are staged by those they are ``fitted_on``."""
    df = B.forecast_frame(t, pairs, detail=True, fitted_on=fitted_on)
    keep = [c for c in df.columns if c.startswith(("keys", "outcome")) and c not in FEATURES]
    rows = df.selectExpr(*keep, *[f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES])
    return materialize(rows.withColumn("label", L.label()), "learning")


def halves(rows):
    folded = rows.withColumn("__h", fold_column("keys_company_id", 2))
    return folded.where("__h = 0").drop("__h"), folded.where("__h = 1").drop("__h")


def predictions(t, algorithm, params=None, **prep):
    train, test = halves(learning_rows(t))
    fitted = C.fit(train, FEATURES, algorithm, params, {"imputer": "median", "transform": "sqrt", "scaler": "standard", **prep})
    return fitted.predict(test).selectExpr("keys_company_id", "keys_company_stage", "label", "prediction", "round(score, 4) AS score")


@query("clf_nb")
def clf_nb(t):
    return predictions(t, "NB")


@query("clf_lr")
def clf_lr(t):
    return predictions(t, "LR", {"C": 0.1, "penalty": "l2"})


@query("clf_dt")
def clf_dt(t):
    return predictions(t, "DT", {"max_depth": 6, "criterion": "entropy"})


@query("clf_rf")
def clf_rf(t):
    return predictions(t, "RF", {"n_estimators": 20, "max_depth": 6, "criterion": "entropy"}, components=6)


@query("clf_knn")
def clf_knn(t):
    return predictions(t, "KNN", {"n_neighbors": 9, "weights": "distance"})


@query("clf_svm_calibrated")
def clf_svm(t):
    return predictions(t, "SVM", {"C": 0.1, "max_iter": 20})


@query("clf_mlp")
def clf_mlp(t):
    return predictions(t, "ANN")


@query("gmm_split")
def gmm_split(t):
    rows = B.staged_frame(t, sides=(L.FEATURE_COLUMNS,)).where("keys_company_stage IN ('Other', 'Pre-Seed')").selectExpr(
        "keys_company_id", "keys_company_stage", "-keys_company_age_days AS founded")
    return C.gaussian_split(rows, "founded").select("keys_company_id", "keys_company_stage", "split")


@query("random_search")
def random_search(t):
    rows = learning_rows(t)
    space = {"imputer": ["mean", "median", "mode"], "transform": [None, "log1p", "sqrt"], "scaler": ["standard", "minmax"]}
    return H.random_search(rows, FEATURES, ["LR", "NB"], 2, folds=2, seed=7, prep_space=space).drop("context", "seconds")


@query("feature_weights")
def feature_weights(t):
    fitted = C.fit(learning_rows(t), FEATURES, "RF", {"n_estimators": 20, "max_depth": 6}, {"scaler": None}, extractor=False)
    weights = t.spark.createDataFrame(C.feature_weights(fitted, FEATURES), "feature string, weight double")
    return weights.orderBy(F.desc("weight"), "feature").limit(20)


@query("select_finalist")
def select_finalist(t):
    """Candidates ranked on one slice, the finalists scored again on a later one."""
    later = ((date(1997, 6, 1), date(1997, 6, 1) + timedelta(days=728)),)
    prep = {"imputer": "median", "transform": "log1p", "scaler": "standard"}
    log = H.search(learning_rows(t), FEATURES, [("LR", {"C": c, "max_iter": 20}, prep) for c in (0.01, 1.0)] + [("NB", {}, prep)], folds=2)
    best, scored = H.select_finalist(log, [learning_rows(t, later)], FEATURES, "f1", top_n=2, folds=2)
    return scored.withColumn("is_best", F.col("candidate") == H.candidate_id(**best)).drop("context", "seconds")


@query("experiment_matrix")
def experiment_matrix(t):
    train, test = halves(learning_rows(t))
    winner = {"algorithm": "LR", "params": {"C": 0.1, "max_iter": 20}, "prep": {"imputer": "median", "transform": "sqrt", "scaler": "standard"}}
    log = H.experiment_matrix(train, test, FEATURES, winner, L.label, ["Extra_Stage", "Extra_Round"], [None, *L.INCLUDED_STAGES], [0.316, 1.0], unfitted=True)
    return log.selectExpr("context['label_type'] AS label_type", "context['stage'] AS stage", "context['fraction'] AS fraction",
                          "context['dataset'] AS dataset", "rows", "f1", "mcc", "prc", "roc")


@query("fisher_direction")
def fisher_direction(t):
    rows = R.impute(learning_rows(t), FEATURES, "mean")
    return t.spark.createDataFrame(C.fisher_direction(rows, FEATURES), "feature string, weight double")


@query("stability_selection")
def stability_selection(t):
    return stability_frequencies(learning_rows(t), FEATURES, rounds=200)
