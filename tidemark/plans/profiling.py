"""Queries: profiles, moments, correlations, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.naming import factor_of
from tidemark.operators import labels as L
from tidemark.operators import profile as P
from tidemark.operators.concordance import kendall_tau
from tidemark.operators.quantiles import exact_modes, exact_quantiles, melt
from tidemark.operators.summarize import group_quantiles
from tidemark.plans import base as B
from tidemark.plans.registry import query
from tidemark.plans.summarizing import fits
from tidemark.session import materialize
from tidemark.sources.bindings import with_views

_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _normality_sql(source: str) -> str:
    """The same closed form, step by step, for the check engine."""
    sql = f"({source})"
    for step in P.normality_steps():
        sql = f"(SELECT *, {', '.join(step)} FROM {sql} q)"
    return sql


def _profile_sql(table: str, numeric: dict[str, str], text: tuple[str, ...]) -> str:
    num = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{d}' AS datatype, count({c}) AS n, count(*) - count({c}) AS missing, avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, "
        f"skewness({c}) AS skew, kurtosis({c}) AS kurtosis, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) AS g1, kurtosis_pop({c}) AS g2 FROM {table}"
        for c, d in numeric.items())
    cat = " UNION ALL ".join(
        f"""SELECT '{c}', 'string', count({c}), count(*) - count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}),
            (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1),
            (SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) FROM {table}""" for c in text)
    return f"""SELECT "column", datatype, n AS count, missing, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min, round(p25, 4) AS p25,
        round(p50, 4) AS p50, round(p75, 4) AS p75, round(hi, 4) AS max, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis,
        round(k2, 3) AS norm_k2, round(p_value, 4) AS norm_pval, CAST(NULL AS BIGINT) AS "distinct", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq
        FROM {_normality_sql(num)} z UNION ALL {cat}"""


_ROUNDED = {"mean": 4, "std": 4, "min": 4, "p25": 4, "p50": 4, "p75": 4, "max": 4, "skew": 4, "kurtosis": 4, "norm_k2": 3, "norm_pval": 4}


def _rounded(df):
    return df.selectExpr(*[f"round({c}, {_ROUNDED[c]}) AS {c}" if c in _ROUNDED else f"`{c}`" for c in df.columns])


_PART_NUM = {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double"}
_PART_TEXT = ("p_name", "p_brand", "p_type")
_SUPP_NUM = {"s_suppkey": "bigint", "s_nationkey": "int", "s_acctbal": "double"}


@query("column_profile", _profile_sql("part", _PART_NUM, _PART_TEXT))
def column_profile(t):
    return _rounded(P.column_profile(t.part))


#: All given tables: numbers (lists by their lengths), then texts and times, with their types.
_ALL = {
    "benchmark": ({"item_id": "bigint"}, {"text": "string"}),
    "conversations": ({"conv_id": "bigint", "turn": "bigint"}, {"role": "string", "text": "string"}),
    "customer": ({"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}, {"c_name": "string", "c_mktsegment": "string"}),
    "documents": ({"doc_id": "bigint", "n_chars": "bigint"}, {"text": "string", "lang": "string", "source": "string"}),
    "embeddings": ({"vec_id": "bigint", "embedding": "array<float>", "label": "int"}, {}),
    "events": ({"event_id": "bigint", "user_id": "bigint", "value": "double"}, {"ts": "timestamp_ntz", "event_type": "string", "props": "string"}),
    "labels": ({"doc_id": "bigint", "quality": "int", "toxic": "int"}, {}),
    "lineitem": ({"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
                  "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"},
                 {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}),
    "nation": ({"n_nationkey": "int", "n_regionkey": "int"}, {"n_name": "string"}),
    "orders": ({"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"},
               {"o_orderstatus": "string", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}),
    "pages": ({"page_id": "bigint"}, {"url": "string", "html": "string"}),
    "part": (_PART_NUM, dict.fromkeys(_PART_TEXT, "string")),
    "region": ({"r_regionkey": "int"}, {"r_name": "string"}),
    "supplier": (_SUPP_NUM, {"s_name": "string"}),
}


def _dictionary_sql() -> str:
    def number(t, c, d):
        x = f"len({c})" if d.startswith("array") else c
        varied = f"CASE WHEN max({x}) > min({x}) THEN"
        return f"""SELECT '{t}' AS relation, '{c}' AS "column", '{d}' AS datatype, count({x}) AS n, count(*) - count({x}) AS missing, avg({x}) AS mean,
            stddev_samp({x}) AS std, CAST(min({x}) AS DOUBLE) AS lo, CAST(max({x}) AS DOUBLE) AS hi, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50,
            quantile_cont({x}, 0.75) AS p75, {varied} skewness({x}) END AS skew, {varied} kurtosis({x}) END AS kurtosis,
            {varied} skewness({x}) * (count({x}) - 2) / sqrt(count({x}) * (count({x}) - 1.0)) END AS g1, {varied} kurtosis_pop({x}) END AS g2 FROM {t}"""

    def text(t, c, d):
        x = f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if d.startswith("timestamp") else c
        return f"""SELECT '{t}' AS relation, '{c}' AS "column", '{d}' AS datatype, {x} AS value, count(*) AS c FROM {t} GROUP BY ALL"""

    numbers = " UNION ALL ".join(number(t, c, d) for t, (num, _) in _ALL.items() for c, d in num.items())
    texts = " UNION ALL ".join(text(t, c, d) for t, (_, cat) in _ALL.items() for c, d in cat.items())
    return f"""WITH x AS ({numbers}), v AS ({texts}),
        k AS (SELECT relation, "column", k2, p_value FROM {_normality_sql("SELECT * FROM x WHERE n >= 8 AND g1 IS NOT NULL")} z)
        SELECT relation, "column", datatype, n AS count, missing, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min, round(p25, 4) AS p25,
            round(p50, 4) AS p50, round(p75, 4) AS p75, round(hi, 4) AS max, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round(k2, 3) AS norm_k2,
            round(p_value, 4) AS norm_pval, CAST(NULL AS BIGINT) AS "distinct", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq
        FROM x LEFT JOIN k USING (relation, "column")
        UNION ALL SELECT relation, "column", datatype, CAST(coalesce(sum(c) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT),
            CAST(coalesce(sum(c) FILTER (WHERE value IS NULL), 0) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
            count(value), arg_min(value, (-c, value)) FILTER (WHERE value IS NOT NULL), max(c) FILTER (WHERE value IS NOT NULL) FROM v GROUP BY 1, 2, 3"""


@query("snapshot_dictionary", _dictionary_sql())
def snapshot_dictionary(t):
    """The columns of all given tables."""
    return _rounded(P.snapshot_dictionary({name: t.table(name) for name in _ALL}))


_MOMENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) AS g1, kurtosis_pop({c}) AS g2 FROM lineitem"
    for c in _LINE)


@query("normality_k2", f"""SELECT "column", n, round(k2, 3) AS k2, round(p_value, 6) AS p_value FROM {_normality_sql(_MOMENTS)} z""")
def normality_k2(t):
    return P.add_normality(P.numeric_moments(t.lineitem, _LINE).select("column", "n", "g1", "g2")).selectExpr(
        "column", "n", "round(k2, 3) AS k2", "round(p_value, 6) AS p_value")


@query("feature_moments", f"""SELECT "column", n, round(g1, 6) AS skew, round(g2, 6) AS kurtosis FROM ({_MOMENTS}) m""")
def feature_moments(t):
    return P.numeric_moments(t.lineitem, _LINE).selectExpr("column", "n", "round(g1, 6) AS skew", "round(g2, 6) AS kurtosis")


@query("feature_iqr", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(ln(1 + quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 6) AS log_iqr FROM lineitem" for c in _LINE))
def feature_iqr(t):
    q = exact_quantiles(melt(t.lineitem, [], _LINE), ["column"], "value", (0.25, 0.75))
    return q.selectExpr("column", "round(log1p(p75 - p25), 6) AS log_iqr")


@query("central_tendency", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(ln(1 + avg({c})), 6) AS mean, round(ln(1 + quantile_cont({c}, 0.5)), 6) AS median,
    round(ln(1 + abs((SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1))), 6) AS mode FROM lineitem""" for c in _LINE))
def central_tendency(t):
    long = melt(t.lineitem, [], _LINE)
    means = long.groupBy("column").agg(F.avg("value").alias("mean"))
    medians = exact_quantiles(long, ["column"], "value", [0.5])
    modes = exact_modes(long, ["column"], "value").select("column", "mode")
    return means.join(medians, "column").join(modes, "column").selectExpr(
        "column", "round(log1p(mean), 6) AS mean", "round(log1p(p50), 6) AS median", "round(log1p(abs(mode)), 6) AS mode")


_FEATURES = [B.AGE, B.ROUNDS, B.RAISED] + [f"{B.CODE}{c}" for c in "abcdefgh"]


@query("sparsity_rows", with_views("one_joined", f"""
    SELECT {" + ".join(f"CAST(f_{c} IS NOT NULL AS INTEGER)" for c in ["age", "rounds", "raised"] + [f"code_{x}" for x in "abcdefgh"])} AS available, count(*) AS n
    FROM one_joined GROUP BY 1"""))
def sparsity_rows(t):
    available = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in _FEATURES)
    return B.merged_frame(t).groupBy(F.expr(available).alias("available")).agg(F.count("*").alias("n"))


@query("sparsity_columns", with_views("one_joined", " UNION ALL ".join(
    f"SELECT '{long}' AS feature, count(f_{short}) AS observations FROM one_joined"
    for long, short in zip(_FEATURES, ["age", "rounds", "raised"] + [f"code_{x}" for x in "abcdefgh"]))))
def sparsity_columns(t):
    counts = ", ".join(f"struct('{c}' AS feature, count({c}) AS observations)" for c in _FEATURES)
    return B.merged_frame(t).agg(F.expr(f"array({counts})").alias("s")).selectExpr("inline(s)")


_CORR = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "nullif(l_discount, 0)", "tax": "nullif(l_tax, 0)", "line": "l_linenumber", "net": "l_extendedprice * (1 - l_discount)"}


def _pairs(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]


_THRESHOLDS = [i / 10 for i in range(1, 10)]


@query("corr_thresholds", f"""
    WITH x AS (SELECT {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _CORR.items())} FROM lineitem),
    c AS ({" UNION ALL ".join(f"SELECT abs(corr({a}, {b})) AS r, 2 AS weight FROM x" for a, b in _pairs(list(_CORR)))}
          UNION ALL SELECT 1.0, {len(_CORR)})
    SELECT th AS threshold, round(sum(CASE WHEN r >= th THEN weight ELSE 0 END) * 100.0 / sum(weight), 6) AS percent
    FROM c, (VALUES {", ".join(f"({x}::DOUBLE)" for x in _THRESHOLDS)}) v(th) GROUP BY 1""")
def corr_thresholds(t):
    x = t.lineitem.selectExpr(*[f"CAST({e} AS DOUBLE) AS {n}" for n, e in _CORR.items()])
    return P.share_above(P.pairwise_pearson(x, list(_CORR)), len(_CORR), _THRESHOLDS).withColumn("percent", F.round("percent", 6))


_RANKED = {"price": "o_totalprice", "customer": "o_custkey", "digit": "o_orderkey * 7919 % 10"}


@query("corr_spearman", f"""
    WITH x AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _RANKED.items())} FROM orders),
    r AS (SELECT {", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _RANKED)} FROM x)
    {" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for a, b in _pairs(list(_RANKED)))}""")
def corr_spearman(t):
    x = t.orders.selectExpr("o_orderkey", *[f"{e} AS {c}" for c, e in _RANKED.items()])
    return P.pairwise_spearman(x, ["o_orderkey"], list(_RANKED)).withColumn("r", F.round("r", 6))


# Columns with other gaps each, one without, and one with the gaps of the first.
_GAPPED = {"price": "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END", "customer": "CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END",
           "digit": "o_orderkey * 7919 % 10", "half": "CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice / 2000) END"}


@query("corr_spearman_gaps", f"""
    WITH x AS (SELECT {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _GAPPED.items())} FROM orders)
    """ + " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, round((SELECT corr(p, q) FROM (
        SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS p, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS q
        FROM x WHERE {a} IS NOT NULL AND {b} IS NOT NULL)), 6) AS r""" for a, b in _pairs(list(_GAPPED))))
def corr_spearman_gaps(t):
    x = t.orders.selectExpr("o_orderkey", *[f"{e} AS {c}" for c, e in _GAPPED.items()])
    return P.pairwise_spearman(x, ["o_orderkey"], list(_GAPPED)).withColumn("r", F.round("r", 6))


def dense_features(t):
    """Feature rows with gaps filled by zero, for operators on complete columns."""
    names = [B.AGE, B.ROUNDS, B.RAISED, B.PATENTS, B.STAFF, *[f"{B.CODE}{c}" for c in B.ROUND_CODES], *[f"{B.SEGMENT}{s}" for s in B.SEGMENTS]]
    df = B.forecast_frame(t, detail=True)
    dense = df.selectExpr("keys_company_id", *[f"coalesce(CAST({n} AS DOUBLE), 0D) AS {n}" for n in names])
    return materialize(dense, "features"), names  # read several times below


@query("kendall", """
    WITH x AS (SELECT c_nationkey AS x, CASE WHEN c_custkey % 5 = 0 THEN 100.0 ELSE c_acctbal END AS y, c_custkey AS id FROM customer)
    SELECT (SELECT count(*) FROM x) AS n,
           round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / (sqrt(sum(CAST(a.x <> b.x AS INTEGER))) * sqrt(sum(CAST(a.y <> b.y AS INTEGER)))), 9) AS tau
    FROM x a JOIN x b ON a.id < b.id""")
def kendall(t):
    x = t.customer.selectExpr("c_nationkey AS x", "CASE WHEN c_custkey % 5 = 0 THEN 100.0D ELSE c_acctbal END AS y")
    return kendall_tau(x, "x", "y").withColumn("tau", F.round("tau", 9))


@query("factor_correlation")
def factor_correlation(t):
    df, names = dense_features(t)
    return P.factor_correlation(df, ["keys_company_id"], names)


@query("histogram", """
    SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 26 ELSE 1 + CAST(floor(o_totalprice / 20000) AS BIGINT) END AS bin, count(*) AS n
    FROM orders GROUP BY 1""")
def histogram(t):
    return P.histogram(t.orders, "o_totalprice", 0, 500000, 25)


@query("box_summary", with_views("one_forecast", f"""
    SELECT keys_company_stage AS stage, round(min({B.AGE}), 6) AS low, round(quantile_cont({B.AGE}, 0.25), 6) AS q1, round(quantile_cont({B.AGE}, 0.5), 6) AS median,
           round(quantile_cont({B.AGE}, 0.75), 6) AS q3, round(max({B.AGE}), 6) AS high FROM one_forecast GROUP BY 1"""))
def box_summary(t):
    df = B.forecast_frame(t).withColumnRenamed("keys_company_stage", "stage")
    q = group_quantiles(df, ["stage"], [B.AGE], (0.0, 0.25, 0.5, 0.75, 1.0))
    return q.selectExpr("stage", *[f"round({B.AGE}_p{p}, 6) AS {n}" for p, n in ((0, "low"), (25, "q1"), (50, "median"), (75, "q3"), (100, "high"))])


@query("pca_scree")
def pca_scree(t):
    df, names = dense_features(t)
    values, _ = P.scree(df, names)
    total, run, rows = float(values.sum()), 0.0, []
    for i, v in enumerate(values):
        run += float(v)
        rows.append((i + 1, float(v), run / total))
    return t.spark.createDataFrame(rows, "component int, eigenvalue double, cumulative double")


@query("pca_loadings")
def pca_loadings(t):
    df, names = dense_features(t)
    _, vectors = P.scree(df, names)
    rows = [(factor_of(n), k + 1, abs(float(vectors[i, k]))) for i, n in enumerate(names) for k in range(2)]
    long = t.spark.createDataFrame(rows, "factor string, component int, loading double")
    return long.groupBy("factor", "component").agg(F.sum("loading").alias("loading"))


@query("project_2d", """
    WITH x AS (SELECT c_custkey, c_mktsegment, c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, 0.5 * atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) AS t FROM x),
    s AS (SELECT ma, mb, cos(t) * CASE WHEN (CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END) < 0 THEN -1 ELSE 1 END AS u1,
                 sin(t) * CASE WHEN (CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END) < 0 THEN -1 ELSE 1 END AS u2,
                 -sin(t) * CASE WHEN (CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN -sin(t) ELSE cos(t) END) < 0 THEN -1 ELSE 1 END AS v1,
                 cos(t) * CASE WHEN (CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN -sin(t) ELSE cos(t) END) < 0 THEN -1 ELSE 1 END AS v2 FROM m)
    SELECT c_custkey, c_mktsegment AS label, round(u1 * (a - ma) + u2 * (b - mb), 5) AS pc1, round(v1 * (a - ma) + v2 * (b - mb), 5) AS pc2 FROM x, s""")
def project_2d(t):
    """The two main axes of two columns, each row with its label."""
    rows = t.customer.selectExpr("c_custkey", "c_mktsegment AS label", "c_acctbal / 1000 AS a", "c_nationkey AS b")
    return P.project(rows, ["a", "b"], ["c_custkey", "label"]).selectExpr("c_custkey", "label", "round(pc1, 5) AS pc1", "round(pc2, 5) AS pc2")


@query("score_trend_r2", with_views("fits", """
    SELECT classifier, round(power(corr(epoch(CAST(feature_date AS TIMESTAMP)), prc), 2), 6) AS r2, count(*) AS n FROM fits GROUP BY 1"""))
def score_trend_r2(t):
    day = F.unix_timestamp(F.col("feature_date").cast("timestamp")).cast("double")
    return fits(t).groupBy("classifier").agg(F.round(F.pow(F.corr(day, "prc"), 2), 6).alias("r2"), F.count("*").alias("n"))


@query("shift_positive", "SELECT c_custkey, round(c_acctbal - (SELECT min(c_acctbal) FROM customer), 4) AS c_acctbal FROM customer")
def shift_positive(t):
    return P.shift_positive(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


def _skew_pop(e):
    return f"skewness({e}) * (count({e}) - 2) / sqrt(count({e}) * (count({e}) - 1.0))"


@query("transform_compare", "WITH x AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END AS v FROM orders) " + " UNION ALL ".join(
    f"SELECT '{n}' AS method, round({_skew_pop(e)}, 6) AS skew, round(kurtosis_pop({e}), 6) AS kurtosis, round({_skew_pop(f'nullif({e}, 0)')}, 6) AS skew_nonzero, "
    f"round(kurtosis_pop(nullif({e}, 0)), 6) AS kurtosis_nonzero FROM x" for n, e in (("None", "v"), ("Log1P", "ln(1 + v)"), ("SQRT", "sqrt(v)"))))
def transform_compare(t):
    x = t.orders.selectExpr("CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END AS v")
    return P.transform_comparison(x, "v").selectExpr("method", *[f"round({c}, 6) AS {c}" for c in ("skew", "kurtosis", "skew_nonzero", "kurtosis_nonzero")])


@query("class_balance", with_views("one_forecast", f"""
    SELECT keys_company_stage AS stage, count(*) AS n, round(avg({B.EXTRA_STAGE_SQL}), 6) AS chance FROM one_forecast GROUP BY 1"""))
def class_balance(t):
    rows = B.forecast_frame(t).select(F.col("keys_company_stage").alias("stage"), L.label().alias("label"))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("chance"))
