"""Queries: grouped reports, windows, ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import summarize as Z
from tidemark.operators.quantiles import exact_modes, exact_quantiles, running_totals
from tidemark.operators.slicing import unix_seconds_sql, window_years
from tidemark.plans import base as B
from tidemark.plans.registry import query
from tidemark.sources.bindings import TABLES, define_view, with_views

OUTCOMES = ("Raised", "Acquired", "IPO", "Closed", "No Change")
ORDERED_STAGES = L.INCLUDED_STAGES


def col_name(stage: str) -> str:
    return stage.lower().replace(" ", "_").replace("+", "_plus").replace("-", "_")


# Events stand for the log of fits: one fit per event, its classifier, parameters and scores.
define_view("fits", """
    SELECT event_id AS fit_id, event_type AS classifier, user_id AS params, 'p' || CAST(user_id % 3 AS VARCHAR) AS imputer,
           value / 500 AS prc, CASE WHEN event_id % 6 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 END AS roc,
           CAST(json_extract_string(props, '$.k') AS INTEGER) / 200 AS auc, (value / 500) * 0.9 AS f1, value / 1000 AS mcc,
           value * 3 AS seconds, CAST(ts AS DATE) AS feature_date, 2 + event_id % 3 AS window_years,
           CASE WHEN value > 40 THEN 1 ELSE 0 END AS y_true,
           CASE WHEN value + CAST(json_extract_string(props, '$.k') AS INTEGER) > 80 THEN 1 ELSE 0 END AS y_pred
    FROM events""")


def fits(t):
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    return t.events.selectExpr(
        "event_id AS fit_id", "event_type AS classifier", "user_id AS params", "concat('p', user_id % 3) AS imputer",
        "value / 500 AS prc", f"CASE WHEN event_id % 6 <> 0 THEN {k} / 100 END AS roc", f"{k} / 200 AS auc",
        "(value / 500) * 0.9D AS f1", "value / 1000 AS mcc", "value * 3 AS seconds", "CAST(ts AS DATE) AS feature_date",
        "2 + event_id % 3 AS window_years", "CASE WHEN value > 40 THEN 1 ELSE 0 END AS y_true",
        f"CASE WHEN value + {k} > 80 THEN 1 ELSE 0 END AS y_pred")


def grid_outcomes(t):
    return B.forecast_frame(t, B.YEAR_PAIRS).withColumn("outcome", L.outcome_class()).withColumn(
        "window_years", window_years(F.col("feature_date"), F.col("label_date")))


@query("outcome_share_by_window", with_views("grid_forecast", f"""
    WITH c AS (SELECT {B.WINDOW_YEARS_SQL} AS window_years, {B.OUTCOME_SQL} AS outcome, count(*) AS n
               FROM grid_forecast WHERE {B.WINDOW_YEARS_SQL} > 0 GROUP BY 1, 2)
    SELECT window_years, outcome, n, round(n / sum(n) OVER (PARTITION BY window_years) * 100, 6) AS share FROM c"""))
def outcome_share_by_window(t):
    rows = grid_outcomes(t).where("window_years > 0")
    return Z.shares(rows, "window_years", "outcome").withColumn("share", F.round("share", 6))


@query("outcome_share_by_stage", with_views("one_forecast", f"""
    WITH c AS (SELECT keys_company_stage AS stage, {B.OUTCOME_SQL} AS outcome, count(*) AS n FROM one_forecast GROUP BY 1, 2)
    SELECT stage, outcome, n, round(n / sum(n) OVER (PARTITION BY stage) * 100 * CASE WHEN outcome = 'Closed' THEN -1 ELSE 1 END, 6) AS share FROM c"""))
def outcome_share_by_stage(t):
    rows = B.forecast_frame(t).select(F.col("keys_company_stage").alias("stage"), L.outcome_class().alias("outcome"))
    return Z.shares(rows, "stage", "outcome").selectExpr(
        "stage", "outcome", "n", "round(CASE WHEN outcome = 'Closed' THEN -share ELSE share END, 6) AS share")


@query("stage_counts_by_year", with_views("grid_staged", f"""
    SELECT CAST(year(feature_date) AS INTEGER) AS slice_year,
           {", ".join(f"count(*) FILTER (WHERE keys_company_stage = '{s}') AS {col_name(s)}" for s in ORDERED_STAGES)}
    FROM grid_staged WHERE feature_date = label_date GROUP BY 1"""))
def stage_counts_by_year(t):
    days = sorted({f for f, _ in B.YEAR_PAIRS})
    rows = B.staged_frame(t, tuple((d, d) for d in days), sides=(L.FEATURE_COLUMNS,))
    return rows.groupBy(F.year("feature_date").alias("slice_year")).agg(
        *[F.expr(f"count_if(keys_company_stage = '{s}')").alias(col_name(s)) for s in ORDERED_STAGES])


_DESC = ("age", "raised", "rounds", "patents", "available")


@query("descriptives_by_stage", with_views("full_forecast", f"""
    WITH x AS (SELECT keys_company_stage AS stage, {B.AGE} AS age, {B.RAISED} * 1e-6 AS raised, {B.ROUNDS} AS rounds, {B.PATENTS} AS patents,
                      13 - ({" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in [B.AGE, B.RAISED, B.ROUNDS, B.PATENTS, B.STAFF] + [f"{B.CODE}{c}" for c in "abcdefgh"])}) AS available
               FROM full_forecast),
    y AS (SELECT stage, x.* EXCLUDE (stage) FROM x UNION ALL SELECT 'Overall', x.* EXCLUDE (stage) FROM x)
    SELECT stage, count(*) AS n, {", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_p{int(q * 100)}" for c in _DESC for q in (0.5, 0.75, 0.9))}
    FROM y GROUP BY 1"""))
def descriptives_by_stage(t):
    features = [B.AGE, B.RAISED, B.ROUNDS, B.PATENTS, B.STAFF] + [f"{B.CODE}{c}" for c in "abcdefgh"]
    missing = " + ".join(f"CAST({c} IS NULL AS INT)" for c in features)
    x = B.forecast_frame(t, detail=True).selectExpr(
        "keys_company_stage AS stage", f"{B.AGE} AS age", f"{B.RAISED} * 1e-6D AS raised", f"{B.ROUNDS} AS rounds",
        f"{B.PATENTS} AS patents", f"{len(features)} - ({missing}) AS available")
    y = Z.with_overall(x, "stage")
    q = Z.group_quantiles(y, ["stage"], _DESC, (0.5, 0.75, 0.9))
    sizes = y.groupBy("stage").agg(F.count("*").alias("n"))
    return sizes.join(q, "stage").selectExpr(
        "stage", "n", *[f"round({c}_p{p}, 6) AS {c}_p{p}" for c in _DESC for p in (50, 75, 90)])


@query("median_iqr", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
           round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr FROM lineitem GROUP BY 1, 2""")
def median_iqr(t):
    keys = ["l_returnflag", "l_linestatus"]
    q = exact_quantiles(t.lineitem, keys, "l_extendedprice", (0.25, 0.5, 0.75), held=False)
    sizes = t.lineitem.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.join(q, keys).selectExpr(*keys, "n", "round(p50, 6) AS median", "round(p75 - p25, 6) AS iqr")


@query("crosstab_margins", with_views("one_staged", f"""
    WITH c AS (SELECT keys_company_stage AS stage, {B.EXTRA_STAGE_SQL} AS label FROM one_staged)
    SELECT coalesce(stage, 'All') AS stage, round(count(*) FILTER (WHERE label = 0) / count(*), 6) AS v_0,
           round(count(*) FILTER (WHERE label = 1) / count(*), 6) AS v_1, count(*) AS total FROM c GROUP BY ROLLUP (stage)"""))
def crosstab_margins(t):
    rows = B.staged_frame(t).select(F.col("keys_company_stage").alias("stage"), L.label().alias("label"))
    return Z.crosstab(rows, "stage", "label", (0, 1), normalize=True).selectExpr(
        "stage", "round(v_0, 6) AS v_0", "round(v_1, 6) AS v_1", "total")


_ALL_STAGES = (*L.INCLUDED_STAGES, "IPO", "Acquired", "Closed", "Other")


@query("stage_transition", with_views("one_staged", f"""
    SELECT keys_company_stage AS stage, count(*) AS n,
           {", ".join(f"round(count(*) FILTER (WHERE outcome_stage = '{s}') * 100.0 / count(*), 6) AS to_{col_name(s)}" for s in _ALL_STAGES)}
    FROM one_staged GROUP BY 1"""))
def stage_transition(t):
    m = Z.transition_matrix(B.staged_frame(t), "keys_company_stage", "outcome_stage", _ALL_STAGES)
    return m.selectExpr("keys_company_stage AS stage", "n", *[f"round(to_{col_name(s)}, 6) AS to_{col_name(s)}" for s in _ALL_STAGES])


@query("top_categories", """
    SELECT category, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type), ' ')) AS category FROM part)
    GROUP BY 1 ORDER BY n DESC, category LIMIT 10""")
def top_categories(t):
    return Z.top_categories(t.part, "split(lower(concat_ws(' ', p_name, p_brand, p_type)), ' ')")


@query("success_rate", with_views("grid_staged", f"""
    SELECT feature_date, keys_company_stage AS stage, label_date, CAST(floor(date_diff('day', feature_date, label_date) / 365) AS INTEGER) AS years,
           round(avg({B.EXTRA_STAGE_SQL}) * 100, 6) AS success FROM grid_staged WHERE feature_date <> label_date GROUP BY 1, 2, 3, 4"""))
def success_rate(t):
    rows = B.staged_frame(t, B.YEAR_PAIRS).where("feature_date <> label_date").withColumn("label", L.label())
    return rows.groupBy("feature_date", F.col("keys_company_stage").alias("stage"), "label_date",
                        F.floor(F.datediff("label_date", "feature_date") / 365).cast("int").alias("years")).agg(
        F.round(F.avg("label") * 100, 6).alias("success"))


@query("relation_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS relation, count(*) AS records FROM {n}" for n in TABLES))
def relation_counts(t):
    out = None
    for name in TABLES:
        one = t.table(name).agg(F.count("*").alias("records")).select(F.lit(name).alias("relation"), "records")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("records"), "relation")


@query("metric_by_param", with_views("fits", """
    WITH m AS (SELECT imputer, quantile_cont(prc, 0.5) AS median_prc, count(*) AS fits FROM fits GROUP BY 1)
    SELECT imputer, round(median_prc, 6) AS median_prc, fits, row_number() OVER (ORDER BY median_prc DESC, imputer) AS place FROM m"""))
def metric_by_param(t):
    f = fits(t)
    m = exact_quantiles(f, ["imputer"], "prc", [0.5]).join(f.groupBy("imputer").agg(F.count("*").alias("fits")), "imputer")
    # One row per parameter value.
    place = F.row_number().over(Window.orderBy(F.desc("p50"), "imputer")).cast("long")
    return m.select("imputer", F.round("p50", 6).alias("median_prc"), "fits", place.alias("place"))


@query("classifier_stats", with_views("fits", """
    WITH y AS (SELECT classifier, prc, coalesce(roc, auc) AS roc, f1, mcc, seconds FROM fits
               UNION ALL SELECT 'Total', prc, coalesce(roc, auc), f1, mcc, seconds FROM fits)
    SELECT classifier, """ + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}_p50, round(max({c}), 6) AS {c}_max" for c in ("prc", "roc", "f1", "mcc"))
    + """, round(quantile_cont(seconds, 0.5), 6) AS seconds_p50, round(quantile_cont(seconds, 0.75), 6) AS seconds_p75 FROM y GROUP BY 1"""))
def classifier_stats(t):
    scores = ("prc", "roc", "f1", "mcc")
    y = Z.with_overall(fits(t).withColumn("roc", F.coalesce("roc", "auc")), "classifier", label="Total")
    q = Z.group_quantiles(y, ["classifier"], [*scores, "seconds"], (0.5, 0.75))
    top = y.groupBy("classifier").agg(*[F.max(c).alias(f"{c}_max") for c in scores])
    return q.join(top, "classifier").selectExpr(
        "classifier", *[f"round({c}_{s}, 6) AS {c}_{s}" for c in scores for s in ("p50", "max")],
        "round(seconds_p50, 6) AS seconds_p50", "round(seconds_p75, 6) AS seconds_p75")


@query("group_std", "SELECT l_shipdate, count(*) AS n, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def group_std(t):
    return t.lineitem.groupBy("l_shipdate").agg(F.count("*").alias("n"), F.round(F.stddev_pop("l_quantity"), 6).alias("std"))


@query("group_describe", """
    SELECT o_orderpriority, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std,
           min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS p50,
           round(quantile_cont(o_totalprice, 0.75), 6) AS p75, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def group_describe(t):
    g, x = "o_orderpriority", "o_totalprice"
    basic = t.orders.groupBy(g).agg(
        F.count(x).alias("count"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_quantiles(t.orders, [g], x, (0.25, 0.5, 0.75), held=False)
    return basic.join(q, g).selectExpr(g, "count", "mean", "std", "min", *[f"round(p{p}, 6) AS p{p}" for p in (25, 50, 75)], "max")


@query("metric_matrix", with_views("grid_forecast", f"""
    SELECT keys_company_stage AS stage, {", ".join(f"round(avg({B.EXTRA_STAGE_SQL}) FILTER (WHERE {B.WINDOW_YEARS_SQL} = {w}), 6) AS years_{w}" for w in (1, 2, 3, 4))}
    FROM grid_forecast GROUP BY 1"""))
def metric_matrix(t):
    rows = B.forecast_frame(t, B.YEAR_PAIRS).withColumn("label", L.label()).withColumn(
        "w", window_years(F.col("feature_date"), F.col("label_date")))
    return rows.groupBy(F.col("keys_company_stage").alias("stage")).pivot("w", [1, 2, 3, 4]).agg(F.avg("label")).selectExpr(
        "stage", *[f"round(`{w}`, 6) AS years_{w}" for w in (1, 2, 3, 4)])


@query("column_modes", """
    WITH c AS (SELECT l_returnflag, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, v AS mode, n AS mode_count FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, v) = 1""")
def column_modes(t):
    return exact_modes(t.lineitem, ["l_returnflag"], "l_quantity")


@query("distinct_counts", """
    SELECT count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey,
           count(DISTINCT l_shipdate) AS l_shipdate FROM lineitem""")
def distinct_counts(t):
    return t.lineitem.agg(*[F.count_distinct(c).alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")])


@query("metric_by_date_overall", with_views("fits", """
    SELECT coalesce(CAST(feature_date AS VARCHAR), 'Overall') AS feature_date, count(*) AS fits, round(avg(f1), 6) AS f1, round(max(prc), 6) AS prc_max
    FROM fits GROUP BY ROLLUP (feature_date)"""))
def metric_by_date_overall(t):
    return Z.rolled_up(fits(t), "feature_date", [
        F.count("*").alias("fits"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.max("prc"), 6).alias("prc_max")])


@query("rank_candidates", with_views("fits", """
    WITH m AS (SELECT params, quantile_cont(prc, 0.5) AS median_score FROM fits GROUP BY 1),
    r AS (SELECT params, median_score, rank() OVER (ORDER BY median_score DESC) + (count(*) OVER (PARTITION BY median_score) - 1) / 2 AS rank FROM m)
    SELECT params, round(median_score, 6) AS median_score, rank FROM r
    QUALIFY row_number() OVER (ORDER BY r.median_score DESC, params) <= 10"""))
def rank_candidates(t):
    """W1-W3: rank candidate parameter sets by their median score and keep the ten best."""
    return Z.rank_candidates(fits(t), "params", "prc", 10).select("params", F.round("median_score", 6).alias("median_score"), "rank")


@query("topk_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def topk_rows(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy(
        F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20)


@query("cumulative_share", """
    WITH s AS (SELECT l_shipdate, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
    c AS (SELECT l_shipdate, q, sum(q) OVER (ORDER BY l_shipdate ROWS UNBOUNDED PRECEDING) / sum(q) OVER () AS share FROM s)
    SELECT CAST(l_shipdate AS DATE) AS day, q AS quantity, round(share, 6) AS share,
           l_shipdate = min(CASE WHEN share > 0.8 THEN l_shipdate END) OVER () AS first_over FROM c""")
def cumulative_share(t):
    rows = t.lineitem.selectExpr("unix_date(CAST(l_shipdate AS DATE)) AS day", "l_quantity")
    run = running_totals(rows, "day", {"q": F.col("l_quantity")})
    total = t.lineitem.agg(F.sum("l_quantity").alias("t")).scalar()
    shared = run.select("day", "q", (F.col("q_upto") / total).alias("share"), (F.col("q_before") / total).alias("before"))
    return shared.selectExpr("date_from_unix_date(day) AS day", "q AS quantity", "round(share, 6) AS share",
                             "share > 0.8D AND before <= 0.8D AS first_over")


@query("first_last_event", """
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_type, event_id) AS first_event_type,
           arg_max(event_type, event_id) AS last_event_type, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value
    FROM events GROUP BY 1""")
def first_last_event(t):
    return Z.first_and_last(t.events, "user_id", "ts", "event_id", ["event_type", "value"])


@query("date_parts", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
           min(CAST(epoch(o_orderdate) AS BIGINT)) AS first_unix, count(*) AS n FROM orders GROUP BY 1, 2""")
def date_parts(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter")).agg(
        F.expr(f"min({unix_seconds_sql('o_orderdate')})").alias("first_unix"), F.count("*").alias("n"))
