"""Queries: feature encoding, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.naming import ROUND_CODES, feature_names
from tidemark.operators import encode as E
from tidemark.operators.slicing import unix_seconds_sql
from tidemark.plans import base as B
from tidemark.plans.registry import query
from tidemark.sources.bindings import with_views


_RAW_SQL = """
    SELECT o_orderkey AS keys_id, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS raised_number,
           CASE WHEN o_orderkey % 11 <> 0 THEN lower(o_orderstatus) || ';' || chr(CAST(97 + o_orderkey % 4 AS INTEGER)) END AS round_codes_list,
           CASE WHEN o_orderkey % 5 <> 0 THEN replace(o_orderpriority, ' ', ';') END AS priority_list,
           o_orderstatus || ' ' || CAST(o_custkey AS VARCHAR) || ';' || chr(CAST(70 + 5 * (o_orderkey % 3) AS INTEGER)) || ' ' || CAST(o_orderkey % 50 AS VARCHAR) AS deal_pair,
           o_orderkey % 2 = 0 AS even_bool, o_orderpriority AS remark
    FROM orders"""


def raw_rows(t):
    """Orders as an uncleaned wide row: numbers as text, lists and pairs in strings."""
    return t.orders.selectExpr(
        "o_orderkey AS keys_id", "CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END AS raised_number",
        "CASE WHEN o_orderkey % 11 <> 0 THEN concat(lower(o_orderstatus), ';', char(97 + o_orderkey % 4)) END AS round_codes_list",
        "CASE WHEN o_orderkey % 5 <> 0 THEN replace(o_orderpriority, ' ', ';') END AS priority_list",
        "concat(o_orderstatus, ' ', o_custkey, ';', char(70 + 5 * (o_orderkey % 3)), ' ', o_orderkey % 50) AS deal_pair",
        "o_orderkey % 2 = 0 AS even_bool", "o_orderpriority AS remark")


def _has(c, w):
    return f"CAST(list_contains(string_split(lower({c}), ';'), '{w}') AS INTEGER)"


def _pair_sum_sql(k):
    values = ("[CAST(split_part(p, ' ', 2) AS DOUBLE) FOR p IN string_split(deal_pair, ';') IF lower(split_part(p, ' ', 1)) = '" + k + "']")
    return f"list_sum({values}) AS deal_pair_{k}_pair"


_PRIORITY_WORDS = ("1-urgent", "2-high", "3-medium", "4-not", "5-low", "specified")


@query("clean_features", f"""
    WITH raw AS ({_RAW_SQL})
    SELECT keys_id, TRY_CAST(raised_number AS DOUBLE) AS raised_number,
           {", ".join((_has('round_codes_list', c) if c in 'abcdf' else 'CAST(NULL AS INTEGER)') + f" AS round_codes_list_{c}" for c in ROUND_CODES)},
           {", ".join(_has('priority_list', w) + f' AS "priority_list_{w}"' for w in _PRIORITY_WORDS)},
           {", ".join(_pair_sum_sql(k) for k in ("f", "k", "o", "p"))}, even_bool
    FROM raw""")
def clean_features(t):
    return E.clean_features(raw_rows(t), {"deal_pair": ("f", "k", "o", "p")})


@query("coerce_numeric", """
    SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS value FROM orders""")
def coerce_numeric(t):
    return raw_rows(t).selectExpr("keys_id AS o_orderkey", "try_cast(raised_number AS DOUBLE) AS value")


@query("list_dummies", """
    SELECT p_partkey, """ + ", ".join(f"{_has('words', w)} AS words_{w}" for w in ("red", "blue", "widget", "ring")) + """
    FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN replace(p_name, ' ', ';') END AS words FROM part)""")
def list_dummies(t):
    df = t.part.selectExpr("p_partkey", "CASE WHEN p_size % 7 <> 0 THEN replace(p_name, ' ', ';') END AS words")
    return E.with_parsed(df, ["words"]).selectExpr("p_partkey", *E.list_dummies_sql("words", ("red", "blue", "widget", "ring")))


@query("topn_dummies", """
    WITH p AS (SELECT p_partkey, string_split(lower(replace(p_name, ' ', ';')), ';') AS words FROM part),
    top AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS rank FROM (SELECT unnest(words) AS w FROM p) GROUP BY w
            QUALIFY rank <= 10),
    hits AS (SELECT p_partkey, rank FROM (SELECT p_partkey, unnest(words) AS w FROM p) JOIN top USING (w) GROUP BY 1, 2)
    SELECT p.p_partkey, top.rank, top.w AS token,
           CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.p_partkey = p.p_partkey)
                THEN CAST(list_contains(p.words, top.w) AS INTEGER) END AS present
    FROM p CROSS JOIN top""")
def topn_dummies(t):
    df = t.part.selectExpr("p_partkey", "replace(p_name, ' ', ';') AS words")
    top = E.fit_vocabulary(df, "words")
    dummies = E.with_parsed(df, ["words"]).selectExpr("p_partkey", *E.top_dummies_sql("words", top))
    # Long form, as the names of the columns depend on the data.
    entries = ", ".join(f"named_struct('rank', {i}L, 'token', {E.quoted(w)}, 'present', `words_{E.column_token(w)}`)"
                        for i, w in enumerate(top, 1))
    return dummies.selectExpr("p_partkey", f"inline(array({entries}))")


@query("vocab_dummies", f"""
    WITH raw AS ({_RAW_SQL})
    SELECT keys_id, {", ".join((_has('round_codes_list', c) if c in 'abcdf' else 'CAST(NULL AS INTEGER)') + f" AS round_codes_list_{c}" for c in ROUND_CODES)}
    FROM raw""")
def vocab_dummies(t):
    raw = raw_rows(t)
    return E.with_parsed(raw, ["round_codes_list"]).selectExpr("keys_id", *E.fixed_dummies_sql(raw, "round_codes_list", ROUND_CODES))


@query("onehot", """
    SELECT c_custkey, """ + ", ".join(
    f"CASE WHEN lower(segment) = '{s}' THEN 1 ELSE 0 END AS segment_{s}" for s in B.SEGMENTS) + """
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment FROM customer)""")
def onehot(t):
    df = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment")
    return df.selectExpr("c_custkey", *E.onehot_sql("segment", B.SEGMENTS))


@query("pair_sum", f"""
    WITH raw AS ({_RAW_SQL}) SELECT keys_id, {", ".join(_pair_sum_sql(k) for k in ("f", "k", "o", "p"))} FROM raw""")
def pair_sum(t):
    return E.with_parsed(raw_rows(t), pairs=["deal_pair"]).selectExpr("keys_id", *E.pair_sums_sql("deal_pair", ("f", "k", "o", "p")))


_DATE_PAIR = """lower(l_returnflag) || ' ' || CAST(1000 - l_linenumber * 7 AS VARCHAR) || ';' || lower(l_linestatus) || ' ' || CAST(l_partkey AS VARCHAR)
    || ';a ' || CAST(l_suppkey AS VARCHAR)"""


@query("pair_dates", f"""
    WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_DATE_PAIR} AS date_pair FROM lineitem),
    v AS (SELECT *, list_sort([CAST(split_part(p, ' ', 2) AS BIGINT) FOR p IN string_split(date_pair, ';') IF split_part(p, ' ', 1) = 'a']) AS a,
                 [CAST(split_part(p, ' ', 2) AS BIGINT) FOR p IN string_split(date_pair, ';') IF split_part(p, ' ', 1) = 'o'] AS o FROM raw)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a[1] AS date_pair_a_0_pair, a[2] AS date_pair_a_1_pair, o[len(o)] AS date_pair_o_pair FROM v""")
def pair_dates(t):
    raw = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "concat(lower(l_returnflag), ' ', 1000 - l_linenumber * 7, ';', lower(l_linestatus), ' ', l_partkey, ';a ', l_suppkey) AS date_pair")
    return E.with_parsed(raw, pairs=["date_pair"]).selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *E.pair_dates_sql("date_pair", ("a",), 2),
                          *E.pair_dates_sql("date_pair", ("o",), 1, last=True))


@query("pairwise_durations", with_views("orgs rounds", """
    WITH f AS (SELECT org_id, CAST(min(created_at) AS DATE) AS first_round, CAST(max(created_at) AS DATE) AS last_round FROM rounds GROUP BY 1)
    SELECT org_id, date_diff('day', first_round, founded_on)::INTEGER AS first_round_to_founded_on_duration,
           date_diff('day', last_round, founded_on)::INTEGER AS last_round_to_founded_on_duration,
           date_diff('day', last_round, first_round)::INTEGER AS last_round_to_first_round_duration
    FROM orgs LEFT JOIN f USING (org_id)"""))
def pairwise_durations(t):
    spread = t.rounds().groupBy("org_id").agg(
        F.to_date(F.min("created_at")).alias("first_round"), F.to_date(F.max("created_at")).alias("last_round"))
    df = t.orgs().select("org_id", "founded_on").join(spread, "org_id", "left")
    return df.selectExpr("org_id", *E.pairwise_durations(df, ["founded_on", "first_round", "last_round"]))


@query("presence_flags", """
    SELECT page_id, CASE WHEN url <> '' THEN 1 ELSE 0 END AS url_bool,
           CASE WHEN regexp_extract(url, '#(.*)$', 1) <> '' THEN 1 ELSE 0 END AS anchor_bool FROM pages""")
def presence_flags(t):
    from tidemark.functions.text import present

    return t.pages.select("page_id", present(F.col("url")).alias("url_bool"),
                          present(F.regexp_extract("url", "#(.*)$", 1)).alias("anchor_bool"))


@query("funding_ratios", with_views("rounds", """
    WITH f AS (SELECT org_id, count(*) AS raises, sum(raised_usd) AS raised, min(created_at) AS first_on, max(created_at) AS last_on FROM rounds GROUP BY 1),
    e AS (SELECT *, CAST(epoch(first_on) AS BIGINT) AS first_unix, CAST(epoch(last_on) AS BIGINT) AS last_unix FROM f)
    SELECT org_id, first_unix, round((last_unix - first_unix) / raises, 6) AS raise_interval, round(raised / raises, 6) AS raised_per_raise,
           round(raised / nullif(last_unix - first_unix, 0), 6) AS raised_over_time FROM e"""))
def funding_ratios(t):
    f = t.rounds().groupBy("org_id").agg(
        F.count("*").alias("raises"), F.sum("raised_usd").alias("raised"),
        F.min("created_at").alias("first_on"), F.max("created_at").alias("last_on"))
    e = f.selectExpr("*", f"{unix_seconds_sql('first_on')} AS first_unix", f"{unix_seconds_sql('last_on')} AS last_unix")
    return e.selectExpr(
        "org_id", "first_unix", "round(try_divide(last_unix - first_unix, raises), 6) AS raise_interval",
        "round(try_divide(raised, raises), 6) AS raised_per_raise",
        "round(try_divide(raised, last_unix - first_unix), 6) AS raised_over_time")


@query("bin_labels", """
    SELECT CASE p_size // 20 WHEN 0 THEN '0-19' WHEN 1 THEN '20-39' WHEN 2 THEN '40-59' END AS bin, count(*) AS n FROM part GROUP BY 1""")
def bin_labels(t):
    bins = ", ".join(f"{i}, '{20 * i}-{20 * i + 19}'" for i in range(5))
    return t.part.groupBy(F.expr(f"element_at(map({bins}), CAST(floor(p_size / 20) AS INT))").alias("bin")).agg(F.count("*").alias("n"))


@query("equal_width_bins", """
    WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT greatest(1, least(12, CAST(ceil((o_totalprice - lo) / ((hi - lo) / 12)) AS INTEGER))) AS bin, lo, hi FROM orders, r)
    SELECT bin, round(lo + (bin - 1) * (hi - lo) / 12, 6) AS bin_from, round(lo + bin * (hi - lo) / 12, 6) AS bin_to, count(*) AS n
    FROM b GROUP BY bin, lo, hi""")
def equal_width_bins(t):
    return E.equal_width_bins(t.orders, "o_totalprice", 12).selectExpr(
        "bin", "round(bin_from, 6) AS bin_from", "round(bin_to, 6) AS bin_to", "n")


@query("partial_dates", """
    SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(CAST(1990 + l_linenumber AS VARCHAR) || '-' || CAST(1 + l_partkey % 13 AS VARCHAR) || '-' || CAST(1 + l_suppkey % 31 AS VARCHAR) AS DATE) AS founded_on
    FROM lineitem""")
def partial_dates(t):
    return t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "try_cast(concat_ws('-', 1990 + l_linenumber, 1 + l_partkey % 13, 1 + l_suppkey % 31) AS DATE) AS founded_on")


_FEATURES_SQL = [B.AGE, B.ROUNDS, B.RAISED] + [f"{B.CODE}{c}" for c in ROUND_CODES]


@query("row_missing", with_views("one_staged", f"""
    SELECT keys_company_id, {" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _FEATURES_SQL)} AS missing FROM one_staged"""))
def row_missing(t):
    df = B.merged_frame(t)
    return df.selectExpr("keys_company_id", E.missing_count_sql(feature_names(df.schema)))


@query("math_transforms", """
    SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 6) AS log1p, round(sqrt(abs(c_acctbal)), 6) AS root,
           abs(c_acctbal) AS magnitude, CASE WHEN c_acctbal = 0 THEN 0 ELSE 1 END AS nonzero, round(c_acctbal * 1e-6, 9) AS millions FROM customer""")
def math_transforms(t):
    return t.customer.selectExpr(
        "c_custkey", "round(log1p(abs(c_acctbal)), 6) AS log1p", "round(sqrt(abs(c_acctbal)), 6) AS root",
        "abs(c_acctbal) AS magnitude", "CASE WHEN c_acctbal = 0 THEN 0 ELSE 1 END AS nonzero", "round(c_acctbal * 1e-6D, 9) AS millions")


@query("feature_matrix", with_views("one_staged", f"""
    SELECT {", ".join(f"round(CASE WHEN (SELECT count({c}) FROM one_staged) = 0 THEN 0.0::DOUBLE ELSE CAST({c} AS DOUBLE) END, 4) AS {c}" for c in sorted(_FEATURES_SQL))}
    FROM one_staged"""))
def feature_matrix(t):
    matrix = E.feature_matrix(B.merged_frame(t))
    return matrix.selectExpr(*[f"round({c}, 4) AS {c}" for c in matrix.columns])


@query("fraction_ladder", """
    SELECT f AS fraction, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN (VALUES (0.01::DOUBLE), (0.032::DOUBLE), (0.1::DOUBLE), (0.316::DOUBLE), (1.0::DOUBLE)) v(f) ON (o_orderkey * 7919) % 1000 < f * 1000
    GROUP BY 1""")
def fraction_ladder(t):
    rows = E.fraction_rows(t.orders, "(o_orderkey * 7919) % 1000", (0.01, 0.032, 0.1, 0.316, 1.0))
    return rows.groupBy("fraction").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
