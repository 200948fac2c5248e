"""Queries: as-of slices, slice grids, windows, as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import slicing as S
from tidemark.plans.registry import query
from tidemark.sources.bindings import FEATURE_DATE, LABEL_DATE, YEARLY_SLICES, with_views

_DATES_SQL = "(VALUES " + ", ".join(f"(DATE '{d}')" for d in YEARLY_SLICES) + ")"


@query("slice_asof", with_views("orgs rounds patents", f"""
    SELECT 'organizations' AS relation, org_id AS id, CAST(created_at AS DATE) AS known_on, DATE '{FEATURE_DATE}' AS slice_date
    FROM orgs WHERE created_at < DATE '{FEATURE_DATE}'
    UNION ALL SELECT 'rounds', round_id, CAST(created_at AS DATE), DATE '{FEATURE_DATE}'
    FROM rounds WHERE created_at < DATE '{FEATURE_DATE}'
    UNION ALL SELECT 'patents', org_id, CAST(patent_date AS DATE), DATE '{FEATURE_DATE}'
    FROM patents WHERE patent_date < DATE '{FEATURE_DATE}'
    UNION ALL SELECT 'investors', s_suppkey, NULL, DATE '{FEATURE_DATE}' FROM supplier"""))
def slice_asof(t):
    sliced = S.slice_snapshot(
        {"organizations": t.orgs(), "rounds": t.rounds(), "patents": t.patents(), "investors": t.investors()}, FEATURE_DATE)
    keys = {"organizations": ("org_id", "created_at"), "rounds": ("round_id", "created_at"),
            "patents": ("org_id", "patent_date"), "investors": ("investor_id", None)}
    out = None
    for name, df in sliced.items():
        key, known = keys[name]
        one = df.select(
            F.lit(name).alias("relation"), F.col(key).alias("id"),
            (F.to_date(known) if known else F.lit(None).cast("date")).alias("known_on"), "slice_date")
        out = one if out is None else out.unionByName(one)
    return out


@query("slice_grid", with_views("rounds", """
    WITH spread AS (SELECT CAST(min(created_at) AS DATE) AS first_day, CAST(max(created_at) AS DATE) AS last_day FROM rounds),
    years AS (SELECT DISTINCT CAST(date_trunc('year', created_at) AS DATE) AS feature_date FROM rounds),
    grid AS (SELECT feature_date, w AS window_years, CAST(feature_date + w * 364 AS DATE) AS label_date
             FROM years, (VALUES (2), (3), (4)) v(w))
    SELECT feature_date, window_years, label_date,
           CAST(last_day - date_diff('day', feature_date, label_date)::INTEGER AS DATE) AS test_feature_date
    FROM grid, spread WHERE feature_date >= first_day AND label_date <= last_day"""))
def slice_grid(t):
    rounds = t.rounds()
    spread = rounds.agg(F.struct(F.to_date(F.min("created_at")).alias("first"), F.to_date(F.max("created_at")).alias("last"))).scalar()
    years = rounds.select(F.to_date(F.date_trunc("year", "created_at")).alias("feature_date")).distinct()
    grid = S.with_windows(years, "feature_date", [2, 3, 4])
    return grid.where((F.col("feature_date") >= spread.getField("first")) & (F.col("label_date") <= spread.getField("last"))).select(
        "feature_date", "window_years", "label_date",
        F.date_sub(spread.getField("last"), F.datediff("label_date", "feature_date")).alias("test_feature_date"))


@query("slice_pairs", with_views("rounds", """
    WITH years AS (SELECT DISTINCT CAST(date_trunc('year', created_at) AS DATE) AS d FROM rounds)
    SELECT f.d AS feature_date, l.d AS label_date FROM years f JOIN years l ON f.d <= l.d"""))
def slice_pairs(t):
    # The set holds calendar years, so one row can carry it.
    years = t.rounds().agg(F.sort_array(F.collect_set(F.to_date(F.date_trunc("year", "created_at")))).alias("days"))
    return years.select("days", F.explode("days").alias("feature_date")).select(
        "feature_date", F.explode(F.filter("days", lambda d: d >= F.col("feature_date"))).alias("label_date"))


@query("multi_slice_counts", with_views("rounds", f"""
    SELECT d AS slice_date, org_id, count(*) AS rows, round(sum(raised_usd), 2) AS raised
    FROM rounds JOIN {_DATES_SQL} v(d) ON created_at < d GROUP BY 1, 2"""))
def multi_slice_counts(t):
    return S.counts_at_slices(
        t.rounds(), "org_id", "created_at", YEARLY_SLICES, {"raised": F.col("raised_usd")}
    ).withColumn("raised", F.round("raised", 2))


@query("slice_fidelity", with_views("orgs rounds patents", f"""
    WITH c AS (
      SELECT 'organizations' AS relation, count(*) FILTER (WHERE created_at < DATE '{LABEL_DATE}') AS s, count(*) AS o FROM orgs
      UNION ALL SELECT 'rounds', count(*) FILTER (WHERE created_at < DATE '{LABEL_DATE}'), count(*) FROM rounds
      UNION ALL SELECT 'patents', count(*) FILTER (WHERE patent_date < DATE '{LABEL_DATE}'), count(*) FROM patents)
    SELECT relation, s AS sliced_rows, o AS original_rows, round(s / o, 6) AS ratio FROM c"""))
def slice_fidelity(t):
    whole = {"organizations": t.orgs(), "rounds": t.rounds(), "patents": t.patents()}
    return S.slice_fidelity(S.slice_snapshot(whole, LABEL_DATE), whole).withColumn("ratio", F.round("ratio", 6))


@query("window_bucket", with_views("orgs rounds", """
    WITH p AS (SELECT date_diff('day', o.founded_on, CAST(r.created_at AS DATE)) AS days
               FROM rounds r JOIN orgs o USING (org_id))
    SELECT CAST(CAST(floor(floor(days / 30) / 12) AS INTEGER) AS VARCHAR) || ' Years' AS "window",
           CAST(floor(days / 365) AS INTEGER) AS years_365, count(*) AS n FROM p GROUP BY 1, 2"""))
def window_bucket(t):
    pairs = t.rounds().join(t.orgs().select("org_id", "founded_on"), "org_id")
    end = F.to_date("created_at")
    return pairs.groupBy(
        S.window_label(F.col("founded_on"), end).alias("window"),
        F.floor(F.datediff(end, "founded_on") / 365).cast("int").alias("years_365"),
    ).agg(F.count("*").alias("n"))


@query("asof_lookup", with_views("rounds", """
    WITH series AS (SELECT CAST(date_trunc('month', created_at) AS DATE) AS day, round(avg(raised_usd), 2) AS close
                    FROM rounds GROUP BY 1),
    firsts AS (SELECT org_id, CAST(min(created_at) AS DATE) AS first_round FROM rounds GROUP BY 1)
    SELECT org_id, first_round, close AS index_close
    FROM firsts ASOF LEFT JOIN series ON first_round >= day"""))
def asof_lookup(t):
    rounds = t.rounds()
    # A monthly index level stands for the stock index; it is looked up at the first round of each entity.
    series = rounds.groupBy(F.to_date(F.date_trunc("month", "created_at")).alias("day")).agg(
        F.round(F.avg("raised_usd"), 2).alias("index_close"))
    firsts = rounds.groupBy("org_id").agg(F.to_date(F.min("created_at")).alias("first_round"))
    return S.asof_lookup(firsts, series, "first_round", "day", "index_close").select("org_id", "first_round", "index_close")


@query("entity_age", with_views("orgs", f"""
    SELECT org_id, round(date_diff('day', founded_on, DATE '{FEATURE_DATE}') / 365.25, 6) AS age FROM orgs"""))
def entity_age(t):
    return t.orgs().select("org_id", F.round(S.age_years(F.col("founded_on"), F.lit(FEATURE_DATE)), 6).alias("age"))
