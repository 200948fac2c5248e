"""Queries: stages, labels, outcomes and the forecast dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.naming import ROUND_CODES
from tidemark.operators import labels as L
from tidemark.plans import base as B
from tidemark.plans.registry import query
from tidemark.sources.bindings import with_views

STAGE_KEYS = [f"{p}{s}" for p in ("keys_company_stage", "outcome_stage")
              for s in ("", "_number", "_group", "_pre", "_pre_number", "_pre_group")]
FEATURES = ([B.AGE, B.ROUNDS, B.RAISED, B.PATENTS, B.STAFF] + [f"{B.CODE}{c}" for c in ROUND_CODES]
            + [f"{B.SEGMENT}{s}" for s in B.SEGMENTS])
OUTCOMES = ["outcome_age_number", "outcome_funding_rounds_number", "outcome_funding_raised_value_total_number",
            "outcome_closed_bool", "outcome_acquired_bool", "outcome_ipo_bool", "outcome_exit_bool"]
ROUNDED = {B.AGE: 6, B.RAISED: 2, "outcome_age_number": 6, "outcome_funding_raised_value_total_number": 2}
LABEL_DATASET = ["keys_company_id", "keys_company_name_id", "feature_date", "label_date", *STAGE_KEYS, *FEATURES, *OUTCOMES]


def tidy(df, columns):
    return df.selectExpr(*[f"round({c}, {ROUNDED[c]}) AS {c}" if c in ROUNDED else c for c in columns])


def tidy_sql(columns):
    return ", ".join(f"round({c}, {ROUNDED[c]}) AS {c}" if c in ROUNDED else c for c in columns)


@query("forecast_dataset", with_views("full_forecast", f"""
    SELECT {tidy_sql(LABEL_DATASET)}, {B.EXTRA_STAGE_SQL} AS label FROM full_forecast"""))
def forecast_dataset(t):
    df = B.forecast_frame(t, detail=True).withColumn("label", L.label("Extra_Stage"))
    return tidy(df, LABEL_DATASET + ["label"])


@query("entity_stage", with_views("one_staged", f"""
    SELECT keys_company_id, {", ".join(STAGE_KEYS[:6])} FROM one_staged"""))
def entity_stage(t):
    return B.staged_frame(t, sides=(L.FEATURE_COLUMNS,)).select("keys_company_id", *STAGE_KEYS[:6])


@query("entity_stage_alt", with_views("one_joined", """
    SELECT org_id AS keys_company_id,
           CASE WHEN f_closed >= 1 THEN 'Closed' WHEN f_acquired >= 1 THEN 'Acquired' WHEN f_ipo >= 1 THEN 'IPO'
                WHEN coalesce(f_code_c, 0) + coalesce(f_code_d, 0) + coalesce(f_code_e, 0) >= 1 THEN 'Series C+'
                WHEN f_code_b >= 1 THEN 'Series B' WHEN f_code_a >= 1 THEN 'Series A'
                WHEN f_raised >= 0 THEN 'Seed' WHEN f_rounds = 0 THEN 'None' ELSE 'Other' END AS stage
    FROM one_joined"""))
def entity_stage_alt(t):
    late = " + ".join(f"coalesce({B.CODE}{c}, 0)" for c in "cde")
    rules = [
        ("keys_company_status_closed_bool >= 1", "Closed"), ("keys_company_status_acquired_bool >= 1", "Acquired"),
        ("keys_company_status_ipo_bool >= 1", "IPO"), (f"{late} >= 1", "Series C+"), (f"{B.CODE}b >= 1", "Series B"),
        (f"{B.CODE}a >= 1", "Series A"), (f"{B.RAISED} >= 0", "Seed"), (f"{B.ROUNDS} = 0", "None"),
    ]
    return B.merged_frame(t).select("keys_company_id", L.ladder(rules, "Other").alias("stage"))


@query("label_extra_stage", with_views("one_staged", f"""
    SELECT keys_company_id, keys_company_stage, outcome_stage, {B.EXTRA_STAGE_SQL} AS label FROM one_staged"""))
def label_extra_stage(t):
    return B.staged_frame(t).select(
        "keys_company_id", "keys_company_stage", "outcome_stage", L.label("Extra_Stage").alias("label"))


@query("label_extra_round", with_views("one_staged", f"""
    SELECT keys_company_id, keys_company_stage, outcome_stage_pre, {B.EXTRA_ROUND_SQL} AS label FROM one_staged"""))
def label_extra_round(t):
    return B.staged_frame(t).select(
        "keys_company_id", "keys_company_stage", "outcome_stage_pre", L.label("Extra_Round").alias("label"))


@query("label_flags", with_views("one_joined", """
    SELECT org_id AS keys_company_id, greatest(l_acquired, l_ipo) AS exit, l_acquired AS acquisition, l_ipo AS ipo
    FROM one_joined"""))
def label_flags(t):
    return B.merged_frame(t).select(
        "keys_company_id", L.label("Exit").alias("exit"), L.label("Acquisition").alias("acquisition"),
        L.label("IPO").alias("ipo"))


@query("label_more_rounds", with_views("one_joined", """
    SELECT org_id AS keys_company_id, f_rounds AS rounds_before, l_rounds AS rounds_after,
           CASE WHEN l_rounds - f_rounds > 0 THEN 1 ELSE 0 END AS label FROM one_joined"""))
def label_more_rounds(t):
    return B.merged_frame(t).select(
        "keys_company_id", F.col(B.ROUNDS).alias("rounds_before"),
        F.col("outcome_funding_rounds_number").alias("rounds_after"), L.more_rounds().alias("label"))


@query("outcome_class", with_views("one_staged", f"""
    SELECT keys_company_id, keys_company_stage, {B.OUTCOME_SQL} AS outcome FROM one_staged"""))
def outcome_class(t):
    return B.staged_frame(t).select("keys_company_id", "keys_company_stage", L.outcome_class().alias("outcome"))


@query("apply_constraints", with_views("one_forecast", f"""
    SELECT keys_company_id, keys_company_stage, round({B.AGE}, 6) AS age FROM one_forecast"""))
def apply_constraints(t):
    return B.forecast_frame(t).select("keys_company_id", "keys_company_stage", F.round(B.AGE, 6).alias("age"))


@query("consistency_filter", with_views("one_joined", """
    SELECT org_id AS keys_company_id, f_rounds AS rounds_before, l_rounds AS rounds_after,
           greatest(l_acquired, l_ipo) AS exit
    FROM one_joined WHERE l_rounds >= f_rounds AND NOT (greatest(l_acquired, l_ipo) = 1 AND l_rounds = 0)"""))
def consistency_filter(t):
    return L.consistent(B.merged_frame(t)).select(
        "keys_company_id", F.col(B.ROUNDS).alias("rounds_before"),
        F.col("outcome_funding_rounds_number").alias("rounds_after"), F.col("outcome_exit_bool").alias("exit"))


@query("staged_by_training", with_views("later_staged", f"""
    SELECT feature_date, label_date, keys_company_id, keys_company_stage, outcome_stage, old_age, {B.EXTRA_STAGE_SQL} AS label FROM later_staged"""))
def staged_by_training(t):
    """Test slices half a year after the training grid, in the stages that the training slices' cut-offs give."""
    rows = B.staged_frame(t, B.LATER_PAIRS, fitted_on=B.YEAR_PAIRS, keep_cutoffs=True)
    return rows.select("feature_date", "label_date", "keys_company_id", "keys_company_stage", "outcome_stage",
                       F.col("__cut.old_age").alias("old_age"), L.label().alias("label"))
