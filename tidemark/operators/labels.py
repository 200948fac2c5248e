"""Stages of entities, forecast labels and outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.naming import ROUND_CODES
from tidemark.operators.slicing import DAYS_PER_YEAR

# Stages, their numbers and their group.
STAGE_NUMBERS = {
    "Pre-Seed": 1, "Seed": 2, "Series A": 3, "Series B": 4, "Series C": 5, "Series D+": 6,
    "IPO": 7, "Acquired": 8, "Closed": -1,
}
INCLUDED_STAGES = ("Pre-Seed", "Seed", "Series A", "Series B", "Series C", "Series D+")
SEED_AGE_QUANTILE = 0.75
OLD_AGE_QUANTILE = 0.75
LABEL_TYPES = ("Extra_Stage", "Extra_Round", "Exit", "Acquisition", "IPO")


@dataclass(frozen=True)
class StageColumns:
    """Where the inputs of the stage ladder are. Ages are whole days: quantiles on them are exact."""

    age_days: str
    raised: str
    code_prefix: str
    closed: str
    acquired: str
    ipo: str
    out_prefix: str


FEATURE_COLUMNS = StageColumns(
    "keys_company_age_days", "confidence_validation_funding_raised_value_total_number",
    "confidence_validation_funding_round_codes_list_", "keys_company_status_closed_bool",
    "keys_company_status_acquired_bool", "keys_company_status_ipo_bool", "keys_company_stage")
OUTCOME_COLUMNS = StageColumns(
    "outcome_age_days", "outcome_funding_raised_value_total_number",
    "outcome_funding_round_codes_list_", "outcome_closed_bool", "outcome_acquired_bool",
    "outcome_ipo_bool", "outcome_stage")


def funding_stage(cols: StageColumns) -> str:
    """SQL of the part of the ladder that needs no age: NULL where only the age can tell."""
    p = cols.code_prefix
    late = " + ".join(f"coalesce({p}{c}, 0)" for c in ROUND_CODES[3:])
    return (
        f"CASE WHEN {late} >= 1 THEN 'Series D+' WHEN {p}c >= 1 THEN 'Series C' WHEN {p}b >= 1 THEN 'Series B' "
        f"WHEN {p}a >= 1 THEN 'Series A' WHEN {cols.raised} >= 0 THEN 'Seed' END"
    )


def with_exit(pre: str, cols: StageColumns) -> str:
    """A dated exit replaces the funding stage; closure outranks acquisition, which outranks IPO."""
    return (
        f"CASE WHEN {cols.closed} >= 1 THEN 'Closed' WHEN {cols.acquired} >= 1 THEN 'Acquired' "
        f"WHEN {cols.ipo} >= 1 THEN 'IPO' ELSE {pre} END"
    )


def stage_number(stage: str) -> str:
    """Number of a stage by one look-up in a constant map; NULL for ``Other``."""
    pairs = ", ".join(f"'{name}', {number}" for name, number in STAGE_NUMBERS.items())
    return f"element_at(map({pairs}), {stage})"


def stage_group(stage: str) -> str:
    names = ", ".join(f"'{s}'" for s in INCLUDED_STAGES)
    return f"CASE WHEN {stage} IN ({names}) THEN 'Included' ELSE 'Excluded' END"


def fit_cutoffs(
    df: DataFrame,
    sides: Sequence[StageColumns] = (FEATURE_COLUMNS, OUTCOME_COLUMNS),
    by: Sequence[str] = (),
    seed_age_q: float = SEED_AGE_QUANTILE,
    old_age_q: float = OLD_AGE_QUANTILE,
) -> DataFrame:
    """Age cut-offs in days: young enough for Pre-Seed per side, and too old for screening.

    One aggregation gives all of them: whether a row is Seed or Series D+ does not depend on age.
    ``percentile`` is exact here and its buffer bounded, as it counts distinct whole days.
    """
    def quantile(cols: StageColumns, stage: str, name: str, q: float, out: str):
        return F.expr(f"percentile(CASE WHEN {stage} = '{name}' THEN {cols.age_days} END, {q})").alias(out)

    aggs = [quantile(s, funding_stage(s), "Seed", seed_age_q, f"seed_age_{s.out_prefix}") for s in sides]
    aggs.append(quantile(sides[0], with_exit(funding_stage(sides[0]), sides[0]), "Series D+", old_age_q, "old_age"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def attach_cutoffs(df: DataFrame, cutoffs: DataFrame, by: Sequence[str] = (), at: Sequence[str] | None = None) -> DataFrame:
    """Cut-offs beside every row, as the struct ``__cut``, from one scalar subquery: rows are not shuffled for it.

    With ``by`` the cut-offs of all slices become one map (as many entries as slices) that each row looks up. ``at``
    are the look-up keys as SQL over ``df``, the columns ``by`` if not given; later slices name there the slice that
    their cut-offs were fitted on. A slice without fitted cut-offs has NULL ones. Keys of ``cutoffs`` must be unique.
    """
    names = [c for c in cutoffs.columns if c not in by]
    if not by:
        return df.withColumn("__cut", cutoffs.select(F.struct(*names).alias("s")).scalar())
    if at is not None and len(at) != len(by):
        raise ValueError(f"{len(by)} look-up keys are needed, {len(at)} given")
    entries = cutoffs.select(F.struct(F.struct(*by).alias("k"), F.struct(*names).alias("v")).alias("e"))
    fitted = entries.agg(F.map_from_entries(F.collect_list("e")).alias("m")).scalar()
    keys = F.struct(*[F.expr(x).alias(name) for x, name in zip(at or by, by)])
    return df.withColumn("__cut", F.try_element_at(fitted, keys))


def name_stages(df: DataFrame, cols: StageColumns) -> DataFrame:
    """Stage, number and group, before and after exits. Needs ``__cut`` from ``attach_cutoffs``.

    Done in steps, so that each stage is worked out once and not once per column made from it.
    """
    p = cols.out_prefix
    young = f"CASE WHEN {cols.age_days} <= __cut.seed_age_{p} THEN 'Pre-Seed' ELSE 'Other' END"
    return (
        df.selectExpr("*", f"coalesce({funding_stage(cols)}, {young}) AS {p}_pre")
        .selectExpr("*", f"{with_exit(p + '_pre', cols)} AS {p}")
        .selectExpr("*", *[f"{fn(x)} AS {x}_{kind}" for x in (p, f"{p}_pre")
                           for kind, fn in (("number", stage_number), ("group", stage_group))])
    )


def add_stages(
    df: DataFrame,
    sides: Sequence[StageColumns] = (FEATURE_COLUMNS, OUTCOME_COLUMNS),
    by: Sequence[str] = (),
    cutoffs: DataFrame | None = None,
    keep_cutoffs: bool = False,
    at: Sequence[str] | None = None,
    **quantiles: float,
) -> DataFrame:
    """Stage columns for each side. Pass fitted ``cutoffs`` to stage a test set by a training set (``at``: see ``attach_cutoffs``)."""
    fitted = fit_cutoffs(df, sides, by, **quantiles) if cutoffs is None else cutoffs
    out = attach_cutoffs(df, fitted, by, at)
    for cols in sides:
        out = name_stages(out, cols)
    return out if keep_cutoffs else out.drop("__cut")


def apply_constraints(df: DataFrame, cols: StageColumns = FEATURE_COLUMNS) -> DataFrame:
    """Keep entities in an included stage that are no older than the old-age cut-off in ``__cut``."""
    return df.where(
        f"{cols.age_days} <= __cut.old_age AND {cols.out_prefix}_group = 'Included'").drop("__cut")


def _rose(to: str, since: str) -> Column:
    return F.expr(f"CAST(coalesce({to} - {since} > 0, false) AS INT)")


def label(kind: str = "Extra_Stage") -> Column:
    """0/1 label column of a merged row."""
    if kind == "Extra_Stage":
        return _rose("outcome_stage_number", "keys_company_stage_number")
    if kind == "Extra_Round":
        return _rose("outcome_stage_pre_number", "keys_company_stage_number")
    flags = {"Exit": "outcome_exit_bool", "Acquisition": "outcome_acquired_bool", "IPO": "outcome_ipo_bool"}
    if kind not in flags:
        raise ValueError(f"unknown label type {kind!r}; known are {LABEL_TYPES}")
    return F.expr(f"CAST(coalesce({flags[kind]}, 0) AS INT)")


def more_rounds() -> Column:
    return _rose("outcome_funding_rounds_number", "confidence_validation_funding_rounds_number")


def outcome_class() -> Column:
    """What happened by the label date; closure first, then IPO, acquisition, a later stage."""
    return F.expr(
        "CASE WHEN outcome_closed_bool >= 1 THEN 'Closed' WHEN outcome_ipo_bool >= 1 THEN 'IPO' "
        "WHEN outcome_acquired_bool >= 1 THEN 'Acquired' "
        "WHEN outcome_stage_number - keys_company_stage_number > 0 THEN 'Raised' ELSE 'No Change' END")


def consistent(df: DataFrame) -> DataFrame:
    """Drop rows that lost rounds over time, and exits that never had a round."""
    return df.where(
        "outcome_funding_rounds_number >= confidence_validation_funding_rounds_number "
        "AND NOT (outcome_exit_bool = 1 AND outcome_funding_rounds_number = 0)")


def ladder(rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First matching rule (SQL condition, name) wins; a NULL condition does not match."""
    whens = " ".join(f"WHEN {condition} THEN '{name}'" for condition, name in rules)
    return F.expr(f"CASE {whens} ELSE '{default}' END")


def age_in_years(days: str) -> Column:
    return F.col(days) / F.lit(DAYS_PER_YEAR)


def split_features(df: DataFrame, kind: str = "Extra_Stage", stage: str | None = None) -> tuple[DataFrame, list[str]]:
    """A merged frame with its ``label`` column, and the names of its feature columns."""
    from tidemark.naming import feature_names

    rows = df if stage is None else df.where(F.col("keys_company_stage") == stage)
    names = [n for n in feature_names(rows.schema) if n != "label"]
    return rows.withColumn("label", label(kind)), names
