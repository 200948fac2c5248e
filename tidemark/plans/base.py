"""The wide row and the merged feature/outcome row over the given tables, and the same as SQL views."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.naming import ROUND_CODES
from tidemark.operators import labels as L
from tidemark.operators.flatten import Measure, Relation, flatten_entities, pair_rows
from tidemark.operators.slicing import DAYS_PER_YEAR
from tidemark.sources.bindings import FEATURE_DATE, LABEL_DATE, YEARLY_SLICES, Tables, define_view

SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")

AGE = "confidence_context_economy_company_age_number"
ROUNDS = "confidence_validation_funding_rounds_number"
RAISED = "confidence_validation_funding_raised_value_total_number"
CODE = "confidence_validation_funding_round_codes_list_"
PATENTS = "potential_structural_patents_number"
STAFF = "confidence_performance_other_staff_all_total_number"
SEGMENT = "confidence_context_industry_category_group_list_"

ONE_PAIR = ((FEATURE_DATE, LABEL_DATE),)
YEAR_PAIRS = tuple((f, l) for i, f in enumerate(YEARLY_SLICES) for l in YEARLY_SLICES[i:])


def round_relation(t: Tables) -> Relation:
    return Relation(
        t.rounds(), "org_id", "created_at",
        {"rounds": Measure("count"), "raised": Measure("sum", "raised_usd"),
         **{f"code_{c}": Measure("flag", f"code = '{c}'") for c in ROUND_CODES}},
        zero_when_absent=("rounds",))


def deal_relation(t: Tables) -> Relation:
    """Patents and staff come from the same child rows, so one scan and one join serve both."""
    deals = t.deals()
    return Relation(deals, "org_id", "l_shipdate", {
        "patents": Measure("count", "l_returnflag = 'R'"), "staff": Measure("count")}, ("patents", "staff"))


def wide_frame(t: Tables, dates: dict[str, date], detail: bool) -> DataFrame:
    """Organisations with their measures at every date; one scan and one shuffle per relation."""
    spine = t.orgs().where(F.col("created_at") < F.lit(max(dates.values())))
    relations = [round_relation(t)]
    if detail:
        relations.append(deal_relation(t))
    wide = flatten_entities(spine, "org_id", relations, dates)
    derived = []
    for tag, when in dates.items():
        derived.append(f"datediff(DATE'{when}', founded_on) AS {tag}age")
        derived += [f"CAST(status = '{s}' AND status_on < DATE'{when}' AS INT) AS {tag}{s}" for s in ("closed", "acquired", "ipo")]
    if detail:
        derived += [f"CAST(lower(segment) = '{s}' AS INT) AS {SEGMENT}{s}" for s in SEGMENTS]
    return wide.selectExpr("*", *derived)


def merged_frame(t: Tables, pairs: Sequence[tuple[date, date]] = ONE_PAIR, detail: bool = False) -> DataFrame:
    """Feature row joined with its outcome row for each (feature date, label date)."""
    all_dates = sorted({d for p in pairs for d in p})
    tags = {d: f"d{i}_" for i, d in enumerate(all_dates)}
    dates = {tags[d]: d for d in all_dates}
    wide = wide_frame(t, dates, detail)
    feature = {
        "age": "keys_company_age_days", "closed": "keys_company_status_closed_bool",
        "acquired": "keys_company_status_acquired_bool", "ipo": "keys_company_status_ipo_bool",
        "rounds": ROUNDS, "raised": RAISED, **{f"code_{c}": f"{CODE}{c}" for c in ROUND_CODES}}
    if detail:
        feature |= {"patents": PATENTS, "staff": STAFF}
    outcome = {
        "age": "outcome_age_days", "closed": "outcome_closed_bool", "acquired": "outcome_acquired_bool",
        "ipo": "outcome_ipo_bool", "rounds": "outcome_funding_rounds_number",
        "raised": "outcome_funding_raised_value_total_number",
        **{f"code_{c}": f"outcome_funding_round_codes_list_{c}" for c in ROUND_CODES}}
    keep = ["org_id", "name", "segment", "created_at"] + ([f"{SEGMENT}{s}" for s in SEGMENTS] if detail else [])
    rows = pair_rows(wide, keep, [(tags[f], tags[l]) for f, l in pairs], dates, feature, outcome, "created_at")
    return rows.selectExpr(
        "org_id AS keys_company_id", "name AS keys_company_name_id",
        *[c for c in rows.columns if c not in ("org_id", "name", "created_at")],
        f"keys_company_age_days / {DAYS_PER_YEAR}D AS {AGE}", f"outcome_age_days / {DAYS_PER_YEAR}D AS outcome_age_number",
        "greatest(outcome_acquired_bool, outcome_ipo_bool) AS outcome_exit_bool",
    )


SLICE = ("feature_date", "label_date")


def cutoffs_of(t: Tables, pairs=ONE_PAIR, sides=(L.FEATURE_COLUMNS, L.OUTCOME_COLUMNS), **quantiles: float) -> DataFrame:
    """Cut-offs of each (feature date, label date). They need the rounds only, so the other relations are not read."""
    return L.fit_cutoffs(merged_frame(t, pairs), sides, SLICE, **quantiles)


def later_pairs(pairs, days: int):
    """The same windows, ``days`` later: what a model of ``pairs`` is tried on."""
    return tuple((f + timedelta(days=days), l + timedelta(days=days)) for f, l in pairs)


def staged_frame(t: Tables, pairs=ONE_PAIR, detail: bool = False, fitted_on=None, **options) -> DataFrame:
    """Merged rows with stages; cut-offs are taken per (feature date, label date).

    ``fitted_on``: the training slice of each pair, in the order of ``pairs``, whose cut-offs its rows get.
    """
    sides = options.pop("sides", (L.FEATURE_COLUMNS, L.OUTCOME_COLUMNS))
    rows = merged_frame(t, pairs, detail)
    if fitted_on is None:
        return L.add_stages(rows, sides, SLICE, cutoffs_of(t, pairs, sides), **options)
    if len(fitted_on) != len(pairs):
        raise ValueError(f"{len(pairs)} slices, but {len(fitted_on)} training slices")
    now = lambda f, l: f"feature_date = DATE'{f}' AND label_date = DATE'{l}'"
    at = ["CASE " + " ".join(f"WHEN {now(*p)} THEN DATE'{q[i]}'" for p, q in zip(pairs, fitted_on)) + " END" for i in range(2)]
    return L.add_stages(rows, sides, SLICE, cutoffs_of(t, tuple(dict.fromkeys(fitted_on)), sides), at=at, **options)


def forecast_frame(t: Tables, pairs=ONE_PAIR, detail: bool = False, fitted_on=None) -> DataFrame:
    """Staged rows that pass the screen."""
    return L.apply_constraints(staged_frame(t, pairs, detail, fitted_on, keep_cutoffs=True))


# ---- the same as SQL -------------------------------------------------------------------------

def _pairs_sql(pairs) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"(DATE '{f}', DATE '{l}')" for f, l in pairs) + ") v(feature_date, label_date)"


_CODES_AGG = ", ".join(
    f"max(CASE WHEN code = '{c}' THEN 1 WHEN code IS NOT NULL THEN 0 END) AS code_{c}" for c in ROUND_CODES)
_CODES = ", ".join(f"code_{c}" for c in ROUND_CODES)


def _ladder_sql(p: str) -> str:
    late = " + ".join(f"coalesce({p}code_{c}, 0)" for c in ROUND_CODES[3:])
    return f"""CASE WHEN {late} >= 1 THEN 'Series D+' WHEN {p}code_c >= 1 THEN 'Series C'
        WHEN {p}code_b >= 1 THEN 'Series B' WHEN {p}code_a >= 1 THEN 'Series A'
        WHEN {p}raised >= 0 THEN 'Seed' END"""


def _exit_sql(p: str, pre: str) -> str:
    return f"CASE WHEN {p}closed >= 1 THEN 'Closed' WHEN {p}acquired >= 1 THEN 'Acquired' WHEN {p}ipo >= 1 THEN 'IPO' ELSE {pre} END"


def _number_sql(x: str) -> str:
    whens = " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in L.STAGE_NUMBERS.items())
    return f"CASE {whens} END"


def _group_sql(x: str) -> str:
    names = ", ".join(f"'{s}'" for s in L.INCLUDED_STAGES)
    return f"CASE WHEN {x} IN ({names}) THEN 'Included' ELSE 'Excluded' END"


def _define(prefix: str, pairs, detail: bool, fitted: tuple[str, int] | None = None) -> None:
    """``fitted``: prefix of the training slices and how many days earlier they are."""
    needs = ("orgs", "rounds") + (("patents", "jobs") if detail else ())
    v = lambda n: f"{prefix}{n}"
    define_view(v("pairs"), _pairs_sql(pairs))
    define_view(v("dates"), f"SELECT feature_date AS d FROM {v('pairs')} UNION SELECT label_date FROM {v('pairs')}", (v("pairs"),))
    define_view(v("r"), f"""SELECT d, org_id, count(*) AS rounds, sum(raised_usd) AS raised, {_CODES_AGG}
        FROM {v('dates')} JOIN rounds ON created_at < d GROUP BY d, org_id""", (v("dates"),) + needs)
    extra_cols, extra_join = "", ""
    extra_needs: tuple[str, ...] = ()
    if detail:
        define_view(v("p"), f"SELECT d, org_id, count(*) AS patents FROM {v('dates')} JOIN patents ON patent_date < d GROUP BY d, org_id", (v("dates"),) + needs)
        define_view(v("j"), f"SELECT d, org_id, count(*) AS staff FROM {v('dates')} JOIN jobs ON started_on < d GROUP BY d, org_id", (v("dates"),) + needs)
        extra_cols = ", coalesce(p.patents, 0) AS patents, coalesce(j.staff, 0) AS staff"
        extra_join = f"LEFT JOIN {v('p')} p ON p.d = x.d AND p.org_id = o.org_id LEFT JOIN {v('j')} j ON j.d = x.d AND j.org_id = o.org_id"
        extra_needs = (v("p"), v("j"))
    define_view(v("side"), f"""SELECT x.d, o.org_id, o.name, o.segment, o.created_at,
            CAST(date_diff('day', o.founded_on, x.d) AS INTEGER) AS age,
            CASE WHEN o.status = 'closed' AND o.status_on < x.d THEN 1 ELSE 0 END AS closed,
            CASE WHEN o.status = 'acquired' AND o.status_on < x.d THEN 1 ELSE 0 END AS acquired,
            CASE WHEN o.status = 'ipo' AND o.status_on < x.d THEN 1 ELSE 0 END AS ipo,
            coalesce(r.rounds, 0) AS rounds, r.raised, {_CODES}{extra_cols}
        FROM {v('dates')} x CROSS JOIN orgs o LEFT JOIN {v('r')} r ON r.d = x.d AND r.org_id = o.org_id {extra_join}""",
        (v("dates"), v("r")) + extra_needs + needs)
    base = ["age", "closed", "acquired", "ipo", "rounds", "raised"] + [f"code_{c}" for c in ROUND_CODES]
    f_cols = ", ".join(f"f.{c} AS f_{c}" for c in base + (["patents", "staff"] if detail else []))
    l_cols = ", ".join(f"l.{c} AS l_{c}" for c in base)
    define_view(v("joined"), f"""SELECT feature_date, label_date, f.org_id, f.name, f.segment, {f_cols}, {l_cols}
        FROM {v('pairs')} JOIN {v('side')} f ON f.d = feature_date AND f.created_at < feature_date
        JOIN {v('side')} l ON l.d = label_date AND l.org_id = f.org_id""", (v("pairs"), v("side")))
    define_view(v("pre"), f"SELECT *, {_ladder_sql('f_')} AS f_fund, {_ladder_sql('l_')} AS l_fund FROM {v('joined')}", (v("joined"),))
    define_view(v("cut"), f"""SELECT feature_date, label_date,
            quantile_cont(f_age, 0.75) FILTER (WHERE f_fund = 'Seed') AS f_seed,
            quantile_cont(l_age, 0.75) FILTER (WHERE l_fund = 'Seed') AS l_seed,
            quantile_cont(f_age, 0.75) FILTER (WHERE {_exit_sql('f_', 'f_fund')} = 'Series D+') AS old_age
        FROM {v('pre')} GROUP BY 1, 2""" if fitted is None else f"""SELECT CAST(feature_date + INTERVAL {fitted[1]} DAYS AS DATE) AS feature_date,
            CAST(label_date + INTERVAL {fitted[1]} DAYS AS DATE) AS label_date, f_seed, l_seed, old_age FROM {fitted[0]}cut""",
        (v("pre") if fitted is None else f"{fitted[0]}cut",))
    define_view(v("named"), f"""SELECT p.*, old_age,
            coalesce(f_fund, CASE WHEN f_age <= f_seed THEN 'Pre-Seed' ELSE 'Other' END) AS keys_company_stage_pre,
            coalesce(l_fund, CASE WHEN l_age <= l_seed THEN 'Pre-Seed' ELSE 'Other' END) AS outcome_stage_pre
        FROM {v('pre')} p JOIN {v('cut')} c USING (feature_date, label_date)""", (v("pre"), v("cut")))
    define_view(v("exits"), f"""SELECT *, {_exit_sql('f_', 'keys_company_stage_pre')} AS keys_company_stage,
            {_exit_sql('l_', 'outcome_stage_pre')} AS outcome_stage FROM {v('named')}""", (v("named"),))
    detail_cols = ""
    if detail:
        detail_cols = f", f_patents AS {PATENTS}, f_staff AS {STAFF}, " + ", ".join(
            f"CASE WHEN lower(segment) = '{s}' THEN 1 ELSE 0 END AS {SEGMENT}{s}" for s in SEGMENTS)
    stages = ", ".join(
        f"{_number_sql(s)} AS {s}_number, {_number_sql(s + '_pre')} AS {s}_pre_number, "
        f"{_group_sql(s)} AS {s}_group, {_group_sql(s + '_pre')} AS {s}_pre_group"
        for s in ("keys_company_stage", "outcome_stage"))
    define_view(v("staged"), f"""SELECT feature_date, label_date, org_id AS keys_company_id, name AS keys_company_name_id, segment,
            f_age AS keys_company_age_days, f_closed AS keys_company_status_closed_bool,
            f_acquired AS keys_company_status_acquired_bool, f_ipo AS keys_company_status_ipo_bool,
            f_age / 365.25 AS {AGE}, f_rounds AS {ROUNDS}, f_raised AS {RAISED},
            {", ".join(f"f_code_{c} AS {CODE}{c}" for c in ROUND_CODES)}{detail_cols},
            l_age AS outcome_age_days, l_age / 365.25 AS outcome_age_number, l_rounds AS outcome_funding_rounds_number,
            l_raised AS outcome_funding_raised_value_total_number,
            {", ".join(f"l_code_{c} AS outcome_funding_round_codes_list_{c}" for c in ROUND_CODES)},
            l_closed AS outcome_closed_bool, l_acquired AS outcome_acquired_bool, l_ipo AS outcome_ipo_bool,
            greatest(l_acquired, l_ipo) AS outcome_exit_bool,
            keys_company_stage, keys_company_stage_pre, outcome_stage, outcome_stage_pre, {stages}, old_age
        FROM {v('exits')}""", (v("exits"),))
    define_view(v("forecast"), f"""SELECT * FROM {v('staged')}
        WHERE keys_company_age_days <= old_age AND keys_company_stage_group = 'Included'""", (v("staged"),))


# ``one_staged``/``one_forecast``: the single pair; ``full_…`` with all relations; ``grid_…`` the yearly pairs.
_define("one_", ONE_PAIR, False)
_define("full_", ONE_PAIR, True)
_define("grid_", YEAR_PAIRS, False)
# ``later_…``: the grid's windows half a year later, staged by the cut-offs of the grid.
LATER_DAYS = 182
LATER_PAIRS = later_pairs(YEAR_PAIRS, LATER_DAYS)
_define("later_", LATER_PAIRS, False, ("grid_", LATER_DAYS))

EXTRA_STAGE_SQL = "CASE WHEN outcome_stage_number - keys_company_stage_number > 0 THEN 1 ELSE 0 END"
EXTRA_ROUND_SQL = "CASE WHEN outcome_stage_pre_number - keys_company_stage_number > 0 THEN 1 ELSE 0 END"
OUTCOME_SQL = f"""CASE WHEN outcome_closed_bool >= 1 THEN 'Closed' WHEN outcome_ipo_bool >= 1 THEN 'IPO'
    WHEN outcome_acquired_bool >= 1 THEN 'Acquired' WHEN {EXTRA_STAGE_SQL} >= 1 THEN 'Raised' ELSE 'No Change' END"""
WINDOW_YEARS_SQL = "CAST(floor(floor(date_diff('day', feature_date, label_date) / 30) / 12) AS INTEGER)"
