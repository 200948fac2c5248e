"""One wide row per entity, for one slice date or for many dates in a single pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.slicing import known_before


@dataclass(frozen=True)
class Measure:
    """An aggregate over the rows of a relation that are known at a slice date.

    ``value`` is a SQL expression. ``kind``: ``count`` (of rows, or of rows satisfying ``value``),
    ``sum``, ``avg``, ``min``, ``max``, or ``flag`` (1 when a row satisfies ``value``, 0 when rows
    have a non-null ``value`` but none satisfies it, else NULL).
    """

    kind: str
    value: str | None = None

    def over(self, known: str) -> str:
        if self.kind == "count":
            test = known if self.value is None else f"({known}) AND ({self.value})"
            return f"count(CASE WHEN {test} THEN 1 END)"
        if self.kind == "flag":
            return f"max(CASE WHEN {known} THEN CAST({self.value} AS INT) END)"
        return f"{self.kind}(CASE WHEN {known} THEN {self.value} END)"


@dataclass(frozen=True)
class Relation:
    """A child relation: which entity a row belongs to, when it became known, what to take from it."""

    frame: DataFrame
    entity: str
    dated_by: str
    measures: Mapping[str, Measure]
    zero_when_absent: Sequence[str] = field(default_factory=tuple)


def aggregate_at(relation: Relation, dates: Mapping[str, date]) -> DataFrame:
    """Measures per entity at every date. Column names are ``{tag}{measure}`` for each date tag.

    Partial sums are formed before the single shuffle on the entity key, so a hot entity costs no
    more than any other.
    """
    df, column = relation.frame, relation.dated_by
    known_rows = df.where(known_before(df, column, max(dates.values())))
    aggs = [
        F.expr(m.over(known_before(df, column, when))).alias(f"{tag}{name}")
        for tag, when in dates.items() for name, m in relation.measures.items()
    ]
    return known_rows.groupBy(F.col(relation.entity).alias("__entity")).agg(*aggs)


def flatten_entities(
    spine: DataFrame, entity: str, relations: Sequence[Relation], dates: Mapping[str, date]
) -> DataFrame:
    """Left-join the aggregates of every relation to the spine.

    All aggregates are partitioned by the entity key already, so the chain of joins adds one exchange
    for the spine only.
    """
    wide = spine
    zero: set[str] = set()
    for i, relation in enumerate(relations):
        agg = aggregate_at(relation, dates).withColumnRenamed("__entity", f"__e{i}")
        wide = wide.join(agg, F.col(entity) == F.col(f"__e{i}"), "left")
        zero |= {f"{tag}{name}" for tag in dates for name in relation.zero_when_absent}
    return wide.selectExpr(*[
        f"coalesce({c}, 0L) AS {c}" if c in zero else c for c in wide.columns if not c.startswith("__e")])


def pair_rows(
    wide: DataFrame,
    keep: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    dates: Mapping[str, date],
    feature: Mapping[str, str],
    outcome: Mapping[str, str],
    created: str | None = None,
) -> DataFrame:
    """One row per entity and (feature date, label date), out of the many-date wide row.

    ``feature`` and ``outcome`` map measure names to output names. ``created`` drops pairs whose
    feature date is not after the entity's creation. No join: the pairs are exploded from the row.
    """
    def picked(f_tag: str, l_tag: str) -> list[tuple[str, str]]:
        return [(f"{f_tag}{m}", out) for m, out in feature.items()] + [(f"{l_tag}{m}", out) for m, out in outcome.items()]

    def days(f_tag: str, l_tag: str) -> list[str]:
        return [f"DATE'{dates[f_tag]}'", f"DATE'{dates[l_tag]}'"]

    if len(pairs) == 1:
        (f_tag, l_tag), = pairs
        f_day, l_day = days(f_tag, l_tag)
        rows = wide if created is None else wide.where(f"{created} < {f_day}")
        return rows.selectExpr(*keep, f"{f_day} AS feature_date", f"{l_day} AS label_date",
                               *[f"{src} AS {out}" for src, out in picked(f_tag, l_tag)])
    names = ["feature_date", "label_date", *[out for _, out in picked(*pairs[0])]]
    structs = []
    for f_tag, l_tag in pairs:
        sources = days(f_tag, l_tag) + [src for src, _ in picked(f_tag, l_tag)]
        structs.append("struct(" + ", ".join(f"{src} AS {out}" for src, out in zip(sources, names)) + ")")
    out = wide.selectExpr(*keep, f"explode(array({', '.join(structs)})) AS __p").selectExpr(*keep, "__p.*")
    return out if created is None else out.where(f"{created} < feature_date")
