"""As-of slicing, slice grids, as-of lookups and date arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Timestamp columns of a relation, in order of preference, and length of a window year.
SLICE_COLUMNS = ("created_at", "started_on", "patent_date")
WINDOW_YEAR_DAYS = 364
DAYS_PER_YEAR = 365.25


def slice_column(df: DataFrame, by: str | None = None) -> str | None:
    """Column that dates the rows of a relation; ``by`` overrides the usual search."""
    if by is not None:
        if by not in df.columns:
            raise ValueError(f"no column {by!r} to slice by; columns are {df.columns}")
        return by
    return next((c for c in SLICE_COLUMNS if c in df.columns), None)


def literal_like(df: DataFrame, column: str, value: date) -> Column:
    """A literal of the column's own type, so that the comparison is pushed into the scan."""
    return F.lit(value.isoformat()).cast(df.schema[column].dataType)


def known_before(df: DataFrame, column: str, when: date) -> str:
    """``literal_like`` comparison as SQL text."""
    return f"{column} < CAST('{when.isoformat()}' AS {df.schema[column].dataType.simpleString()})"


def slice_asof(df: DataFrame, when: date, by: str | None = None) -> DataFrame:
    """Rows known strictly before ``when``; rows without a date are dropped, undated relations kept."""
    column = slice_column(df, by)
    known = df if column is None else df.where(F.col(column) < literal_like(df, column, when))
    return known.withColumn("slice_date", F.lit(when))


def slice_snapshot(snapshot: Mapping[str, DataFrame], when: date, by: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """``slice_asof`` for every relation; ``by`` names the date column of relations that need it."""
    by = by or {}
    return {name: slice_asof(df, when, by.get(name)) for name, df in snapshot.items()}


def forecast_slices(
    spark: SparkSession, start: date, end: date, windows: Sequence[int], n: int, seed: int = 0
) -> DataFrame:
    """``n`` random feature dates crossed with forecast windows of 364-day years."""
    longest = max(windows) * WINDOW_YEAR_DAYS
    span = (end - start).days - longest
    if span < 0:
        raise ValueError("the longest window does not fit between start and end")
    offset = F.floor(F.rand(seed) * (span + 1)).cast("int")
    features = spark.range(n).select(F.date_add(F.lit(start), offset).alias("feature_date"))
    return with_windows(features, "feature_date", windows)


def explicit_slices(spark: SparkSession, pairs: Iterable[tuple[date, date]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "feature_date date, label_date date")


def with_windows(df: DataFrame, feature: str, windows: Sequence[int]) -> DataFrame:
    """One row per (feature date, window) with the label date of that window."""
    return df.withColumn("window_years", F.explode(F.array(*[F.lit(w) for w in windows]))).withColumn(
        "label_date", F.date_add(F.col(feature), F.col("window_years") * WINDOW_YEAR_DAYS))


def test_feature_date(test_date: date, feature_date: date, label_date: date) -> date:
    return test_date - (label_date - feature_date)


def window_years(start: Column, end: Column) -> Column:
    """Whole years of a forecast window, counted as months of 30 days."""
    return F.floor(F.floor(F.datediff(end, start) / 30) / 12).cast("int")


def window_label(start: Column, end: Column) -> Column:
    return F.concat(window_years(start, end).cast("string"), F.lit(" Years"))


def age_days(founded: Column, when: Column) -> Column:
    return F.datediff(when, founded)


def age_years(founded: Column, when: Column) -> Column:
    return F.datediff(when, founded) / F.lit(DAYS_PER_YEAR)


def unix_seconds_sql(column: str) -> str:
    """Unix seconds of a timestamp without zone, whatever the zone of the session."""
    return f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"


def counts_at_slices(
    df: DataFrame, entity: str, created: str, slices: Sequence[date], measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows (and sums) per entity known before each of many slice dates, in one pass.

    Rows are first added up per entity and *first* slice that sees them; only these sums are then
    repeated for the later slices. Rows are never multiplied by the number of slices.
    """
    ordered = sorted(slices)
    measures = dict(measures or {})
    dates = F.array(*[F.lit(d) for d in ordered])
    first = F.lit(len(ordered))
    for i in reversed(range(len(ordered))):
        first = F.when(F.col(created) < literal_like(df, created, ordered[i]), i).otherwise(first)
    known = df.where(F.col(created) < literal_like(df, created, ordered[-1]))
    partial = known.groupBy(entity, first.alias("__first")).agg(
        F.count("*").alias("rows"), *[F.sum(c).alias(m) for m, c in measures.items()])
    later = F.slice(dates, F.col("__first") + 1, len(ordered))
    return (
        partial.withColumn("slice_date", F.explode(later))
        .groupBy("slice_date", entity)
        .agg(F.sum("rows").alias("rows"), *[F.sum(m).alias(m) for m in measures])
    )


def slice_fidelity(sliced: Mapping[str, DataFrame], original: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts per relation of a slice beside those of another snapshot, with their ratio."""
    rows = None
    for name in original:
        one = sliced[name].select(F.lit(name).alias("relation"), F.lit(1).alias("s"), F.lit(0).alias("o")).unionByName(
            original[name].select(F.lit(name).alias("relation"), F.lit(0).alias("s"), F.lit(1).alias("o")))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("relation").agg(
        F.sum("s").alias("sliced_rows"), F.sum("o").alias("original_rows")
    ).withColumn("ratio", F.try_divide(F.col("sliced_rows"), F.col("original_rows")))


def asof_lookup(
    left: DataFrame,
    right: DataFrame,
    left_date: str,
    right_date: str,
    value: str,
    on: Sequence[str] = (),
    until: date | None = None,
) -> DataFrame:
    """The latest ``value`` of a daily or sparser series at or before each left date.

    The series is spread over the calendar days each value holds for, and joined on the day: a hash
    join in place of a range join. Of several values on one day the one latest in time holds
    for the day, the largest where times tie too. Days after the last value take that value, up to
    ``until`` or the last left date. Rows of ``right`` without a date are left out.
    """
    on = list(on)
    last = F.lit(until) if until is not None else left.agg(F.max(F.to_date(left_date)).alias("m")).scalar()
    w = Window.partitionBy(*on).orderBy("__from") if on else Window.partitionBy().orderBy("__from")
    # One value per key and day, or a day's range would run backwards and rows would multiply.
    series = right.where(F.col(right_date).isNotNull()).groupBy(*on, F.to_date(right_date).alias("__from")).agg(
        F.max_by(value, F.struct(F.col(right_date), F.col(value))).alias(value))
    held = series.withColumn("__next", F.lead("__from").over(w)).withColumn(
        "__to", F.coalesce(F.date_sub("__next", 1), F.greatest(last, F.col("__from"))))
    daily = held.withColumn("__day", F.explode(F.sequence("__from", "__to"))).select(*on, "__day", value)
    keyed = left.withColumn("__day", F.to_date(left_date))
    return keyed.join(daily, [*on, "__day"], "left").drop("__day")
