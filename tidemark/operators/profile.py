"""Column statistics: profiles, moments, correlations, normality, principal components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.naming import factor_of
from tidemark.operators.quantiles import average_ranks, exact_quantiles, melt

PAIRS_PER_PASS = 400


def sample_skew_sql(n: str, g1: str) -> str:
    """Bias-corrected skewness from the population form."""
    return f"CASE WHEN {n} > 2 THEN {g1} * sqrt(1.0D * {n} * ({n} - 1)) / ({n} - 2) END"


def sample_kurtosis_sql(n: str, g2: str) -> str:
    """Bias-corrected excess kurtosis from the population form."""
    return f"CASE WHEN {n} > 3 THEN ({n} - 1.0D) / (({n} - 2.0D) * ({n} - 3.0D)) * (({n} + 1) * {g2} + 6) END"


def normality_steps(n: str = "n", g1: str = "g1", g2: str = "g2") -> list[list[str]]:
    """D'Agostino and Pearson's K² in steps of SQL: each step may use the columns of those before it.

    Published closed forms for the transformed skewness and kurtosis; plain SQL of any dialect.
    """
    return [
        [f"CAST({n} AS DOUBLE) AS m", f"{g1} AS s1", f"{g2} + 3 AS b2"],
        ["s1 * sqrt((m + 1) * (m + 3) / (6 * (m - 2))) AS y",
         "3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3) / ((m - 2) * (m + 5) * (m + 7) * (m + 9)) AS beta2",
         "(b2 - 3 * (m - 1) / (m + 1)) / sqrt(24 * m * (m - 2) * (m - 3) / ((m + 1) * (m + 1) * (m + 3) * (m + 5))) AS x",
         "6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9)) * sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3))) AS rb1"],
        ["sqrt(2 * (beta2 - 1)) - 1 AS w2", "6 + 8 / rb1 * (2 / rb1 + sqrt(1 + 4 / (rb1 * rb1))) AS a"],
        ["1 / sqrt(0.5 * ln(w2)) AS delta", "sqrt(2 / (w2 - 1)) AS alpha", "1 + x * sqrt(2 / (a - 4)) AS denom"],
        ["delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS z_skew",
         "(1 - 2 / (9 * a) - sign(denom) * cbrt((1 - 2 / a) / abs(denom))) / sqrt(2 / (9 * a)) AS z_kurt"],
        ["z_skew * z_skew + z_kurt * z_kurt AS k2"],
        ["exp(-k2 / 2) AS p_value"],
    ]


def add_normality(df: DataFrame) -> DataFrame:
    """Adds ``k2`` and ``p_value`` to a frame with ``n``, ``g1``, ``g2``; fewer than 8 values give NULL."""
    keep = df.columns
    out = df.where("n >= 8 AND g1 IS NOT NULL")
    for step in normality_steps():
        out = out.selectExpr("*", *step)
    return out.select(*keep, "k2", "p_value")


def numeric_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, spread, ends and moments per column; all columns in one aggregation pass."""
    structs = [
        f"struct('{c}' AS column, count(`{c}`) AS n, count(*) - count(`{c}`) AS missing, CAST(avg(`{c}`) AS DOUBLE) AS mean, stddev_samp(`{c}`) AS std, "
        f"CAST(min(`{c}`) AS DOUBLE) AS min, CAST(max(`{c}`) AS DOUBLE) AS max, skewness(`{c}`) AS g1, kurtosis(`{c}`) AS g2)" for c in columns]
    return df.agg(F.expr(f"array({', '.join(structs)})").alias("s")).selectExpr("inline(s)")


PROFILE = ("column", "datatype", "count", "missing", "mean", "std", "min", "p25", "p50", "p75", "max", "skew", "kurtosis",
           "norm_k2", "norm_pval", "distinct", "top", "freq")


def _as_number(field: T.StructField) -> str | None:
    """SQL of what describes a column by numbers: its values, or the lengths of lists and maps. NULL where it has none."""
    if isinstance(field.dataType, T.NumericType):
        return f"`{field.name}`"
    return f"size(`{field.name}`)" if isinstance(field.dataType, (T.ArrayType, T.MapType)) else None


def _as_text(field: T.StructField) -> str:
    """SQL of the text that stands for a value of any other type; equal values have equal texts."""
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format(`{field.name}`, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    if isinstance(field.dataType, T.BinaryType):
        return f"hex(`{field.name}`)"
    return f"to_json(`{field.name}`)" if isinstance(field.dataType, T.StructType) else f"CAST(`{field.name}` AS STRING)"


def _stacked(parts: Sequence[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def snapshot_dictionary(snapshot: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of every relation: the numeric description, or count, distinct, top value and its frequency.

    Numbers, and lists and maps by their lengths, have the first; texts, booleans, dates, times, binaries and structs
    the second (ties to the smallest text). The columns of all relations are stacked and then described together, so the
    number of shuffles does not grow with the number of columns or relations. An empty column has count 0 and NULLs.
    """
    moments, numbers, values, types, places = [], [], [], [], []
    for relation, df in snapshot.items():
        numeric = {f.name: x for f in df.schema.fields if (x := _as_number(f))}
        text = {f.name: _as_text(f) for f in df.schema.fields if f.name not in numeric}
        types += [(relation, f.name, f.dataType.simpleString()) for f in df.schema.fields]
        if numeric:
            one = df.selectExpr(*[f"{x} AS `{c}`" for c, x in numeric.items()])
            moments.append(numeric_moments(one, list(numeric)).withColumn("relation", F.lit(relation)))
            # The columns go by numbers, not by names, while their many rows are counted.
            at = {f"{len(places) + i}": c for i, c in enumerate(numeric)}
            places += [(int(i), relation, c) for i, c in at.items()]
            numbers.append(melt(one.selectExpr(*[f"`{c}` AS `{i}`" for i, c in at.items()]), [], list(at), "at").withColumn("at", F.col("at").cast("int")))
        if text:
            values.append(df.selectExpr(*[f"{x} AS `{c}`" for c, x in text.items()]).unpivot([], list(text), "column", "value").withColumn("relation", F.lit(relation)))
            # A row for each column, so that one of an empty relation has its line.
            values.append(df.sparkSession.createDataFrame([(c, None, relation) for c in text], "column string, value string, relation string"))
    place = ["relation", "column"]
    out = None
    if numbers:
        m = _stacked(moments)
        q = exact_quantiles(_stacked(numbers), ["at"], "value", (0.25, 0.5, 0.75))
        q = q.join(F.broadcast(m.sparkSession.createDataFrame(places, "at int, relation string, column string")), "at").drop("at")
        k = add_normality(m.select(*place, "n", "g1", "g2")).select(*place, "k2", "p_value")
        out = m.join(q, place, "left").join(k, place, "left").selectExpr(
            *place, "n AS count", "missing", "mean", "std", "min", "p25", "p50", "p75", "max",
            f"{sample_skew_sql('n', 'g1')} AS skew", f"{sample_kurtosis_sql('n', 'g2')} AS kurtosis", "k2 AS norm_k2", "p_value AS norm_pval",
            "CAST(NULL AS BIGINT) AS distinct", "CAST(NULL AS STRING) AS top", "CAST(NULL AS BIGINT) AS freq")
    if values:
        counted = _stacked(values).groupBy(*place, "value").agg(F.count("*").alias("c"))
        cat = counted.groupBy(*place).agg(
            F.expr("sum(CASE WHEN value IS NOT NULL THEN c ELSE 0 END)").alias("count"),
            F.expr("sum(CASE WHEN value IS NULL THEN c ELSE 0 END) - 1").alias("missing"),  # but for the column's own line
            F.expr("count(value)").alias("distinct"),
            F.expr("min_by(value, struct(-c, value)) FILTER (WHERE value IS NOT NULL)").alias("top"),
            F.expr("max(c) FILTER (WHERE value IS NOT NULL)").alias("freq"))
        out = cat if out is None else out.unionByName(cat, allowMissingColumns=True)
    first = next(iter(snapshot.values())).sparkSession
    named = first.createDataFrame(types, "relation string, column string, datatype string")  # as many rows as columns
    described = out.join(F.broadcast(named), place)
    return described.select(*[c for c in PROFILE if c in described.columns], "relation")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column of one relation (see ``snapshot_dictionary``)."""
    return snapshot_dictionary({"": df}).drop("relation")


def pairwise_pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present: (a, b, r).

    All pairs of a pass share one scan; very wide frames take several passes.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    out = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        structs = ", ".join(
            f"struct('{a}' AS a, '{b}' AS b, {_pearson(a, b)} AS r)" for a, b in pairs[start:start + PAIRS_PER_PASS])
        one = df.agg(F.expr(f"array({structs})").alias("s")).selectExpr("inline(s)")
        out = one if out is None else out.unionByName(one)
    return out.selectExpr("a", "b", "nanvl(r, NULL) AS r")


def _pearson(a: str, b: str) -> str:
    """Correlation over the rows where both are present; NULL where one of them does not vary there."""
    y, x = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return f"try_divide(regr_sxy({y}, {x}), sqrt(regr_sxx({y}, {x})) * sqrt(regr_syy({y}, {x})))"


def gap_classes(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> dict[str, str | None]:
    """For each column the first column with gaps in the same rows, or None without gaps. One pass; a number a column comes back."""
    gone = [F.expr(f"struct(bit_xor(CASE WHEN {c} IS NULL THEN xxhash64({', '.join(keys)}) END) AS x, count_if({c} IS NULL) AS n)").alias(f"g{i}") for i, c in enumerate(columns)]
    row = df.agg(*gone).head()
    first: dict = {}
    return {c: first.setdefault((row[f"g{i}"]["x"], row[f"g{i}"]["n"]), c) if row[f"g{i}"]["n"] else None for i, c in enumerate(columns)}


def rank_within(df: DataFrame, keys: Sequence[str], contexts: dict[str, tuple[str, str | None]]) -> DataFrame:
    """``keys`` and, for each context, the average rank of a column among the rows where another column (if any) is present.

    ``contexts``: output name → (column, other column or None). All contexts are ranked together in long form, by
    value ranges of each, so the number of shuffles does not grow with their number.
    """
    values = [f"CASE WHEN {other} IS NOT NULL THEN CAST({c} AS DOUBLE) END AS {name}" if other else f"CAST({c} AS DOUBLE) AS {name}"
              for name, (c, other) in contexts.items()]
    long = melt(df.selectExpr(*keys, *values), keys, list(contexts), "__column", "__value").where("__value IS NOT NULL")
    ranks = average_ranks(long, "__value", ["__column"], "__rank")
    ranked = long.join(ranks, ["__column", "__value"])
    return ranked.groupBy(*keys).agg(
        *[F.expr(f"max(CASE WHEN __column = '{c}' THEN __rank END)").alias(c) for c in contexts])


def pairwise_spearman(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns over the rows where both are present: (a, b, r).

    Ranks are taken among a pair's complete rows. Columns with gaps in the same rows share them, so a column is
    ranked once for itself and once for each other set of gaps; without gaps, once. ``keys`` identify a row.
    """
    gaps = gap_classes(df, keys, columns)
    place = {c: i for i, c in enumerate(columns)}
    contexts: dict[str, tuple[str, str | None]] = {}

    def ranked(c: str, other: str) -> str:
        given = gaps[other] if gaps[other] != gaps[c] else None
        name = f"r{place[c]}" + (f"_{place[given]}" if given else "")
        contexts[name] = (c, given)
        return name

    pairs = [(a, b, ranked(a, b), ranked(b, a)) for i, a in enumerate(columns) for b in columns[i + 1:]]
    ranks = rank_within(df, keys, contexts)
    out = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        structs = ", ".join(f"struct('{a}' AS a, '{b}' AS b, {_pearson(x, y)} AS r)" for a, b, x, y in pairs[start:start + PAIRS_PER_PASS])
        one = ranks.agg(F.expr(f"array({structs})").alias("s")).selectExpr("inline(s)")
        out = one if out is None else out.unionByName(one)
    return out.selectExpr("a", "b", "nanvl(r, NULL) AS r")


def share_above(correlations: DataFrame, columns: int, thresholds: Sequence[float]) -> DataFrame:
    """Percent of the full matrix, diagonal included, whose absolute value reaches each threshold."""
    ts = ", ".join(f"{x}D" for x in thresholds)
    both = correlations.where("r IS NOT NULL").selectExpr("2 AS weight", "abs(r) AS r")
    hit = both.selectExpr("weight", "r", f"explode(array({ts})) AS threshold")
    return hit.groupBy("threshold").agg(
        F.expr(f"({columns} + sum(CASE WHEN r >= threshold THEN weight ELSE 0 END)) * 100.0D / ({columns} + sum(weight))").alias("percent"))


def factor_correlation(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rank correlation between factor totals, after columns opposed within a factor were flipped.

    Signs come from the rank correlations of all rows; a column is flipped when it still opposes an
    earlier one of its factor, in name order. Only the columns-by-columns table reaches the driver.
    """
    ordered = sorted(columns)
    r = {(x["a"], x["b"]): x["r"] or 0.0 for x in pairwise_spearman(df, keys, ordered).collect()}
    sign = dict.fromkeys(ordered, 1)
    groups: dict[str, list[str]] = {}
    for c in ordered:
        groups.setdefault(factor_of(c) or "none", []).append(c)
    for members in groups.values():
        for a, b in combinations(members, 2):
            if sign[a] * sign[b] * r[(a, b)] < 0:
                sign[b] = -sign[b]
    totals = df.selectExpr(*keys, *[" + ".join(f"{sign[c]} * {c}" for c in members) + f" AS {g}" for g, members in groups.items()])
    return pairwise_spearman(totals, keys, sorted(groups))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Columns-by-columns Pearson matrix of null-free columns, computed on the cluster; 0 for a column that does not vary."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(df.select(*columns)).select("v")
    r = Correlation.corr(vectors, "v").head()[0].toArray()
    flat = np.isnan(r).sum(axis=0) >= max(1, len(r) - 1)
    r[flat, :] = r[:, flat] = 0
    return r


def scree(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and vectors of the correlation matrix: the components of standardised data."""
    values, vectors = np.linalg.eigh(correlation_matrix(df, columns))
    order = np.argsort(values)[::-1]
    return values[order], vectors[:, order]


def fit_projection(df: DataFrame, columns: Sequence[str], components: int = 2) -> tuple[list[float], list[list[float]]]:
    """(means, loadings of each component) of the main axes of complete rows. Only columns x columns sums come back.

    Each axis points to where its largest loading (the first of equal ones) is positive.
    """
    d = len(columns)
    complete = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    cells = [F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}_{j}") for i in range(d) for j in range(i, d)]
    row = complete.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *cells).head()
    if row["m0"] is None:
        raise ValueError("no complete rows to project")
    cov = np.array([[row[f"v{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values, kind="stable")[:components]].T
    axes = [a * (1 if a[np.argmax(np.round(np.abs(a), 12))] >= 0 else -1) for a in axes]
    return [row[f"m{i}"] for i in range(d)], [a.tolist() for a in axes]


def project(df: DataFrame, columns: Sequence[str], keep: Sequence[str], components: int = 2, fitted=None) -> DataFrame:
    """``keep`` columns (key, label) and pc1, pc2 … of each row, as column expressions; NULL where a column is NULL."""
    means, axes = fitted if fitted is not None else fit_projection(df, columns, components)
    sums = [" + ".join(f"{w!r}D * (CAST({c} AS DOUBLE) - {m!r}D)" for c, w, m in zip(columns, axis, means)) for axis in axes]
    return df.selectExpr(*keep, *[f"{s} AS pc{i + 1}" for i, s in enumerate(sums)])


def transform_comparison(df: DataFrame, column: str) -> DataFrame:
    """Skewness and kurtosis of a non-negative column as it is, by log1p and by root; with and without zeros."""
    forms = {"None": column, "Log1P": f"log1p({column})", "SQRT": f"sqrt({column})"}
    structs = ", ".join(
        f"struct('{name}' AS method, skewness({e}) AS skew, kurtosis({e}) AS kurtosis, "
        f"skewness(nullif({e}, 0)) AS skew_nonzero, kurtosis(nullif({e}, 0)) AS kurtosis_nonzero)" for name, e in forms.items())
    return df.agg(F.expr(f"array({structs})").alias("s")).selectExpr("inline(s)")


def shift_positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns moved so that their smallest value is 0."""
    lows = df.agg(F.expr("struct(" + ", ".join(f"min({c}) AS {c}" for c in columns) + ")")).scalar()
    others = [c for c in df.columns if c not in columns]
    return df.withColumn("__lo", lows).selectExpr(*others, *[f"{c} - __lo.{c} AS {c}" for c in columns])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return (df.where(f"{column} IS NOT NULL").groupBy(F.expr(f"width_bucket({column}, {low}D, {high}D, {bins})").alias("bin"))
            .agg(F.count("*").alias("n")))
