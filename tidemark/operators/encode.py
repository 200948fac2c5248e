"""Feature encoding: lists, pairs, dates, numbers, flags and bins."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.naming import ROUND_CODES, ROUND_TYPES, by_plain_name, cleaning_of, feature_names, plain_name

SEPARATOR = ";"
TOP_N = 10


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens_sql(column: str) -> str:
    return f"split(lower({column}), '{SEPARATOR}')"


def with_parsed(df: DataFrame, lists: Sequence[str] = (), pairs: Sequence[str] = ()) -> DataFrame:
    """Adds each list or pair string in parsed form, so that it is taken apart once per row.

    Lists become ``__tokens_{column}``; pairs ``"k v;k v"`` become ``__pairs_{column}``, an array of
    (k, v text, number), parts without a value left out.
    """
    def pair(column: str) -> str:
        part = ("named_struct('k', lower(split_part(p, ' ', 1)), 'v', nullif(split_part(p, ' ', 2), ''), "
                "'number', try_cast(split_part(p, ' ', 2) AS DOUBLE))")
        return f"filter(transform(split({column}, '{SEPARATOR}'), p -> {part}), p -> p.v IS NOT NULL) AS __pairs_{column}"

    return df.selectExpr("*", *[f"{tokens_sql(c)} AS __tokens_{c}" for c in lists], *[pair(c) for c in pairs])


def column_token(token: str) -> str:
    return plain_name(token.lower())


def listed_sql(column: str, values: Sequence[str]) -> str:
    """Whether a row's parsed list has one of the values."""
    if len(values) == 1:
        return f"array_contains(__tokens_{column}, {quoted(values[0])})"
    return f"arrays_overlap(__tokens_{column}, array({', '.join(map(quoted, values))}))"


def list_dummies_sql(column: str, vocabulary: Sequence[str]) -> list[str]:
    """0/1 per token; rows without a list get NULL. Tokens that fold to one name share a column. Needs the parsed list."""
    return [f"CAST({listed_sql(column, vs)} AS INT) AS `{column}_{name}`" for name, vs in by_plain_name(vocabulary).items()]


def vocabulary(df: DataFrame, column: str, top_n: int | None = None, include: str | None = None,
               exclude: str | None = None) -> DataFrame:
    """Tokens of a list column with their counts, most frequent first, ties by name.

    ``include`` / ``exclude`` are patterns that must match the whole token.
    """
    tokens = df.where(f"{column} IS NOT NULL").selectExpr(f"explode({tokens_sql(column)}) AS token")
    if include is not None:
        tokens = tokens.where(F.col("token").rlike(f"^(?:{include})$"))
    if exclude is not None:
        tokens = tokens.where(~F.col("token").rlike(f"^(?:{exclude})$"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return counted if top_n is None else counted.orderBy(F.desc("n"), "token").limit(top_n)


def fit_vocabulary(df: DataFrame, column: str, top_n: int = TOP_N) -> list[str]:
    """The top tokens as names for columns: at most ``top_n`` rows reach the driver."""
    return [r["token"] for r in vocabulary(df, column, top_n).orderBy(F.desc("n"), "token").collect()]


def top_dummies_sql(column: str, top: Sequence[str]) -> list[str]:
    """Dummies of the top tokens, one for those that fold to one name; a row with none of them is NULL in all. Needs the parsed list."""
    listed = "array(" + ", ".join(quoted(v) for v in top) + ")"
    return [
        f"CASE WHEN arrays_overlap(__tokens_{column}, {listed}) THEN "
        f"CAST({listed_sql(column, vs)} AS INT) END AS `{column}_{name}`" for name, vs in by_plain_name(top).items()
    ]


def fixed_dummies_sql(df: DataFrame, column: str, words: Sequence[str]) -> list[str]:
    """Dummies of a fixed vocabulary in fixed order; a word no row has is NULL throughout."""
    known = ", ".join(quoted(w) for w in words)
    seen = df.where(f"{column} IS NOT NULL").selectExpr(f"explode({tokens_sql(column)}) AS w").where(f"w IN ({known})").agg(
        F.collect_set("w").alias("seen")).collect()[0]["seen"]  # at most len(words) entries
    return list_dummies_sql(column, [w for w in words if w in seen]) if len(seen) == len(words) else [
        list_dummies_sql(column, [w])[0] if w in seen else f"CAST(NULL AS INT) AS `{column}_{w}`" for w in words]


def onehot_sql(column: str, values: Sequence[str], prefix: str | None = None) -> list[str]:
    """One 0/1 column per value of a single-valued column, one for values that fold to one name; NULL gives all zeros."""
    p = prefix or column
    return [f"CAST(coalesce(lower({column}) IN ({', '.join(quoted(v.lower()) for v in vs)}), false) AS INT) AS `{p}_{name}`"
            for name, vs in by_plain_name(values).items()]


def pair_sums_sql(column: str, keys: Sequence[str]) -> list[str]:
    """Sum of the numbers listed for each key; NULL where the key is absent. Needs the parsed pairs."""
    suffix = column.rsplit("_", 1)[-1]
    return [
        f"aggregate(__pairs_{column}, CAST(NULL AS DOUBLE), (a, p) -> CASE WHEN p.k = {quoted(k)} AND p.number IS NOT NULL "
        f"THEN coalesce(a, 0D) + p.number ELSE a END) AS `{column}_{k}_{suffix}`" for k in keys
    ]


def pair_dates_sql(column: str, keys: Sequence[str], occurrences: int, last: bool = False) -> list[str]:
    """Values of each key in rising order, one column per occurrence; or only the last one listed."""
    suffix = column.rsplit("_", 1)[-1]
    out = []
    for k in keys:
        values = f"transform(filter(__pairs_{column}, p -> p.k = {quoted(k)}), p -> try_cast(p.v AS BIGINT))"
        if last:
            out.append(f"try_element_at({values}, -1) AS `{column}_{k}_{suffix}`")
        else:
            out += [f"get(sort_array({values}), {i}) AS `{column}_{k}_{i}_{suffix}`" for i in range(occurrences)]
    return out


def pairwise_durations(df: DataFrame, dates: Sequence[str]) -> list[str]:
    """Days (or numbers) between every two columns; zero counts as missing."""
    types = dict(df.dtypes)

    def value(c: str) -> str:
        return f"unix_date({c})" if types[c] == "date" else f"nullif({c}, 0)"

    return [f"{value(x)} - {value(y)} AS {y}_to_{x}_duration" for x, y in combinations(dates, 2)]


def fit_pairs(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """For each pair column its keys, in name order, and the most often each occurs in one row.

    One pass for all columns; what reaches the driver is one row per column to be made.
    """
    if not columns:
        return {}
    entries = ", ".join(f"named_struct('c', {quoted(c)}, 'ks', transform(__pairs_{c}, p -> p.k))" for c in columns)
    keys = with_parsed(df.select(*columns), pairs=columns).selectExpr(f"inline(array({entries}))").where("size(ks) > 0")
    once = keys.selectExpr("c", "ks", "explode(array_distinct(ks)) AS k")
    most = once.selectExpr("c", "k", "size(ks) - size(array_remove(ks, k)) AS n").groupBy("c", "k").agg(F.max("n").alias("n"))
    found: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in most.orderBy("c", "k").collect():
        found[r["c"]][r["k"]] = r["n"]
    return found


def clean_features(df: DataFrame, pair_keys: dict[str, Sequence[str]] | None = None, top_n: int = TOP_N) -> DataFrame:
    """Clean every column by its suffix, in one pass over the rows. Columns without a known suffix are dropped.

    Vocabularies of list columns are fitted first (bounded by ``top_n`` or the fixed word lists), and so
    are the keys of pair columns with their number of occurrences. ``pair_keys`` names keys that get
    columns even where no row has them; keys that only the data have follow in name order.
    """
    pair_keys = pair_keys or {}
    fitted = fit_pairs(df, [c for c in df.columns if cleaning_of(c) in ("pair_sum", "pair_dates")])
    out: list[str] = []
    for column in df.columns:
        kind = cleaning_of(column)
        if kind == "keep":
            out.append(column)
        elif kind == "number":
            out.append(f"try_cast({column} AS DOUBLE) AS {column}")
        elif kind == "types":
            out += fixed_dummies_sql(df, column, ROUND_TYPES)
        elif kind == "codes":
            out += fixed_dummies_sql(df, column, ROUND_CODES)
        elif kind == "top_list":
            out += top_dummies_sql(column, fit_vocabulary(df, column, top_n))
        elif kind in ("pair_sum", "pair_dates"):
            counts = {**dict.fromkeys(pair_keys.get(column, ()), 1), **fitted[column]}
            out += (pair_sums_sql(column, list(counts)) if kind == "pair_sum"
                    else [c for k, n in counts.items() for c in pair_dates_sql(column, [k], n)])
    kinds = {c: cleaning_of(c) for c in df.columns}
    parsed = with_parsed(df, [c for c, k in kinds.items() if k in ("types", "codes", "top_list")],
                         [c for c, k in kinds.items() if k in ("pair_sum", "pair_dates")])
    return parsed.selectExpr(*out)


def feature_matrix(df: DataFrame) -> DataFrame:
    """Numeric feature columns in name order; a column that is NULL throughout becomes 0."""
    names = feature_names(df.schema)
    counts = df.selectExpr(*names).agg(F.expr(
        "struct(" + ", ".join(f"count({n}) AS {n}" for n in names) + ") AS c")).scalar()
    return df.withColumn("__n", counts).selectExpr(
        *[f"CASE WHEN __n.{n} = 0 THEN 0D ELSE CAST({n} AS DOUBLE) END AS {n}" for n in names])


def keys_and_outcomes(df: DataFrame) -> DataFrame:
    """The columns kept beside the feature matrix: names starting with ``key`` or ``outcome``."""
    return df.select(*[c for c in df.columns if c.startswith(("key", "outcome"))])


def missing_count_sql(columns: Sequence[str], out: str = "missing") -> str:
    return " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns) + f" AS {out}"


def equal_width_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts per equal-width bin between minimum and maximum; bins are open below, the first closed.

    A constant column is cut over a thousandth of its value (0.001 at zero) on either side.
    """
    wider = f"if(min({column}) = max({column}), if(max({column}) = 0, 0.001D, 0.001D * abs(max({column}))), 0D)"
    ends = df.agg(F.expr(f"struct(CAST(min({column}) AS DOUBLE) - {wider} AS lo, CAST(max({column}) AS DOUBLE) + {wider} AS hi)")).scalar()
    index = f"greatest(1, least({bins}, CAST(ceil(({column} - r.lo) / ((r.hi - r.lo) / {bins})) AS INT)))"
    return (
        df.where(f"{column} IS NOT NULL").withColumn("r", ends).selectExpr(f"{index} AS bin", "r")
        .groupBy("bin").agg(F.count("*").alias("n"), F.first("r").alias("r"))
        .selectExpr("bin", f"r.lo + (bin - 1) * (r.hi - r.lo) / {bins} AS bin_from", f"r.lo + bin * (r.hi - r.lo) / {bins} AS bin_to", "n")
    )


def fraction_rows(df: DataFrame, bucket: str, fractions: Sequence[float], scale: int = 1000) -> DataFrame:
    """Nested samples of growing size. ``bucket`` is SQL for a number in 0 … ``scale`` - 1.

    A row is in a sample when its bucket is below the fraction, so small samples are part of larger ones.
    """
    fr = ", ".join(f"{f}D" for f in fractions)
    return df.selectExpr("*", f"explode(filter(array({fr}), f -> {bucket} < f * {scale})) AS fraction")


def fixed_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` random rows (all when there are fewer)."""
    return df.orderBy(F.rand(seed)).limit(n)
