"""Joins, set operations and entity links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize
from tidemark.functions.text import first_token, normalized_levenshtein, standardize_name


def merge_slices(features: DataFrame, labels: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Feature rows with their outcome rows; entities without an outcome stay, with NULLs."""
    return features.join(labels, key, how)


def stale_or_missing(
    candidates: DataFrame, stored: DataFrame, key: str, updated: str, stored_key: str, stored_epoch: str
) -> DataFrame:
    """Candidates that are absent from ``stored`` or newer there.

    Candidate ids carry dashes and text timestamps, stored ids none and Unix seconds.
    """
    known = stored.select(F.col(stored_key).alias("__id"), F.timestamp_seconds(stored_epoch).alias("__at"))
    bare = F.replace(F.col(key), F.lit("-"), F.lit(""))
    newer = F.col("__at").isNull() | (F.to_timestamp(updated) > F.col("__at"))
    return candidates.join(known, bare == F.col("__id"), "left").where(newer).drop("__id", "__at")


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that are not recorded as done."""
    return candidates.join(done.select(key), key, "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest row per key. An aggregate, not a window: a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*newest))
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, "__row.*")


def drop_repeats(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def append_evolving(frames: Sequence[DataFrame]) -> DataFrame:
    """Append frames with differing columns: new columns widen the result, missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def to_common_schema(df: DataFrame, mapping: Mapping[str, Column]) -> DataFrame:
    """One vintage of the data under the common column names."""
    return df.select(*[c.alias(name) for name, c in mapping.items()])


def merge_vintages(
    early: DataFrame, early_mapping: Mapping[str, Column], late: DataFrame, late_mapping: Mapping[str, Column], key: str
) -> DataFrame:
    """Features of one database vintage with the outcomes of a later one."""
    return merge_slices(to_common_schema(early, early_mapping), to_common_schema(late, late_mapping), key)


def similarity_score(name: Column, other: Column) -> Column:
    """Points for likeness of two standardised names; more than one point means the same entity."""
    full = normalized_levenshtein(name, other)
    to_first = normalized_levenshtein(name, first_token(other))
    from_first = normalized_levenshtein(first_token(name), other)
    near = [(d < 0.2).cast("int") for d in (full, to_first, from_first)]
    exact = [(d == 0).cast("int") * 2 for d in (to_first, from_first)]
    return reduce(lambda a, b: a + b, near + exact)


def names_similar(name: Column, other: Column) -> Column:
    return F.coalesce(similarity_score(name, other) > 1, F.lit(False))


def fuzzy_match(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Pairs of distinct standardised names that share their first word and pass ``names_similar``.

    Names are standardised once per distinct spelling, not once per row.

    Two names ``w …`` of one block can only pass when at least one of them is ``w`` itself or barely
    longer (``w`` makes up over four fifths of it): all points but that of the full names depend on
    it. So only such *core* names are joined with the block, in either direction, which leaves a
    frequent first word linear in the number of its names. Blocks still too large for one task are
    split by the skew-join rule, as these are plain equi-joins.
    """
    def prepared(df: DataFrame, name: str, tag: str) -> DataFrame:
        n = F.col(name)
        block = first_token(n)
        core = F.length(block) >= 0.8 * F.length(n)  # holds for names that standardise to nothing, too
        spellings = df.select(name).where(n.isNotNull()).distinct()
        # Written out, or the filters on the block would move below ``distinct`` and run per row.
        names = materialize(spellings.select(standardize_name(n).alias(name)).distinct(), "names")
        return names.select(n.alias(name), block.alias("__block"), core.alias(f"__core_{tag}"))

    a, b = prepared(left, left_name, "a"), prepared(right, right_name, "b")
    similar = names_similar(F.col(left_name), F.col(right_name))
    from_core = a.where("__core_a").join(b, "__block").where(similar)
    to_core = a.where("NOT __core_a").join(b.where("__core_b"), "__block").where(similar)
    return from_core.unionByName(to_core).select(left_name, right_name)


def two_hop_average(links: DataFrame, person: str, org: str, out: str) -> DataFrame:
    """Per organisation: mean over its people of the number of organisations each is linked to."""
    pairs = links.select(person, org).distinct()
    reach = pairs.groupBy(person).agg(F.count("*").alias("__n"))
    return pairs.join(reach, person).groupBy(org).agg(F.avg("__n").alias(out), F.count("*").alias("people"))


def parent_links(df: DataFrame, key: str, parent: Column, columns: Sequence[str]) -> DataFrame:
    """Each row with chosen columns of its parent; roots and dangling parents are left out."""
    up = df.select(F.col(key).alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return df.withColumn("parent_id", parent).where(F.col("parent_id") != F.col(key)).join(up, "parent_id")
