"""Intermediate tables, joins by measured size, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

BROADCAST_BYTES = 32_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: later reads need no recomputation and outlive lost executors."""
    return materialize(df, name)


def sized(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """Marks a written table for a broadcast if its counted rows fit ``BROADCAST_BYTES``; else joins shuffle it."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that occurs in the links (a, b): the smallest id of its component.

    Large-star and small-star steps in turn until nothing changes; each step is a minimum per id and a join, so a
    node with very many links is never gathered. Links with a NULL end are left out.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u > v").distinct(), "links")
    seen = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
