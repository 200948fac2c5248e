"""URL filter lists: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by digests.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#``
or the end. A NULL url, or one without ``://``, has an empty host and path and fits no rule. A rule's path ends with
``/``; it fits its host and all subdomains where the url's path starts with its path. The longest fitting rule wins,
of two equally long ones the one with the longer host. Where no rule fits, the verdict is ``default``.

Repeated rows stay. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = 8               # hex digits of the digest prefix that is joined on
LIST_BYTES = 32_000_000  # a rule list up to this size is broadcast, a larger one is shuffled


def split_url(url: str) -> tuple[F.Column, F.Column]:
    """(host, path) columns of the url column named ``url``."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict. ``rules``: host, path, verdict (one row per rule)."""
    rules = rules.select("host", "path", "verdict", F.concat("host", "path").alias("rule"))
    # Deeper expressions than the deepest rule cannot fit.
    limits = rules.agg(
        F.count("*").alias("n"), F.sum(F.length("rule") + 200).alias("bytes"), F.max(F.size(F.split("host", "\\."))).alias("labels"),
        F.max(F.size(F.split("path", "/")) - 1).alias("depth"), F.bool_and(F.col("path").endswith("/")).alias("fine")).first()
    if limits["fine"] is False:
        raise ValueError("a rule's path ends with /")
    listed = rules.select(F.sha2("rule", 256).alias("digest"), "rule", F.col("host").alias("rulehost"), F.col("verdict").alias("says")).withColumn("short", F.substring("digest", 1, PREFIX))
    if (limits["bytes"] or 0) <= LIST_BYTES:
        listed = F.broadcast(listed)

    # Equal rows are judged once.
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).groupBy("key", "url").agg(F.count("*").alias("copies"))
    host, path = split_url("url")
    rows = rows.withColumns({"host": host, "path": path})
    hosts = F.expr(f"transform(sequence(1, least({limits['labels'] or 1}, size(split(host, '[.]')))), k -> substring_index(host, '.', -k))")
    paths = F.expr(
        f"transform(filter(sequence(1, {limits['depth'] or 1}), k -> k < size(split(path, '/'))), k -> concat(substring_index(path, '/', k), '/'))")
    expressions = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))
    asked = rows.select("*", F.explode_outer(expressions).alias("expression")).withColumn("asked", F.sha2("expression", 256))
    found = asked.join(listed, F.substring("asked", 1, PREFIX) == F.col("short"), "left")
    best = found.groupBy("key", "url").agg(
        F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max_by(F.struct("rule", "says"), F.when(F.col("asked") == F.col("digest"), F.struct(
            F.length("rule").alias("long"), F.length("rulehost").alias("host"))).alias("rank")).alias("best"))
    return best.select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def fixed_rules(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) tuples as a table, without Python rows in the plan."""
    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")
