"""Logical relations over the given tables, as DataFrames and as the same view in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The reference dates of the checks: features as of the first, outcomes as of the second
# (two windows of 364 days later).
FEATURE_DATE = date(1996, 6, 1)
LABEL_DATE = date(1998, 5, 30)
YEARLY_SLICES = tuple(date(1996 + i, 4, 1) for i in range(5))


def day_offset(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


class Tables:
    """Lazily opened tables of one directory, and the logical relations built on them."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.directory}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def orgs(self) -> DataFrame:
        c = self.table("customer")
        key = F.col("c_custkey")
        bal = F.col("c_acctbal")
        return c.select(
            key.alias("org_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("country"),
            bal.alias("balance"),
            day_offset("1990-01-01", key * 13 % 3000).alias("created_at"),
            day_offset("1990-01-01", key % 1826).alias("founded_on"),
            F.when(bal < -800, "closed").when(bal > 9700, "ipo").when(bal > 9300, "acquired")
            .otherwise("operating").alias("status"),
            day_offset("1996-01-01", key * 7 % 2000).alias("status_on"),
        )

    def rounds(self) -> DataFrame:
        key = F.col("o_orderkey")
        pct = key % 100
        return self.table("orders").select(
            key.alias("round_id"),
            F.col("o_custkey").alias("org_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when(key % 7 != 0, F.col("o_totalprice")).alias("raised_usd"),
            F.col("o_orderpriority").alias("type"),
            F.when(pct < 50, None).when(pct < 75, "a").when(pct < 88, "b").when(pct < 95, "c")
            .when(pct < 98, "d").otherwise("e").alias("code"),
        )

    def investors(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("investor_id"), F.col("s_name").alias("investor_name"),
            F.col("s_nationkey").alias("country"), F.col("s_acctbal").alias("balance"),
        )

    def deals(self) -> DataFrame:
        """Line items with the organisation of their order: the source of jobs and patents."""
        li = self.table("lineitem").select(
            F.col("l_orderkey").alias("round_id"), "l_suppkey", "l_returnflag", "l_shipdate")
        links = self.rounds().select("round_id", "org_id")
        return li.join(links, "round_id")

    def patents(self) -> DataFrame:
        """Returned line items stand for patents; dated by ``patent_date`` only."""
        return self.deals().where(F.col("l_returnflag") == "R").select(
            "org_id", F.col("l_shipdate").alias("patent_date"))

    def jobs(self) -> DataFrame:
        """Suppliers stand for people working for the ordering organisation."""
        return self.deals().select(
            F.col("l_suppkey").alias("person_id"), "org_id", F.col("l_shipdate").alias("started_on"))


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "orgs": ((), """
        SELECT c_custkey AS org_id, c_name AS name, c_mktsegment AS segment, c_nationkey AS country,
               c_acctbal AS balance,
               DATE '1990-01-01' + CAST(c_custkey * 13 % 3000 AS INTEGER) AS created_at,
               DATE '1990-01-01' + CAST(c_custkey % 1826 AS INTEGER) AS founded_on,
               CASE WHEN c_acctbal < -800 THEN 'closed' WHEN c_acctbal > 9700 THEN 'ipo'
                    WHEN c_acctbal > 9300 THEN 'acquired' ELSE 'operating' END AS status,
               DATE '1996-01-01' + CAST(c_custkey * 7 % 2000 AS INTEGER) AS status_on
        FROM customer"""),
    "rounds": ((), """
        SELECT o_orderkey AS round_id, o_custkey AS org_id, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS raised_usd,
               o_orderpriority AS type,
               CASE WHEN o_orderkey % 100 < 50 THEN NULL WHEN o_orderkey % 100 < 75 THEN 'a'
                    WHEN o_orderkey % 100 < 88 THEN 'b' WHEN o_orderkey % 100 < 95 THEN 'c'
                    WHEN o_orderkey % 100 < 98 THEN 'd' ELSE 'e' END AS code
        FROM orders"""),
    "investments": ((), """
        SELECT l_orderkey AS round_id, l_suppkey AS investor_id, max(l_linenumber = 1) AS is_lead
        FROM lineitem GROUP BY 1, 2"""),
    "investors": ((), """
        SELECT s_suppkey AS investor_id, s_name AS investor_name, s_nationkey AS country,
               s_acctbal AS balance FROM supplier"""),
    "deals": (("rounds",), """
        SELECT l_orderkey AS round_id, l_suppkey, l_returnflag, l_shipdate, r.org_id
        FROM lineitem JOIN rounds r ON r.round_id = l_orderkey"""),
    "patents": (("deals",), """
        SELECT org_id, l_shipdate AS patent_date FROM deals WHERE l_returnflag = 'R'"""),
    "jobs": (("deals",), """
        SELECT l_suppkey AS person_id, org_id, l_shipdate AS started_on FROM deals"""),
}


def define_view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    _VIEWS[name] = (needs, sql)


def with_views(names: str, body: str) -> str:
    """Put the named views (and what they need) as common table expressions before ``body``.

    ``body`` may start with its own ``WITH``.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for n in names.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
