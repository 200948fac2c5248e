"""Queries: joins, set operations, entity links, fuzzy names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import relate as R
from tidemark.operators.flatten import Measure, Relation, aggregate_at, flatten_entities
from tidemark.operators.slicing import slice_asof
from tidemark.plans import base as B
from tidemark.plans.registry import query
from tidemark.sources.bindings import FEATURE_DATE, LABEL_DATE, with_views

D = f"DATE '{FEATURE_DATE}'"


@query("flatten_entities", with_views("orgs rounds patents jobs", f"""
    WITH r AS (SELECT org_id, count(*) AS rounds, round(sum(raised_usd), 2) AS raised, round(avg(raised_usd), 4) AS raised_mean,
                      min(raised_usd) AS raised_min, max(raised_usd) AS raised_max,
                      count(*) FILTER (WHERE type = '1-URGENT') AS urgent_rounds
               FROM rounds WHERE created_at < {D} GROUP BY 1),
    p AS (SELECT org_id, count(*) AS patents FROM patents WHERE patent_date < {D} GROUP BY 1),
    j AS (SELECT org_id, count(*) AS staff FROM jobs WHERE started_on < {D} GROUP BY 1)
    SELECT o.org_id, coalesce(rounds, 0) AS rounds, raised, raised_mean, raised_min, raised_max, urgent_rounds,
           coalesce(patents, 0) AS patents, coalesce(staff, 0) AS staff
    FROM orgs o LEFT JOIN r USING (org_id) LEFT JOIN p USING (org_id) LEFT JOIN j USING (org_id)
    WHERE o.created_at < {D}"""))
def flatten_query(t):
    usd = "raised_usd"
    rounds = Relation(t.rounds(), "org_id", "created_at", {
        "rounds": Measure("count"), "raised": Measure("sum", usd), "raised_mean": Measure("avg", usd),
        "raised_min": Measure("min", usd), "raised_max": Measure("max", usd),
        "urgent_rounds": Measure("count", "type = '1-URGENT'")}, ("rounds",))
    spine = slice_asof(t.orgs(), FEATURE_DATE).select("org_id")
    wide = flatten_entities(spine, "org_id", [rounds, B.deal_relation(t)], {"": FEATURE_DATE})
    return wide.withColumns({"raised": F.round("raised", 2), "raised_mean": F.round("raised_mean", 4)})


@query("forecast_merge", with_views("orgs rounds", f"""
    WITH f AS (SELECT org_id, count(*) AS rounds, round(sum(raised_usd), 2) AS raised FROM rounds WHERE created_at < {D} GROUP BY 1),
    l AS (SELECT org_id, count(*) AS outcome_rounds, round(sum(raised_usd), 2) AS outcome_raised
          FROM rounds WHERE created_at < DATE '{LABEL_DATE}' GROUP BY 1)
    SELECT * FROM f LEFT JOIN l USING (org_id)"""))
def forecast_merge(t):
    def side(when, prefix):
        rel = Relation(t.rounds(), "org_id", "created_at",
                       {"rounds": Measure("count"), "raised": Measure("sum", "raised_usd")})
        agg = aggregate_at(rel, {prefix: when}).withColumnRenamed("__entity", "org_id")
        return agg.withColumn(f"{prefix}raised", F.round(f"{prefix}raised", 2))

    return R.merge_slices(side(FEATURE_DATE, ""), side(LABEL_DATE, "outcome_"), "org_id")


@query("natural_join", """
    SELECT n.n_nationkey, n.n_name, r.r_regionkey, r.r_name, count(c.c_custkey) AS customers
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
    GROUP BY ALL""")
def natural_join(t):
    regions = t.region.withColumn("n_regionkey", F.col("r_regionkey"))
    places = t.nation.join(regions, "n_regionkey")
    per_nation = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("customers"))
    return places.join(per_nation, "n_nationkey", "left").select(
        "n_nationkey", "n_name", "r_regionkey", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("stale_or_missing", """
    WITH a AS (SELECT lpad(CAST(o_orderkey // 10000 AS VARCHAR), 8, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS uuid,
                      o_orderdate AS updated_at FROM orders),
    b AS (SELECT lpad(CAST(l_orderkey // 10000 AS VARCHAR), 8, '0') || lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0') AS uuid,
                 max(l_shipdate) AS at FROM lineitem GROUP BY 1)
    SELECT a.uuid FROM a LEFT JOIN b ON replace(a.uuid, '-', '') = b.uuid WHERE a.updated_at > b.at OR b.at IS NULL""")
def stale_or_missing(t):
    def parts(key):
        return (F.lpad(F.floor(F.col(key) / 10000).cast("string"), 8, "0"), F.lpad((F.col(key) % 10000).cast("string"), 4, "0"))

    head, tail = parts("o_orderkey")
    candidates = t.orders.select(
        F.concat(head, F.lit("-"), tail).alias("uuid"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
    head, tail = parts("l_orderkey")
    stored = t.lineitem.groupBy(F.concat(head, tail).alias("id")).agg(
        F.unix_timestamp(F.max("l_shipdate").cast("timestamp")).alias("epoch"))
    return R.stale_or_missing(candidates, stored, "uuid", "updated_at", "id", "epoch").select("uuid")


@query("incremental_pending", """
    SELECT c_custkey AS org_id, c_name AS name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')""")
def incremental_pending(t):
    done = t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).select(
        F.col("o_custkey").alias("org_id"))
    return R.pending(t.orgs().select("org_id", "name"), done, "org_id")


@query("semi_join", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9300)""")
def semi_join(t):
    chosen = t.customer.where("c_acctbal > 9300").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")




@query("fuzzy_match", """
    WITH db AS (SELECT DISTINCT regexp_replace(lower(s_name), '[[:punct:]]', '', 'g')
                       || CASE WHEN s_suppkey % 3 = 0 THEN ' x' WHEN s_suppkey % 3 = 1 THEN ' holding group' ELSE '' END AS db_name
                FROM supplier),
    other AS (SELECT DISTINCT regexp_replace(lower('Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')), '[[:punct:]]', '', 'g')
                     || CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 = 1 THEN ' y'
                             WHEN l_partkey % 4 = 2 THEN ' holding groups' ELSE ' ' || lower(l_returnflag) || ' division' END AS other_name
              FROM lineitem),
    d AS (SELECT db_name, other_name, split_part(db_name, ' ', 1) AS db1, split_part(other_name, ' ', 1) AS other1
          FROM db JOIN other ON split_part(db_name, ' ', 1) = split_part(other_name, ' ', 1)),
    x AS (SELECT *, levenshtein(db_name, other_name) / greatest(length(db_name), length(other_name)) AS d1,
                 levenshtein(db_name, other1) / greatest(length(db_name), length(other1)) AS d2,
                 levenshtein(db1, other_name) / greatest(length(db1), length(other_name)) AS d3 FROM d)
    SELECT db_name, other_name FROM x
    WHERE (d1 < 0.2)::INT + (d2 < 0.2)::INT + (d3 < 0.2)::INT + 2 * (d2 = 0)::INT + 2 * (d3 = 0)::INT > 1""")
def fuzzy_match(t):
    k = F.col("s_suppkey") % 3
    left = t.supplier.select(F.concat(
        "s_name", F.when(k == 0, " X Inc.").when(k == 1, " Holding Group, LLC").otherwise(" Ltd")).alias("db_name"))
    p = F.col("l_partkey") % 4
    right = t.lineitem.select(F.concat(
        F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"),
        F.when(p == 0, " Corp").when(p == 1, " Y GmbH").when(p == 2, " Holding Groups")
        .otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" Division")))).alias("other_name"))
    return R.fuzzy_match(left, right, "db_name", "other_name")


@query("dedup_latest", """
    SELECT user_id, event_id, ts, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def dedup_latest(t):
    rows = t.events.select("user_id", "event_id", "ts", "event_type", "value")
    return R.latest_per_key(rows, ["user_id"], ["ts", "event_id"])


@query("set_difference", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def set_difference(t):
    return t.customer.select(F.col("c_custkey").alias("key")).subtract(
        t.orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")))


@query("set_intersection", "SELECT p_partkey AS key FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersection(t):
    return t.part.select(F.col("p_partkey").alias("key")).intersect(
        t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("key")))


@query("investor_reputation", with_views("orgs rounds investments", f"""
    WITH backed AS (SELECT DISTINCT i.investor_id, r.org_id FROM investments i JOIN rounds r USING (round_id) WHERE r.created_at < {D}),
    record AS (SELECT investor_id, count(*) FILTER (WHERE o.status IN ('ipo', 'acquired') AND o.status_on < {D}) AS exits,
                      count(*) AS companies FROM backed JOIN orgs o USING (org_id) GROUP BY 1)
    SELECT org_id, max(exits) AS investor_exits_max, round(avg(companies), 6) AS investor_companies_mean, count(*) AS investors
    FROM backed JOIN record USING (investor_id) GROUP BY 1"""))
def investor_reputation(t):
    """Everything, the investors' record included, is restricted to rounds before the slice date."""
    rounds = slice_asof(t.rounds(), FEATURE_DATE).select("round_id", "org_id")
    # Line items repeat an investor of a round; one distinct over (investor, organisation) removes both kinds of repeats.
    links = t.lineitem.selectExpr("l_orderkey AS round_id", "l_suppkey AS investor_id")
    exits = t.orgs().selectExpr("org_id", f"status IN ('ipo', 'acquired') AND status_on < {D} AS exited")
    # The exit flag is joined before the pairs are used twice, so that both uses share their shuffles.
    backed = links.join(rounds, "round_id").select("investor_id", "org_id").distinct().join(exits, "org_id")
    record = backed.groupBy("investor_id").agg(F.count_if("exited").alias("exits"), F.count("*").alias("companies"))
    return backed.join(record, "investor_id").groupBy("org_id").agg(
        F.max("exits").alias("investor_exits_max"), F.round(F.avg("companies"), 6).alias("investor_companies_mean"),
        F.count("*").alias("investors"))


@query("team_experience", with_views("jobs", f"""
    WITH links AS (SELECT DISTINCT person_id, org_id FROM jobs WHERE started_on < {D}),
    reach AS (SELECT person_id, count(*) AS n FROM links GROUP BY 1)
    SELECT org_id, round(avg(n), 6) AS team_companies_mean, count(*) AS people FROM links JOIN reach USING (person_id) GROUP BY 1"""))
def team_experience(t):
    links = slice_asof(t.jobs(), FEATURE_DATE)
    return R.two_hop_average(links, "person_id", "org_id", "team_companies_mean").withColumn(
        "team_companies_mean", F.round("team_companies_mean", 6))


@query("parent_link", """
    SELECT c.c_custkey AS org_id, c.c_name AS name, p.c_custkey AS parent_id, p.c_name AS parent_name
    FROM customer c JOIN customer p ON p.c_custkey = c.c_custkey // 10 WHERE p.c_custkey <> c.c_custkey""")
def parent_link(t):
    orgs = t.orgs().select("org_id", "name")
    return R.parent_links(orgs, "org_id", F.floor(F.col("org_id") / 10), ["name"]).select(
        "org_id", "name", "parent_id", "parent_name")


@query("vintage_merge", f"""
    WITH early AS (SELECT o_custkey AS org_id, count(*) AS rounds, round(sum(o_totalprice), 2) AS raised
                   FROM orders WHERE o_orderdate < {D} GROUP BY 1),
    late AS (SELECT c_custkey AS org_id, c_acctbal AS outcome_balance, count(o_orderkey) AS outcome_rounds,
                    round(sum(o_totalprice), 2) AS outcome_raised
             FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT * FROM early LEFT JOIN late USING (org_id)""")
def vintage_merge(t):
    early = t.orders.where(F.col("o_orderdate") < F.lit(str(FEATURE_DATE)).cast("timestamp_ntz")).groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("usd"))
    per_org = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("deals"), F.sum("o_totalprice").alias("total"))
    late = t.customer.join(per_org, F.col("c_custkey") == F.col("k"), "left")
    return R.merge_vintages(
        early, {"org_id": F.col("o_custkey"), "rounds": F.col("n"), "raised": F.round("usd", 2)},
        late, {"org_id": F.col("c_custkey"), "outcome_balance": F.col("c_acctbal"),
               "outcome_rounds": F.coalesce("deals", F.lit(0)), "outcome_raised": F.round("total", 2)}, "org_id")
