"""Queries: sources, sinks, nested documents, schema evolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import ingest as N
from tidemark.operators.relate import append_evolving
from tidemark.plans.registry import query
from tidemark.session import materialize, scratch_dir
from tidemark.sources import files as S


@query("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(t):
    orders = t.orders
    path = scratch_dir(t.spark, "csv")
    S.write_csv(orders, path)
    return S.read_csv(t.spark, path, orders.schema, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("read_limit", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def read_limit(t):
    return S.read_limited(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 100)


@query("json_props", """
    SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max
    FROM events GROUP BY 1""")
def json_props(t):
    k = F.from_json("props", "k BIGINT").getField("k")
    return t.events.groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


# Shape of the part documents and where their fields go.
_DOCUMENT = ("struct<uuid:bigint,type:string,properties:struct<name:string,price:double,size:int>,"
             "relationships:struct<categories:struct<items:array<struct<properties:struct<name:string>>>>,"
             "owned_by:struct<item:struct<properties:struct<brand:string>>>>>")
_MAPPING = {
    "properties.name": "products.name",
    "properties": {"price": ["products.price", "offers.price"], "size": "products.size"},
    "relationships": {
        "categories.items": {"properties.name": "categories.name", True: "categories.is_listed"},
        "owned_by.item": {"properties": {"brand": "owners.brand"}, True: "owners.is_brand"},
    },
}
_KEYS = {"uuid": ["products.uuid", "offers.product_uuid", "categories.product_uuid", "owners.product_uuid"]}


def product_documents(t):
    """Parts as JSON texts with a list and a single related item, read back by a fixed schema."""
    text = t.part.selectExpr("""to_json(named_struct(
        'uuid', p_partkey, 'type', 'product',
        'properties', named_struct('name', p_name, 'price', p_retailprice, 'size', p_size),
        'relationships', named_struct(
            'categories', named_struct('items', transform(split(p_name, ' '), w -> named_struct('properties', named_struct('name', w)))),
            'owned_by', named_struct('item', named_struct('properties', named_struct('brand', CASE WHEN p_size % 4 <> 0 THEN p_brand END)))))) AS body""")
    return text.select(F.from_json("body", _DOCUMENT).alias("doc"))


@query("doc_normalize", """
    SELECT 'products' AS relation, CAST(p_partkey AS VARCHAR) AS product_uuid, p_name AS name, CAST(p_size AS VARCHAR) AS detail, NULL AS flag FROM part
    UNION ALL SELECT 'categories', CAST(p_partkey AS VARCHAR), unnest(string_split(p_name, ' ')), NULL, 'true' FROM part
    UNION ALL SELECT 'offers', CAST(p_partkey AS VARCHAR), NULL, 'priced', NULL FROM part
    UNION ALL SELECT 'owners', CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 4 <> 0 THEN p_brand END, NULL, 'true' FROM part""")
def doc_normalize(t):
    r = N.normalize_documents(product_documents(t), "doc", _MAPPING, _KEYS)
    empty = "CAST(NULL AS STRING)"
    return append_evolving([
        r["products"].selectExpr("'products' AS relation", "uuid AS product_uuid", "name", "size AS detail", f"{empty} AS flag"),
        r["categories"].selectExpr("'categories' AS relation", "product_uuid", "name", f"{empty} AS detail", "is_listed AS flag"),
        r["offers"].where("price IS NOT NULL").selectExpr("'offers' AS relation", "product_uuid", f"{empty} AS name", "'priced' AS detail", f"{empty} AS flag"),
        r["owners"].selectExpr("'owners' AS relation", "product_uuid", "brand AS name", f"{empty} AS detail", "is_brand AS flag")])


# Orders with their lines as one document; the paths cross the list of lines.
_ORDER = ("struct<uuid:bigint,properties:struct<status:string,total:double,placed_on:timestamp_ntz>,"
          "lines:array<struct<number:int,item:struct<part:bigint,price:double,flags:array<string>>>>>")
_ORDER_MAPPING = {
    "properties": {"status": "orders.status", "total": ["orders.total", "prices.price"], "placed_on": "orders.placed_on"},
    "lines.number": "lines.number", "lines.item.part": "lines.part", "lines.item.price": ["lines.price", "prices.price"],
    "lines.item.flags": "flags.flag",
}
_ORDER_KEYS = {"uuid": ["orders.order_id", "lines.order_id", "prices.order_id", "flags.order_id"]}


def order_documents(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.expr("""collect_list(named_struct('number', l_linenumber, 'item', named_struct(
        'part', l_partkey, 'price', l_extendedprice, 'flags', array(l_returnflag, l_linestatus))))""").alias("lines"))
    text = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("""to_json(named_struct('uuid', o_orderkey,
        'properties', named_struct('status', o_orderstatus, 'total', o_totalprice, 'placed_on', o_orderdate), 'lines', lines)) AS body""")
    return text.select(F.from_json("body", _ORDER).alias("doc"))


@query("doc_normalize_typed", """
    WITH o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
    SELECT 'orders' AS relation, o_orderkey AS order_id, o_totalprice AS price, NULL::BIGINT AS part, NULL::INTEGER AS number, o_orderstatus AS status, o_orderdate::TIMESTAMP AS placed_on FROM o
    UNION ALL SELECT 'lines', l_orderkey, l_extendedprice, l_partkey, l_linenumber, NULL, NULL FROM l
    UNION ALL SELECT 'prices', o_orderkey, o_totalprice, NULL, NULL, NULL, NULL FROM o
    UNION ALL SELECT 'prices', l_orderkey, l_extendedprice, NULL, NULL, NULL, NULL FROM l
    UNION ALL SELECT 'flags', l_orderkey, NULL, NULL, NULL, unnest([l_returnflag, l_linestatus]), NULL FROM l""")
def doc_normalize_typed(t):
    documents = materialize(order_documents(t), "documents")  # each relation reads them again
    r = N.normalize_documents(documents, "doc", _ORDER_MAPPING, _ORDER_KEYS, typed=True)
    r |= {"orders": r["orders"].withColumnRenamed("total", "price"), "flags": r["flags"].withColumnRenamed("flag", "status")}
    return append_evolving([r[name].withColumn("relation", F.lit(name)) for name in ("orders", "lines", "prices", "flags")])


@query("props_unpack", "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def props_unpack(t):
    return N.unpack_properties(t.events, ["event_id"], "props")


_SPARSE = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (
    SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN l_partkey END AS l_partkey,
           CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS l_suppkey, CASE WHEN l_quantity < 25 THEN l_returnflag END AS l_returnflag FROM lineitem)"""


@query("drop_sparse_records", _SPARSE + """ WHERE CAST(l_partkey IS NOT NULL AS INTEGER) + CAST(l_suppkey IS NOT NULL AS INTEGER)
    + CAST(l_returnflag IS NOT NULL AS INTEGER) + 2 >= 4""")
def drop_sparse_records(t):
    rows = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 2 = 0 THEN l_partkey END AS l_partkey",
        "CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS l_suppkey", "CASE WHEN l_quantity < 25 THEN l_returnflag END AS l_returnflag")
    return N.drop_sparse(rows, 4)


@query("union_evolve", """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def union_evolve(t):
    return append_evolving([
        t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"),
        t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")])


@query("record_counts", """
    SELECT 'products' AS relation, count(*) AS records FROM part UNION ALL SELECT 'categories', CAST(sum(len(string_split(p_name, ' '))) AS BIGINT) FROM part
    UNION ALL SELECT 'offers', count(*) FROM part UNION ALL SELECT 'owners', count(*) FROM part""")
def record_counts(t):
    return N.record_counts(N.normalize_documents(product_documents(t), "doc", _MAPPING, _KEYS))


_FOLD = "replace(replace(replace(strip_accents({c}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"


@query("ascii_fold", f"SELECT doc_id, {_FOLD.format(c='text')} AS folded FROM documents")
def ascii_fold(t):
    return t.documents.select("doc_id", X.ascii_fold(F.col("text")).alias("folded"))


@query("standardize_names", f"""
    SELECT doc_id, regexp_replace(trim(regexp_replace(trim(lower({_FOLD.format(c="text || ' Co, Ltd.'")})),
           '(?:[\\s,]+(?:{"|".join(X.LEGAL_SUFFIXES)})\\.?)+$', '')), '[[:punct:]]', '', 'g') AS name FROM documents""")
def standardize_names(t):
    """Whole document texts with a legal form at the end stand for company names."""
    return t.documents.select("doc_id", X.standardize_name(F.concat("text", F.lit(" Co, Ltd."))).alias("name"))


@query("norm_levenshtein", """
    SELECT p_partkey, round(levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand)), 6) AS d_brand,
           round(levenshtein(p_name, split_part(p_name, ' ', 2)) / greatest(length(p_name), length(split_part(p_name, ' ', 2))), 6) AS d_last FROM part""")
def norm_levenshtein(t):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey", F.round(X.normalized_levenshtein(name, F.col("p_brand")), 6).alias("d_brand"),
        F.round(X.normalized_levenshtein(name, F.split_part(name, F.lit(" "), F.lit(2))), 6).alias("d_last"))


@query("path_segment", """
    SELECT page_id, split_part(url, '/', 3) AS host, CASE WHEN len(string_split(url, '/')) > 3 THEN split_part(url, '/', 4) END AS section,
           replace(url, '-', '') AS bare FROM pages""")
def path_segment(t):
    url = F.col("url")
    return t.pages.select("page_id", X.path_segment(url, 2).alias("host"), X.path_segment(url, 3).alias("section"),
                          X.without_dashes(url).alias("bare"))
