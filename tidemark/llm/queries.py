"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chosen_path import similar_sets
from tidemark.llm.fingerprints import imatch
from tidemark.llm.html_extract import extract
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.lexical_search import build_index, search
from tidemark.llm.mixing import mix_sources
from tidemark.llm.mixing_lm import score
from tidemark.llm.packing import pack
from tidemark.llm.prefix_trie import grafted, id_digests, prefix_trie, sequenced
from tidemark.llm.quality import judge
from tidemark.llm.substring_dedup import dedup
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.url_rules import fixed_rules, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = fixed_rules(spark, URL_RULES)
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@register
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op7_url_filters"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT *, host = 'net' OR ends_with(host, '.net') AS net, host = 'example.net' OR ends_with(host, '.example.net') AS exnet,
         host = 'example.com' OR ends_with(host, '.example.com') AS excom, host = 'org' OR ends_with(host, '.org') AS org FROM parts
), ruled AS (
  SELECT *, CASE WHEN exnet AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN excom AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN org AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN net AND starts_with(path, '/') THEN 'net/' END AS rule FROM fits
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


@register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


@register
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents"))


@register
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@register
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = sequenced(table(spark, sf_dir, "conversations"))
    conversations, turns = grafted(turns, 20, F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
    nodes, ends = prefix_trie(conversations, turns)
    return nodes.join(id_digests(ends), "node", "left").drop("node").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


@register
def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


@register
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search(build_index(docs), docs, table(spark, sf_dir, "benchmark"), top=20)


ORACLES["op11_lexical_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS len FROM counts GROUP BY doc_id
), total AS (SELECT count(*) AS docs, CAST(sum(len) AS BIGINT) AS words FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * docs) // words)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
