"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns of
documents; the last returns the packed pieces. ``n_chars`` follows the text where a stage changes it. Stages are written
as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack
from tidemark.llm.quality import judge
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.substring_dedup import dedup
from tidemark.llm.tables import sized, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return judge(docs, keep=tuple(docs.columns)).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by key, of each group of linked ones. Documents with a NULL key are linked with nothing and stay."""
    gone = near_duplicates(docs).where("component_id < doc_id").select("doc_id").distinct()
    rest = docs.join(sized(written(gone, "copies"), 16), "doc_id", "left_anti")
    # Repeated rows of one key are copies too.
    again = written(rest.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    twice = rest.join(sized(again, 16), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(sized(again, 16), "doc_id", "left_anti").select(*docs.columns).unionByName(twice.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of later occurrences of 20-word windows. Texts that lose nothing stay as they are."""
    found = dedup(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long")
    return found.select(*[text.alias("text") if c == "text" else length.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often as the mix takes them: whole, then its first words up to the words taken, one below the other."""
    mixed = mix_sources(docs, keep_text=True).where("taken > 0")
    whole = F.array_repeat("doc.text", (F.col("taken") / F.col("size")).cast("int"))
    rest = (F.col("taken") % F.col("size")).cast("int")
    head = F.when(rest > 0, F.array(F.array_join(F.slice(F.array_remove(F.split("doc.text", r"[\x20\x09-\x0D]+"), ""), F.lit(1), rest), " "))).otherwise(
        F.array().cast("array<string>"))
    text = F.array_join(F.concat(whole, head), "\n")
    done = mixed.select("doc.*", text.alias("__text"))
    return done.select(*[F.col("__text").alias("text") if c == "text" else F.length("__text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("ngram_jaccard_join", near_copies), ("substring_dedup", repeated_passages),
    ("mix_sources", mixture), ("packing", packed)]

#: Near duplicates, substring removal and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
