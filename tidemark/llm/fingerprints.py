"""I-Match fingerprints: hashes of a text's distinct terms that lie in randomised subsets of a lexicon.

The lexicon holds the terms whose document frequency lies between ``LEAST`` and ``MOST`` of all distinct texts, that is
whose inverse document frequency lies in a band. It has at most (distinct terms of a mean document) / LEAST terms,
however many documents there are. Subset s of the lexicon holds each of its terms with the chance 1 / RATES[s]; coarse
subsets react to any edit, fine ones outlast large edits. A fingerprint is one hash per subset; the likeness of two is
the share of subsets, empty in not both, whose hashes agree (1 if both are empty everywhere).

The hash of a subset is the exclusive or of its distinct terms' hashes. Like the hash of the sorted list it depends on
the set of terms alone, but terms need not be gathered and sorted: 24 numbers per document are kept while its terms
stream by.

Texts with too few terms in the band are fingerprinted by all their terms, the hashes of which need no lexicon. Where no
subset has any of a text's terms, the first has all of them.

Terms are words lower-cased by A-Z. NULL is an empty text. Texts without words have the fingerprint of the empty
set. Rows with a NULL key come first in the order of keys; repeated keys follow each other in any order and stay one row
each. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.quality import SPACES, held
from tidemark.llm.tables import partitions_of, sized, written

LEAST, MOST = 0.001, 0.25
ENOUGH = 4  # a text with less than a 4th of its terms in the band is fingerprinted by all its terms
RATES = tuple(4 ** (1 + s // 6) for s in range(24))  # six subsets each of a 4th, 16th, 64th and 256th of the lexicon
NONE = "--------"


def terms(text: str) -> Column:
    """Hashes of the distinct words of a text."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.transform(F.array_remove(F.split(low, SPACES), ""), lambda w: F.xxhash64(w)))


def hashed(term: str) -> list[Column]:
    """h0, h2 … of a term."""
    hashes = [F.when(F.pmod(F.xxhash64(term, F.lit(s + 100)), F.lit(rate)) == 0, F.xxhash64(term, F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0))
              for s, rate in enumerate(RATES)]
    return [(F.shiftleft(hashes[s], 32).bitwiseOR(hashes[s + 1])).cast("bigint").alias(f"h{s}") for s in range(0, len(RATES), 2)]


def lexicon(docs: DataFrame, text: str) -> DataFrame:
    """term, h0, h2 …: the terms in the band; h<s> holds 32 bits of hash for subset s and 32 for s + 1, 0 where it is not in them."""
    # Copies count once: a large group of them pushes no term out of the band.
    distinct = docs.select(text).dropDuplicates([text])
    total = distinct.count()
    found = distinct.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return found.where((F.col("df") >= max(2, LEAST * total)) & (F.col("df") <= max(2, MOST * total))).select("term", *hashed("term"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, next_text, part, place, ghost (not 0 for copies at the end of a range): the following document's text by key, the first one's after the last.

    Keys are cut into ranges at some of their own values; the document at a cut also goes to the range before it, the
    first document also to the last range. So one exchange suffices and no range looks into another.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(32, 4 * partitions_of(docs))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n).alias("c"), F.min(F.struct(F.col("key"))).alias("m"),
                    F.min("key").alias("k"), F.count_if(F.col("key").isNull()).alias("nulls")).first()
    values = sorted(set(cuts["c"] or []) - ({cuts["k"]} if not cuts["nulls"] else set()))
    lit = F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    part = F.expr("coalesce(aggregate(cuts, 0, (a, c) -> a + CAST(c <= key AS INT)), 0)")
    least = F.col("key").isNull() if cuts["nulls"] else F.col("key") == F.lit(cuts["k"])
    dealt = rows.withColumn("cuts", lit).withColumn("part", part).select(
        "key", "text", F.explode(F.array_compact(F.array(
            F.struct("part", F.lit(0).alias("ghost")),
            F.when(F.array_contains("cuts", F.col("key")), F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("ghost"))),
            F.when(least, F.struct(F.lit(len(values)).alias("part"), F.lit(2).alias("ghost")))))).alias("p")).select("key", "text", "p.*")
    order = Window.partitionBy("part").orderBy("ghost", F.asc_nulls_first("key"))
    return dealt.withColumns({"next_text": F.lead("text").over(order), "place": F.row_number().over(order)})


def sided(text: str, side: int) -> Column:
    # One row for each side comes first, so that no document gets lost.
    return F.concat(F.array(F.struct(F.lit(None).cast("bigint").alias("t"), F.lit(side).alias("side"))),
                    F.transform(terms(text), lambda t: F.struct(t.alias("t"), F.lit(side).alias("side"))))


def spelled(hashes: str) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lpad(F.hex(h), 8, "0"), F.lit(NONE))), "")


def likeness(a: str, b: str) -> Column:
    agree, either = (f"aggregate(zip_with({a}, {b}, (x, y) -> {e}), 0, (n, v) -> n + v)" for e in (
        "CAST(x <=> y AND x IS NOT NULL AS INT)", "CAST(x IS NOT NULL OR y IS NOT NULL AS INT)"))
    return F.expr(f"coalesce({agree} / nullif({either}, 0), 1D)").cast("double")


def imatch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    known = sized(written(lexicon(docs, text), "lexicon"), 8 * (len(RATES) // 2 + 2))
    pairs = with_next(docs, key, text)
    # Documents keep their range from here on, so grouping and looking ahead again need no exchange.
    pairs = held(pairs, edited=F.expr("concat(substring(text, 1, length(text) - CAST(floor(length(text) / 2) AS INT)), "
                                      "substring(coalesce(next_text, ''), 1, CAST(floor(length(text) / 2) AS INT)))"))
    pairs = held(pairs, n_chars=F.length("text").cast("long"), edited_sha256=F.sha2(F.col("edited").cast("binary"), 256))
    marked = pairs.select(
        "part", "place", "ghost", "key", "n_chars", "edited_sha256", F.explode(F.concat(sided("text", 0), sided("edited", 1))).alias("x"))
    hits = marked.join(known, F.col("x.t") == F.col("term"), "left")
    keys = ("part", "place", "ghost", "key", "n_chars", "edited_sha256")
    names = [f"h{s}" for s in range(0, len(RATES), 2)]
    # The hashes of terms outside the band follow from the terms alone.
    hits = hits.select(*keys, F.col("x.side").alias("side"), F.col("x.t").alias("t"), "term", *names)
    outside = F.col("t").isNotNull() & F.col("term").isNull()
    sums = hits.groupBy(*keys, "side").agg(
        F.count("t").alias("n_terms"), F.count("term").alias("n_band"), F.bit_xor(F.xxhash64("t", F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF))).alias("any"),
        *[F.bit_xor(n).alias(n) for n in names], *[F.bit_xor(F.when(outside, h)).alias(f"o{n}") for n, h in zip(names, hashed("t"))])
    few = F.col("n_band") * ENOUGH < F.col("n_terms")
    sums = sums.select(*keys, "side", "n_terms", "any", *[
        F.coalesce(n, F.lit(0)).bitwiseXOR(F.when(few, F.coalesce(f"o{n}", F.lit(0))).otherwise(F.lit(0))).alias(n) for n in names])
    # A text with words of which no subset has any: the first subset has all.
    blank = F.greatest(*[F.abs(F.sign(n)) for n in names]) == 0
    first = F.when(blank & (F.col("n_terms") > 0), F.shiftleft("any", 32)).otherwise(F.col(names[0]))
    sums = sums.withColumn(names[0], first)
    halves = [h for n in names for h in (F.shiftrightunsigned(n, 32), F.col(n).bitwiseAND(F.lit(0xFFFFFFFF)))]
    # A document's own row is followed by its edited text's and the next document's own.
    order = Window.partitionBy("part").orderBy("place", "side")
    prints = sums.select(*keys, "side", F.array(*[F.nullif(h.cast("bigint"), F.lit(0).cast("bigint")) for h in halves]).alias("own"))
    return prints.withColumns({"edit": F.lead("own").over(order), "next": F.lead("own", 2).over(order)}).where("ghost = 0 AND side = 0").select(
        F.col("key").alias(key), "n_chars", "edited_sha256", spelled("own").alias("fingerprint"), spelled("edit").alias("edited_fingerprint"),
        likeness("own", "edit").alias("near_edited"), likeness("own", "next").alias("near_next"))
