"""Quality rules: counts of a text, and how far its characters and common words are from those of its language.

References are made from all documents of a language: the share of each character class, and of each common word (a
word that makes up at least ``COMMON`` of the language's words, so there are at most 1 / COMMON of them). A document's
own shares are compared with them by the Jensen-Shannon distance (base 2, 0 to 1). Texts of under ``min_chars`` code
points are not judged by characters, texts of under ``min_words`` words not by words: their shares are too coarse.

NULL, empty and blank texts have no words and fail the base rule. NULL is a language like any other. Repeated rows stay.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import sized, written

SPACES = r"[\x20\x09-\x0D]+"
#: Character classes beside lower-case letters and white space, which make up nearly all of a text.
PLAIN = r"[\p{Ll}\s]+"
CLASSES = (r"\p{Lu}", r"\p{N}", r"[.,;:!?'\"()-]", r"[#*$%&|<>@^~=+_/\\{}\[\]]")
COMMON = 0.004
WINDOW = 5
SIEVE = 1024


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often later expressions use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "")


def class_counts(text: str, rest: str) -> Column:
    """Code points of ``PLAIN``, of each class and of none, as an array. ``rest`` is the text without ``PLAIN``."""
    counts = [(F.length(rest) - F.length(F.regexp_replace(rest, f"{c}+", ""))).cast("double") for c in CLASSES]
    return F.array((F.length(text) - F.length(rest)).cast("double"), *counts, F.length(rest) - sum(counts[1:], counts[0]))


def repeated_words(hashes: str, k: int = WINDOW) -> str:
    """SQL for the (hash, place) of all windows of k words, sorted; empty if no window occurs twice."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(1, k))
    return f"transform(slice({hashes}, 1, size({hashes}) - {k - 1}), (h, i) -> xxhash64(h, {parts}))"


def distance(own: str, reference: str) -> Column:
    """Jensen-Shannon distance of an array of counts from an array of shares."""
    total = f"aggregate({own}, 0D, (a, x) -> a + x)"
    part = "if({0} > 0, {0} * log2(2 * {0} / (p + q)), 0D)"
    terms = f"zip_with(transform({own}, x -> x / total), {reference}, (p, q) -> {part.format('p')} + {part.format('q')})"
    return F.expr(
        f"sqrt(greatest(0D, aggregate(transform(filter(array({total}), t -> t > 0), total -> "
        f"aggregate({terms}, 0D, (a, x) -> a + x)), 0D, (a, x) -> a + x)) / 2)")


def language_references(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """One row per language: lang, shares of character classes, hashes of common words and their shares."""
    rows = docs.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = len(CLASSES) + 2
    chars = held(held(rows, rest=F.regexp_replace("t", PLAIN, "")), c=class_counts("t", "rest")).groupBy("lang").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n)])
    total = F.greatest(sum((F.col(f"c{i}") for i in range(1, n)), F.col("c0")), F.lit(1.0))
    chars = chars.select("lang", F.array(*[F.col(f"c{i}") / total for i in range(n)]).alias("class_shares"))
    # Words are hashed after they are unfolded, in generated code.
    words = rows.select("lang", F.explode(words_of("t")).alias("word")).select("lang", F.xxhash64("word").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    words = written(words, "words")
    sums = words.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "l")
    common = words.join(sized(written(sums, "sums"), 40), F.col("lang").eqNullSafe(F.col("l"))).where(F.col("n") >= COMMON * F.col("total"))
    common = common.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "w", (F.col("n") / F.col("total")).alias("s")))).alias("x")).withColumnRenamed("lang", "l")
    return chars.join(common, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "lang", "class_shares", F.coalesce(F.col("x.w"), F.array().cast("array<bigint>")).alias("common"),
        F.coalesce(F.expr("concat(x.s, array(1D - aggregate(x.s, 0D, (a, v) -> a + v)))"), F.array(F.lit(1.0))).alias("common_shares"),
        # Most words are told from common ones by one look.
        F.coalesce(F.expr(f"transform(sequence(0, {SIEVE - 1}), i -> exists(x.w, w -> pmod(w, {SIEVE}) = i))"),
                   F.expr(f"array_repeat(false, {SIEVE})")).alias("sieve"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_chars: int = 200, min_words: int = 50,
          max_class: float = 0.3, max_common: float = 0.45, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, class_distance, common_distance, kept, and the columns named in ``keep``."""
    refs = sized(written(language_references(docs, text, lang), "languages"), 12_000).withColumnRenamed("lang", "ref_lang")
    df = docs.select(F.struct(*[F.col(c) for c in {key: 0, **dict.fromkeys(keep)}]).alias("row"), F.col(lang).alias("lang"),
                     F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = held(df, words=words_of("t"), rest=F.regexp_replace("t", PLAIN, ""), lines=F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    symbols = F.length("rest") - F.length(F.regexp_replace("rest", "[#*$%&|<>]+", ""))
    # Texts and words end here: only hashes and counts go on.
    df = held(df, hashes=F.transform("words", lambda w: F.xxhash64(w)), n_words=F.size("words").cast("long"), t_chars=F.length("t"),
              word_chars=F.length(F.array_join("words", "")).cast("long"), n_symbols=symbols.cast("long"), chars=class_counts("t", "rest"),
              n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("t", "words", "rest", "lines")
    df = held(df, windows=F.expr(f"if(n_words >= {WINDOW}, {repeated_words('hashes')}, array())").cast("array<bigint>"))
    df = held(df, placed=F.expr("if(size(array_distinct(windows)) < size(windows), "
                                "sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))), array())")).drop("windows")
    again = ("transform(filter(transform(placed, (x, k) -> struct(x.i AS i, (k > 0 AND placed[k - 1].h = x.h) OR "
             "(k + 1 < size(placed) AND placed[k + 1].h = x.h) AS twice)), x -> x.twice), x -> x.i)")
    # A window adds the words that the one before it did not cover.
    covered = (f"aggregate(sort_array({again}), struct(-{WINDOW} AS last, 0L AS n), (a, i) -> struct(i AS last, "
               f"a.n + least({WINDOW}, i - a.last) AS n), a -> a.n)")
    df = held(df, n_repeat_words=F.expr(covered)).drop("placed")
    df = df.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    df = held(df, hits=F.filter("hashes", lambda h: F.get("sieve", F.pmod(h, F.lit(SIEVE)).cast("int")) & F.array_contains("common", h)))
    df = held(df, counts=F.expr("concat(transform(common, c -> CAST(size(hits) - size(array_remove(hits, c)) AS DOUBLE)), array(CAST(n_words - size(hits) AS DOUBLE)))"))
    df = held(df, class_distance=distance("chars", "class_shares"), common_distance=distance("counts", "common_shares"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    fits = ((F.col("t_chars") < min_chars) | (F.coalesce("class_distance", F.lit(0.0)) <= max_class)) & (
        (F.col("n_words") < min_words) | (F.coalesce("common_distance", F.lit(0.0)) <= max_common))
    return df.select(
        "row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "class_distance", "common_distance", (~failed & fits).alias("kept"))
