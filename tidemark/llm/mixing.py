"""Mixing sources to target weights: a splitting tree deals exact source quotas to shards, shards draw permuted blocks.

A document's size is its number of words. Sources stand in code point order, NULL last, with the weights 5, 2, 1,
repeating, and share the size of all documents; no target exceeds ``most`` times its source's size, and what is cut off
is shared by weight among the others. Every source is passed over in full as often as its target allows; the rest of
its quota is drawn without replacement.

The documents of a source lie in 2^d shards by a hash. The rest quota is dealt down a binary tree over the shards: a
node's quota goes to its halves by a hypergeometric draw over their words (drawn one by one up to ``EXACT`` words,
beyond it by the normal limit, always within what both halves hold), so shard quotas are multivariate hypergeometric
and add up exactly. Each shard then goes through its own blocks (documents) in a permuted order until its quota is
full; the last block is taken in part. All draws are hashes of the seed, so reruns agree.

NULL and blank texts have size 0 and nothing is taken of them. Repeated rows count and are taken each for itself. Only
DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import written

WEIGHTS = (5, 2, 1)
SHARD_ROWS = 4_000  # documents of a source that one shard is to hold
EXACT = 64          # quotas up to this number of words are dealt word by word


def word_count(text: str) -> Column:
    """Runs of code points outside [\\x20\\x09-\\x0D]."""
    spaced = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    return (F.length(spaced) - F.length(F.translate(spaced, "a", ""))).cast("long")


def unit(*parts) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts]), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size → with target. The sources are few; one window goes over them."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(WEIGHTS) + 1).cast("int"))
    rated = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    so_far, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = rated.withColumns({
        # The common level if exactly the sources before this one stop at their caps.
        "level": (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)))
        / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0))), "ratio": F.col("cap") / F.col("weight")})
    final = level.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows))
    return final.select("source", "source_size", F.when(
        F.col("final").isNull() | (F.col("ratio") < F.col("final.ratio")), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final.level"))).alias("target"))


def hypergeometric(quota: str, left: str, right: str, seed: int) -> Column:
    """How many of ``quota`` words drawn without replacement come from the left of two halves of given sizes."""
    total = f"({left} + {right})"
    draw = f"pmod(xxhash64(source, node, i, {seed}), 4503599627370496L) / 4503599627370496D"
    exact = (f"aggregate(if({quota} > 0, sequence(1L, {quota}), array()), 0L, "
             f"(got, i) -> got + if({draw} * ({total} - i + 1) < {left} - got, 1L, 0L))")
    spread = f"sqrt({quota} * ({left} / {total}) * ({right} / {total}) * (({total} - {quota}) / greatest({total} - 1, 1)))"
    normal = (f"sqrt(-2 * ln((pmod(xxhash64(source, node, 1, {seed}), 4503599627370496L) + 0.5D) / 4503599627370496D))"
              f" * cos(2 * pi() * pmod(xxhash64(source, node, 2, {seed}), 4503599627370496L) / 4503599627370496D)")
    free = f"CAST(round({quota} * ({left} / {total}) + {spread} * {normal}) AS BIGINT)"
    held = f"greatest(0L, {quota} - {right}, least({quota}, {left}, {free}))"
    return F.expr(f"CASE WHEN {total} = 0 THEN 0L WHEN {quota} <= {EXACT} THEN {exact} ELSE {held} END")


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 3, seed: int = 20, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, size, source_size, target, taken, shard, turn (order within the shard); text on request."""
    sized = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sums = written(sums, "sources")
    goals = source_targets(sums.select("source", "source_size"), most).withColumn("quota", F.round("target").cast("long")).withColumns({
        "passes": F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
        "rest": F.when(F.col("source_size") > 0, F.col("quota") % F.col("source_size")).otherwise(F.lit(0)).cast("long")})
    goals = written(goals, "goals").withColumnRenamed("source", "src")
    largest = sums.agg(F.max("rows")).first()[0] or 1
    depth = max(0, ((largest - 1) // SHARD_ROWS).bit_length())
    shard = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << depth)).cast("long")
    leaves = written(sized.withColumn("shard", shard).groupBy("source", "shard").agg(F.sum("size").alias("words")), "leaves")

    # Down the tree: the quotas of level l + 1 from those of level l.
    quotas = goals.select(F.col("src").alias("source"), F.lit(0).cast("long").alias("node"), F.col("rest").alias("quota"))
    for level in range(depth):
        below = leaves.groupBy("source", F.expr(f"shiftright(shard, {depth - level})").alias("node")).agg(
            F.sum(F.when(F.expr(f"shiftright(shard, {depth - level - 1}) % 2 = 0"), F.col("words")).otherwise(0)).alias("lefts"),
            F.sum(F.when(F.expr(f"shiftright(shard, {depth - level - 1}) % 2 = 1"), F.col("words")).otherwise(0)).alias("rights"))
        below = below.withColumnsRenamed({"source": "bs", "node": "bn"})
        dealt = quotas.join(below, F.col("source").eqNullSafe(F.col("bs")) & (F.col("node") == F.col("bn"))).withColumn(
            "given", hypergeometric("quota", "lefts", "rights", seed + level))
        quotas = dealt.select("source", F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("given").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("quota") - F.col("given")).alias("quota")))).alias("x")).select("source", "x.*")
    quotas = written(quotas, "quotas").withColumnsRenamed({"source": "qs", "node": "qn", "quota": "share"})

    turn = Window.partitionBy("source", "shard").orderBy(F.xxhash64("key", F.lit(seed + 1)), "key")
    if keep_text:
        sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), F.struct("*").alias("doc"))
    placed = sized.withColumn("shard", shard)
    placed = placed.withColumns({"before": F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "turn": F.row_number().over(turn)})
    out = placed.join(F.broadcast(quotas) if (quotas.count() * 40 <= 32_000_000) else quotas, F.col("source").eqNullSafe(F.col("qs")) & (F.col("shard") == F.col("qn")), "left")
    out = out.join(F.broadcast(goals) if sums.count() * 60 <= 32_000_000 else goals, F.col("source").eqNullSafe(F.col("src")), "left")
    drawn = F.greatest(F.lit(0), F.least("size", F.coalesce("share", F.lit(0)) - F.col("before")))
    return out.select(F.col("key").alias(key), "size", "source_size", F.col("target"), (F.col("passes") * F.col("size") + drawn).cast("long").alias("taken"), "shard", "turn", *(["doc"] if keep_text else []))
