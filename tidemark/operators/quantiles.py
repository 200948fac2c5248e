"""Exact quantiles, modes and running totals whose work stays spread over the cluster.

Spark's own ``percentile`` keeps every distinct value of a group in one buffer. That is fine for
values with a small domain (days, counts, shares of a hundred) and is used there; for free doubles
the operators below count rows in ever narrower buckets until every wanted rank has its value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

BROADCAST_ROWS = 100_000  # wanted buckets, of about 100 bytes, up to which they are broadcast
WHOLE_BELOW = 20_000    # buckets with fewer rows are finished by counting their values
PARTS = 1024            # equal parts into which a larger bucket is cut


def _prob_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def _binades(v: str) -> str:
    """An integer that never falls as ``v`` grows: sign, exponent and ten bits of the fraction."""
    size = f"(CAST(floor(log2(abs({v}))) AS BIGINT) + 1100) * 4096 + floor(abs({v}) / pow(2D, floor(log2(abs({v})))) * 1024)"
    ends = f"WHEN isnan({v}) OR {v} > 1.7976931348623157E308D THEN 9000000L WHEN {v} < -1.7976931348623157E308D THEN -9000000L"
    return f"CASE WHEN {v} = 0 THEN 0L {ends} WHEN {v} > 0 THEN {size} ELSE -({size}) END"


def _slots(rows: DataFrame, keys: Sequence[str], cut: str) -> DataFrame:
    """Rows of each (keys, cut): number, ends, and the number of rows of lower cuts. Only counts are shuffled."""
    counted = rows.groupBy(*keys, F.col(cut).alias("__k")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    part = Window.partitionBy(*keys)
    return counted.withColumn("start", F.sum("n").over(part.orderBy("__k")) - F.col("n")).withColumn("total", F.sum("n").over(part))


def quantile_ranks(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], held: bool = True) -> DataFrame:
    """Values at the ranks around every quantile: ``__g`` (struct of groups), i (place of the prob), side, rank, total, lo.

    Rows are counted by group and binade part, in which each rank's bucket is found; buckets with more than one value
    between their ends are cut again, until every rank has its value. A pass shuffles only counts; wanted buckets, at
    most two for each group and prob, are broadcast if their counted number allows, and else joined.
    """
    base = df.select(F.struct(*(groups or [F.lit(0).alias("none")])).alias("__g"), F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    if held:
        base = materialize(base, "quantiles")  # later passes need not compute the input again
    ranks = ", ".join(f"named_struct('i', {i}, 'side', '{side}', 'rank', CAST({side}({p}D * (total - 1)) AS BIGINT))"
                      for i, p in enumerate(probs) for side in ("floor", "ceil"))
    here = f"inline(filter(array({ranks}), r -> r.rank >= start AND r.rank < start + n))"
    slots = _slots(base.withColumn("__c", F.expr(_binades("__v"))), ["__g"], "__c")
    found = materialize(slots.selectExpr("__g", "start", "n", "lo", "hi", "total", here).selectExpr(
        "__g", "i", "side", "rank", "total", "rank - start AS ahead", "n", "lo", "hi"), "ranks")
    settled = "ahead = 0 OR ahead = n - 1 OR lo = hi"
    done = []
    while True:
        done.append(found.where(settled).selectExpr("__g", "i", "side", "rank", "total", "CASE WHEN ahead = 0 THEN lo ELSE hi END AS value"))
        open_ = found.where(f"NOT ({settled})")
        wanted = open_.select(F.col("__g").alias("__of"), "lo", "hi", "n").distinct()
        count = wanted.count()
        if not count:
            return reduce(DataFrame.unionByName, done)
        near = F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted
        rows = base.join(near, (F.col("__g") == F.col("__of")) & (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        rows = rows.selectExpr("__g", "lo AS bucket", "__v", f"CASE WHEN n <= {WHOLE_BELOW} THEN __v ELSE CAST(width_bucket(__v, lo, hi, {PARTS}) AS DOUBLE) END AS __c")
        slots = _slots(rows, ["__g", "bucket"], "__c").selectExpr("__g AS __of", "bucket", "start", "n", "lo", "hi")
        asked = open_.select("__g", "i", "side", "rank", "total", "ahead", F.col("lo").alias("at"))
        found = materialize(asked.join(slots, F.expr("__g = __of AND at = bucket AND ahead >= start AND ahead < start + n")).selectExpr(
            "__g", "i", "side", "rank", "total", "ahead - start AS ahead", "n", "lo", "hi"), "ranks")


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], held: bool = True) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group: columns ``p25``, ``p50`` ….

    NULL values are left out. Result equals ``percentile`` (and pandas ``quantile``). With ``held`` the two columns are
    written first; without, each pass reads ``df`` again, which is better for a plain table.
    """
    groups = list(groups)
    found = quantile_ranks(df, groups, value, probs, held)
    at = lambda i, side: f"max(CASE WHEN i = {i} AND side = '{side}' THEN value END)"
    results = [f"{at(i, 'floor')} + ({at(i, 'ceil')} - {at(i, 'floor')}) * ({p}D * (max(total) - 1) - floor({p}D * (max(total) - 1))) AS {_prob_name(p)}"
               for i, p in enumerate(probs)]
    if not groups:
        return found.agg(*[F.expr(r) for r in results])
    return found.groupBy("__g").agg(*[F.expr(r) for r in results]).select("__g.*", *[_prob_name(p) for p in probs])


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide to long with double values; one output row per (row, value column)."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        list(keys), list(values), name, value)


def exact_modes(df: DataFrame, groups: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, the smallest of equally frequent ones."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__c"))
    best = F.min_by(F.col(value), F.struct((-F.col("__c")).alias("c"), F.col(value).alias("v")))
    return counted.groupBy(*groups).agg(best.alias(out), F.max("__c").alias("mode_count"))


def _range_count(df: DataFrame) -> int:
    """Value ranges for ordered work: they follow the shuffle width the cluster was given."""
    return max(128, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_totals(
    df: DataFrame,
    order: str,
    measures: dict[str, Column],
    groups: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Sums of ``measures`` per distinct (groups, order) value, with running totals before and with it.

    Output columns per measure ``m``: ``m``, ``m_before`` and ``m_upto``. The order values are cut
    into ``ranges`` parts; totals of whole parts are carried over, so no task sorts more than one part
    of one group.
    """
    groups = list(groups)
    at_value = df.where(F.col(order).isNotNull()).groupBy(*groups, order).agg(
        *[F.sum(c).alias(m) for m, c in measures.items()])
    ranges = ranges or _range_count(df)
    step = math.isqrt(ranges)
    points = F.array_distinct(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges + 10_000)).alias("fine")
    if groups:
        # One short array per group; where they are few they are broadcast by their measured size.
        cuts = at_value.groupBy(*groups).agg(points).withColumnsRenamed({g: f"__g{i}" for i, g in enumerate(groups)})
        with_cuts = at_value.join(
            cuts.withColumnRenamed("fine", "__fine"), F.expr(" AND ".join(f"{g} <=> __g{i}" for i, g in enumerate(groups))))
    else:
        with_cuts = at_value.withColumn("__fine", at_value.agg(points).scalar())
    # Every step-th cut gives the block to look in, so a row is compared with about 2 * step cuts.
    blocks = with_cuts.selectExpr(*groups, order, *measures, "__fine", f"coalesce(size(filter(transform(sequence(0, size(__fine) DIV {step}), "
                                  f"i -> get(__fine, i * {step} + {step - 1})), c -> c < {order})), 0) AS __block")
    sign = "-" if descending else ""
    # Never NULL: else the join below would have the optimiser test this on the rows before they are summed.
    part = f"{sign}coalesce(__block * {step} + size(filter(slice(__fine, __block * {step} + 1, {step}), c -> c < {order})), 0)"
    parts = blocks.select(*groups, order, *measures, F.expr(part).alias("__b"))
    totals = parts.groupBy(*groups, "__b").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part of a group reaches this window.
    offsets = totals.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__b").alias("__ob"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__o_{m}") for m in measures])
    on = F.expr(" AND ".join(["__b = __ob", *[f"{g} <=> __g{i}" for i, g in enumerate(groups)]]))
    direction = F.col(order).desc() if descending else F.col(order).asc()
    run = Window.partitionBy(*groups, "__b").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(offsets, on)
    return joined.select(
        *groups, order, *measures,
        *[(F.sum(m).over(run) + F.col(f"__o_{m}")).alias(f"{m}_upto") for m in measures],
    ).select("*", *[(F.col(f"{m}_upto") - F.col(m)).alias(f"{m}_before") for m in measures])


def average_ranks(df: DataFrame, order: str, groups: Sequence[str] = (), out: str = "rank",
                  descending: bool = False) -> DataFrame:
    """(groups, order value) → rank starting at 1, ties sharing the mean of their places."""
    placed = running_totals(df, order, {"n": F.lit(1)}, groups, descending)
    return placed.select(*groups, order, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))
