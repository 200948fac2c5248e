"""Exact k nearest neighbours as a two-step bound join.

Training points lie in cells of a few pivots, and a cell is cut into rings by the distance to its pivot, about
``BLOCK_ROWS`` points each, so that blocks (cell, ring) grow in number with the data while pivots do not. In a first
step a query meets only its own block; the k-th distance there, or a bound from the points nearest to each pivot if that
is smaller, is its radius. In the second step it visits only the blocks that the triangle inequality (and the
hyperplane between two pivots) cannot put beyond that radius. Crowded blocks are split by hash, queries of a block too,
so neither a dense cell nor a large query set meets in one task, and each block sends on no more than k rows per query,
none beyond its radius. Within a block, distances by products leave out what is too far for certain; what is left is
measured by differences. Queries are sent to blocks a few at a time, so a task's memory does not grow with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

PIVOTS = 128       # most cells; a fixed number, as rings follow the data
BLOCK_ROWS = 16384  # training points of a block, and queries that meet it in one task
AT_ONCE = 1 << 20  # numbers in one array of differences
STEP = 1000        # queries whose blocks are worked out together
SENT = 16384       # rows in which queries are sent to blocks
SLACK = 1e-9       # bounds are loosened by this share, so that rounding never excludes a neighbour


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """[rows, dimensions] of a column of number lists; a NULL number is not a number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError("the vectors have several lengths")
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return values.reshape(len(column), lengths[0].as_py() if len(lengths) else 0)


def _beside(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], [*batch.schema.names, *columns])


def _steps(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            yield batch.slice(i, STEP)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[len(x), len(y)] Euclidean distances, from differences, a few rows of x at a time."""
    step = max(1, AT_ONCE // max(1, y.size))
    out = [np.sqrt(((x[i: i + step, None, :] - y[None]) ** 2).sum(axis=2)) for i in range(0, len(x), step)]
    return np.concatenate(out) if out else np.zeros((0, len(y)))


class _Cells:
    """What is known of the cells: pivots, rings and the radii of the points nearest to each pivot. All bounded by PIVOTS and k."""

    def __init__(self, pivots: np.ndarray, counts: dict, widest: dict, nearest: dict, k: int):
        m = len(pivots)
        self.pivots, self.k = pivots, k
        self.filled = np.array([c in counts for c in range(m)], bool)
        self.widest = np.array([widest.get(c, 0.0) for c in range(m)])
        self.rings = np.array([max(1, math.ceil(counts.get(c, 0) / BLOCK_ROWS)) for c in range(m)])
        self.width = np.where(self.widest > 0, self.widest / self.rings, 1.0)
        self.nearest = np.array([(nearest.get(c, []) + [math.inf] * k)[:k] for c in range(m)])

    def ring(self, cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(radius / self.width[cell]).astype(np.int64), 0, self.rings[cell] - 1)

    def bound(self, d: np.ndarray) -> np.ndarray:
        """A distance within which each query has k training points for certain."""
        reach = (d[:, :, None] + self.nearest[None]).reshape(len(d), -1)
        return np.partition(reach, self.k - 1, axis=1)[:, self.k - 1]

    def visits(self, d: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, ring) that may hold a point within each query's radius."""
        far = radius * (1 + SLACK) + SLACK
        least = np.where(self.filled[None], d, np.inf).min(axis=1)
        open_ = self.filled[None] & ((d - least[:, None]) / 2 <= far[:, None]) & (d - far[:, None] <= self.widest[None])
        q, c = np.nonzero(open_)
        low = np.floor(np.maximum(d[q, c] - far[q], 0) / self.width[c]) - 1  # one ring more than the division says
        high = np.floor(np.minimum((d[q, c] + far[q]) / self.width[c], self.rings[c])) + 1
        low, high = (np.clip(x, 0, self.rings[c] - 1).astype(np.int64) for x in (low, high))
        n = high - low + 1
        ring = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(q, n), np.repeat(c, n), ring


def _sent(batch: pa.RecordBatch, cells: _Cells):
    """The queries of a batch for each block they visit but their own, ``SENT`` rows at a time."""
    q, c, r = cells.visits(_distances(_matrix(batch["q_vec"]), cells.pivots), batch["radius"].to_numpy())
    other = (c != batch["own_cell"].to_numpy()[q]) | (r != batch["own_ring"].to_numpy()[q])
    q, c, r = q[other], c[other].astype(np.int32), r[other]
    for i in range(0, len(q), SENT):
        here = slice(i, i + SENT)
        yield _beside(batch.select(["q_key", "q_vec", "radius"]).take(pa.array(q[here])), cell=c[here], ring=r[here])


def _cells(train: DataFrame, vector: str, key: str, k: int) -> tuple[DataFrame, _Cells]:
    """Training points with cell and radius, written, and what is known of the cells."""
    # Any choice of pivots gives the same result; a hash order spreads them well enough.
    cells = min(PIVOTS, max(1, 4 * train.count() // BLOCK_ROWS))  # a cell of fewer points saves less than it costs
    chosen = train.orderBy(F.xxhash64(key), key).limit(cells).select(vector).toArrow()
    pivots = np.unique(_matrix(chosen[vector]), axis=0)
    schema = train.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", cell int, radius double"

    def assign(batches):
        for batch in _steps(batches):
            d = _distances(_matrix(batch[vector]), pivots)
            cell = d.argmin(axis=1)
            yield _beside(batch, cell=cell.astype(np.int32), radius=d[np.arange(len(d)), cell])

    placed = materialize(train.mapInArrow(assign, schema), "cells")
    sizes = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("far")).collect()}
    nearest = placed.selectExpr("cell", "radius", "row_number() OVER (PARTITION BY cell ORDER BY radius) AS place").where(f"place <= {k}")
    near = {r["cell"]: sorted(r["r"]) for r in nearest.groupBy("cell").agg(F.collect_list("radius").alias("r")).collect()}
    return placed, _Cells(pivots, {c: n for c, (n, _) in sizes.items()}, {c: far for c, (_, far) in sizes.items()}, near, k)


def nearest_neighbours(train: DataFrame, query: DataFrame, key: str, vector: str, k: int, carry: str) -> DataFrame:
    """(query key, neighbour key, ``carry`` of the neighbour, distance, place 1 … k); ties by neighbour key."""
    found, _ = neighbours_and_visits(train, query, key, vector, k, carry)
    return found


def neighbours_and_visits(train: DataFrame, query: DataFrame, key: str, vector: str, k: int, carry: str) -> tuple[DataFrame, DataFrame]:
    """The neighbours, and (cell, ring, queries, points) of the blocks visited. Rows with a NULL vector are left out."""
    train = train.where(F.col(vector).isNotNull()).select(F.col(key).alias("t_key"), F.col(vector).alias("t_vec"), F.col(carry).alias("t_carry"))
    query = query.where(F.col(vector).isNotNull()).select(F.col(key).alias("q_key"), F.col(vector).alias("q_vec"))
    types = {**dict(train.dtypes), **dict(query.dtypes)}
    found_schema = f"q_key {types['q_key']}, t_key {types['t_key']}, t_carry {types['t_carry']}, distance double"
    if not train.take(1):
        empty = train.sparkSession.createDataFrame([], found_schema + ", place int")
        return empty.selectExpr(f"q_key AS {key}", "t_key AS neighbour", f"t_carry AS {carry}", "distance", "place"), train.sparkSession.createDataFrame(
            [], "cell int, ring long, queries long, points long")
    placed, cells = _cells(train, "t_vec", "t_key", k)
    n_query = query.count()
    # Rings by the same arithmetic as in the visits.
    rings = {name: np.asarray(x) for name, x in (("width", cells.width), ("rings", cells.rings))}

    def ringed(batches):
        for batch in batches:
            c, r = batch["cell"].to_numpy(), batch["radius"].to_numpy()
            yield _beside(batch.drop_columns(["radius"]), ring=np.clip(np.floor(r / rings["width"][c]).astype(np.int64), 0, rings["rings"][c] - 1))

    points = materialize(placed.mapInArrow(ringed, f"t_key {types['t_key']}, t_vec {types['t_vec']}, t_carry {types['t_carry']}, cell int, ring long"), "points")
    sizes = points.groupBy("cell", "ring").agg(F.count("*").alias("points"))
    sizes = materialize(sizes.withColumn("splits", F.ceil(F.col("points") / BLOCK_ROWS).cast("int")), "blocks")
    shares = max(1, math.ceil(n_query / BLOCK_ROWS))

    def home(batches):
        for batch in _steps(batches):
            d = _distances(_matrix(batch["q_vec"]), cells.pivots)
            cell = np.where(cells.filled[None], d, np.inf).argmin(axis=1)
            yield _beside(batch, cell=cell.astype(np.int32), ring=cells.ring(cell, d[np.arange(len(d)), cell]), radius=cells.bound(d))

    at_home = materialize(query.mapInArrow(home, f"q_key {types['q_key']}, q_vec {types['q_vec']}, cell int, ring long, radius double"), "queries")

    def met(asked: DataFrame) -> DataFrame:
        """The k best of each split of each block that is asked, none beyond the query's radius."""
        share = F.pmod(F.xxhash64("q_key"), F.lit(shares)).cast("int")
        left = asked.withColumn("share", share).join(sizes.select("cell", "ring", "splits"), ["cell", "ring"]).select(
            "cell", "ring", "share", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), "q_key", "q_vec", "radius")
        wanted = asked.select("cell", "ring", share.alias("share")).distinct()
        right = points.join(sizes.select("cell", "ring", "splits"), ["cell", "ring"]).join(wanted, ["cell", "ring"]).select(
            "cell", "ring", "share", F.pmod(F.xxhash64("t_key"), F.col("splits")).cast("int").alias("split"), "t_key", "t_vec", "t_carry")
        block = ["cell", "ring", "share", "split"]
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_best(k), found_schema)

    first = materialize(met(at_home), "home")
    ranked = first.selectExpr("q_key", "distance", "row_number() OVER (PARTITION BY q_key ORDER BY distance) AS place").where(f"place = {k}")
    radius = at_home.join(ranked.select(F.col("q_key").alias("__k"), "distance"), F.col("q_key") == F.col("__k"), "left").select(
        "q_key", "q_vec", F.col("cell").alias("own_cell"), F.col("ring").alias("own_ring"), F.least("radius", F.coalesce("distance", "radius")).alias("radius"))

    def route(batches):
        for batch in _steps(batches):
            yield from _sent(batch, cells)

    routed = materialize(radius.mapInArrow(route, f"q_key {types['q_key']}, q_vec {types['q_vec']}, radius double, cell int, ring long"), "routes")
    local = first.unionByName(met(routed))
    # At most k rows per block remain for each query.
    out = local.selectExpr("*", "row_number() OVER (PARTITION BY q_key ORDER BY distance, t_key) AS place").where(f"place <= {k}")
    asked = at_home.select("cell", "ring").union(routed.select("cell", "ring")).groupBy("cell", "ring").agg(F.count("*").alias("queries"))
    return out.selectExpr(f"q_key AS {key}", "t_key AS neighbour", f"t_carry AS {carry}", "distance", "place"), asked.join(
        sizes, ["cell", "ring"]).select("cell", "ring", "queries", "points")


def _near(queries: np.ndarray, points: np.ndarray, radius: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the k nearest points of each query within its radius, equal ones in the points' order."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(invalid="ignore", over="ignore"):
        finite = np.isfinite(points).all(axis=1)
        middle = points[finite].mean(axis=0) if finite.any() else np.zeros(points.shape[1])
        y = points - middle
        yy = (y * y).sum(axis=1)
        step = max(1, AT_ONCE // max(1, len(points)))
        for i in range(0, len(queries), step):
            x = queries[i: i + step] - middle
            xx = (x * x).sum(axis=1)
            rough = xx[:, None] + yy[None] - 2 * (x @ y.T)
            # Rounding of centring, products and sums stays far below this share of the largest squares.
            slack = 1e-12 * (points.shape[1] + 8) * (xx + yy[finite].max(initial=0) + (middle * middle).sum())
            most = (radius[i: i + step] * (1 + SLACK) + SLACK) ** 2
            if rough.shape[1] > k:
                most = np.fmin(most, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
            q, p = np.nonzero(~(rough > (most + slack)[:, None]))  # what is not a number is not left out
            wide = max(1, AT_ONCE // max(1, points.shape[1]))
            d = np.concatenate([np.zeros(0), *(np.sqrt(((queries[i + q[j: j + wide]] - points[p[j: j + wide]]) ** 2).sum(axis=1)) for j in range(0, len(q), wide))])
            order = np.lexsort((p, d, q))
            q, p, d = q[order], p[order], d[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((i + q[keep], p[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(k: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right["t_key"]))  # so that equal distances go by key
        if left.num_rows and right.num_rows:
            q, p, d = _near(_matrix(left["q_vec"]), _matrix(right["t_vec"]), left["radius"].to_numpy(), k)
        else:
            q, p, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"q_key": left["q_key"].take(pa.array(q)), "t_key": right["t_key"].take(pa.array(p)),
                         "t_carry": right["t_carry"].take(pa.array(p)), "distance": d})

    return best


def vote(neighbours: DataFrame, key: str, label: str, weighted: bool = False) -> DataFrame:
    """Winning class per query with its share of the votes; equal votes go to the smaller class.

    ``weighted`` counts each neighbour by 1 / distance; neighbours at distance 0 then decide alone.
    """
    if weighted:
        exact = neighbours.selectExpr("*", f"min(distance) OVER (PARTITION BY {key}) = 0 AS hit")
        rows = exact.selectExpr(key, label, "CASE WHEN hit THEN CAST(distance = 0 AS DOUBLE) ELSE 1 / distance END AS w")
    else:
        rows = neighbours.selectExpr(key, label, "1D AS w")
    votes = rows.groupBy(key, label).agg(F.sum("w").alias("w"))
    return votes.groupBy(key).agg(
        F.expr(f"min_by({label}, struct(-round(w, 9) AS w, {label} AS c))").alias("prediction"), F.expr("max(w) / sum(w)").alias("share"))
