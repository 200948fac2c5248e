"""Incremental ingest: exactly-once appends, upserts, and windowed counts with late rows dropped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.relate import latest_per_key
from tidemark.streaming import delta

FILES_PER_BATCH = 500


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New files of a landing directory; what was read is kept in the query's checkpoint."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", str(files_per_batch)).load(path)


def delta_name(batch: DataFrame, batch_id: int) -> str:
    """Name of a micro-batch: the stream's own id, which its checkpoint keeps, and the number of the batch."""
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{stream or 'batch'}-{batch_id}"


def ingest(stream: DataFrame, target: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each micro-batch to the table ``target`` as a delta with its commit (see ``delta``).

    A batch that is run again after a failure is committed once, so nothing is stored twice.
    Columns may widen from batch to batch; ``read_ingested`` merges them.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        delta.add(batch if clean is None else clean(batch), target, delta_name(batch, batch_id))

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return delta.read(spark, target)


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], newest: Sequence[str]) -> StreamingQuery:
    """Keep the newest row per key. Each batch is reduced to its newest rows and appended as a delta.

    Nothing stored is rewritten per batch; ``read_latest`` merges the deltas, ``compact`` folds them
    into one from time to time, also between the batches of a running stream.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        delta.add(latest_per_key(batch, keys, newest), target, delta_name(batch, batch_id))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    return latest_per_key(read_ingested(spark, target), keys, newest)


def compact(spark: SparkSession, target: str, compacted: str, keys: Sequence[str], newest: Sequence[str]) -> None:
    """The newest row per key of ``target`` as one delta of the table ``compacted``.

    If that is ``target`` itself, the delta replaces those that it was made of; later ones stay beside it.
    """
    now = delta.live(spark, target)
    rows = latest_per_key(delta.read_folders(spark, target, now.values()), keys, newest)
    delta.replace_live(rows, compacted, list(now) if compacted == target else ())


def window_counts(df: DataFrame, at: str, keys: Sequence[str], width: str, value: str | None = None, late: str | None = None) -> DataFrame:
    """Rows (and a sum) per key and tumbling window; for streams, rows later than ``late`` are dropped."""
    source = df if late is None else df.withWatermark(at, late)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return source.groupBy(F.window(at, width), *keys).agg(*aggs).select(F.col("window.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def append_windows(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Closed windows to parquet, each exactly once."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", target)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def cumulative_counts(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windowed counts added up over time, per key: what is known up to the end of each window."""
    by = ", ".join(keys)
    over = f"OVER (PARTITION BY {by} ORDER BY window_start ROWS UNBOUNDED PRECEDING)"
    return windows.selectExpr("*", f"sum(n) {over} AS n_upto")
