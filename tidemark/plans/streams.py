"""Queries: streaming jobs over the given tables, with the batch result as their check."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.session import scratch_dir
from tidemark.streaming import incremental as I


def event_stream(t):
    """The events file as a landing directory of one file (file sources take a glob)."""
    return I.file_stream(t.spark, f"{t.directory}/events.parque[t]", t.events.schema)


@query("stream_ingest", "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def stream_ingest(t):
    target, checkpoint = scratch_dir(t.spark, "ingest"), scratch_dir(t.spark, "progress")
    clean = lambda batch: batch.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).drop("props")
    I.ingest(event_stream(t), target, checkpoint, clean).awaitTermination()
    return I.read_ingested(t.spark, target)


@query("stream_latest", """
    SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest(t):
    target, checkpoint = scratch_dir(t.spark, "latest"), scratch_dir(t.spark, "progress")
    rows = event_stream(t).select("user_id", "event_id", "ts", "event_type", "value")
    I.upsert_latest(rows, target, checkpoint, ["user_id"], ["ts", "event_id"]).awaitTermination()
    return I.read_latest(t.spark, target, ["user_id"], ["ts", "event_id"])


@query("events_per_window", """
    WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
    SELECT *, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY window_start) AS BIGINT) AS n_upto FROM w""")
def events_per_window(t):
    windows = I.window_counts(t.events, "ts", ["event_type"], "6 hours", "value").withColumn("total", F.round("total", 2))
    return I.cumulative_counts(windows, ["event_type"])
