import pytest

from tidemark.operators.relate import latest_per_key
from tidemark.streaming import delta
from tidemark.streaming import incremental as I


def land(spark, folder, name, sql):
    spark.sql(sql).coalesce(1).write.mode("overwrite").parquet(str(folder / name))


def test_ingest_reads_each_file_once_and_widens(spark, tmp_path):
    landing, target, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    schema = spark.createDataFrame([], "id int, v string").schema
    land(spark, landing, "a", "SELECT 1 AS id, 'x' AS v")
    run = lambda clean=None: I.ingest(I.file_stream(spark, f"{landing}/*", schema), target, progress, clean).awaitTermination()
    run()
    run()  # nothing new
    assert I.read_ingested(spark, target).count() == 1
    land(spark, landing, "b", "SELECT 2 AS id, 'y' AS v")
    run(lambda batch: batch.selectExpr("*", "upper(v) AS extra"))
    rows = {r["id"]: r["extra"] for r in I.read_ingested(spark, target).collect()}
    assert rows == {1: None, 2: "Y"}


def test_upsert_equals_batch(spark, tmp_path):
    landing = tmp_path / "in"
    land(spark, landing, "a", "SELECT * FROM VALUES ('k', 1, 'old'), ('j', 5, 'only') AS t(k, at, v)")
    land(spark, landing, "b", "SELECT * FROM VALUES ('k', 3, 'new') AS t(k, at, v)")
    land(spark, landing, "c", "SELECT * FROM VALUES ('k', 2, 'late') AS t(k, at, v)")
    schema = spark.createDataFrame([], "k string, at int, v string").schema
    stream, target = I.file_stream(spark, f"{landing}/*", schema, files_per_batch=1), str(tmp_path / "t")
    I.upsert_latest(stream, target, str(tmp_path / "cp"), ["k"], ["at"]).awaitTermination()
    batch = latest_per_key(spark.read.parquet(f"{landing}/*"), ["k"], ["at"])
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, I.read_latest(spark, target, ["k"], ["at"]).collect())) == want
    I.compact(spark, target, str(tmp_path / "c"), ["k"], ["at"])
    assert sorted(map(tuple, I.read_ingested(spark, str(tmp_path / "c")).collect())) == want


def test_late_rows_are_dropped(spark, tmp_path):
    # A row is late by the watermark of the batch before, so one more batch lies between.
    landing = tmp_path / "in"
    for i, at in enumerate(["2024-01-01 00:10", "2024-01-01 05:00", "2024-01-01 05:30", "2024-01-01 00:20", "2024-01-02 00:00"]):
        land(spark, landing, f"{i}", f"SELECT TIMESTAMP'{at}:00' AS ts, 'e' AS kind, 1.0D AS value")
    schema = spark.createDataFrame([], "ts timestamp, kind string, value double").schema
    stream = I.file_stream(spark, f"{landing}/*", schema, files_per_batch=1)
    I.append_windows(I.window_counts(stream, "ts", ["kind"], "1 hour", "value", late="1 hour"), str(tmp_path / "w"), str(tmp_path / "cp")).awaitTermination()
    got = {str(r["window_start"]): r["n"] for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-01 05:00:00"] == 2


def latest(spark, target):
    return sorted(map(tuple, I.read_latest(spark, target, ["k"], ["at"]).select("k", "at", "v").collect()))


def test_compaction_between_batches(spark, tmp_path):
    landing, target, progress = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")
    schema = spark.createDataFrame([], "k string, at int, v string").schema
    run = lambda: I.upsert_latest(I.file_stream(spark, f"{landing}/*", schema, files_per_batch=1), target, progress, ["k"], ["at"]).awaitTermination()
    land(spark, landing, "a", "SELECT * FROM VALUES ('k', 1, 'old'), ('j', 5, 'only') AS t(k, at, v)")
    land(spark, landing, "b", "SELECT * FROM VALUES ('k', 3, 'new') AS t(k, at, v)")
    run()
    assert len(delta.live(spark, target)) == 2
    before = I.read_ingested(spark, target)  # a reader that began before the compaction
    I.compact(spark, target, target, ["k"], ["at"])
    assert len(delta.live(spark, target)) == 1 and I.read_ingested(spark, target).count() == 2
    assert before.count() == 3 and latest(spark, target) == [("j", 5, "only"), ("k", 3, "new")]
    land(spark, landing, "c", "SELECT * FROM VALUES ('k', 9, 'newest'), ('i', 1, 'x') AS t(k, at, v)")
    run()
    assert len(delta.live(spark, target)) == 2
    assert latest(spark, target) == [("i", 1, "x"), ("j", 5, "only"), ("k", 9, "newest")]
    I.compact(spark, target, target, ["k"], ["at"])
    assert len(delta.live(spark, target)) == 1 and latest(spark, target) == [("i", 1, "x"), ("j", 5, "only"), ("k", 9, "newest")]


def test_deltas_exist_once_committed(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = lambda n: spark.range(n)
    assert delta.live(spark, target) == {}
    with pytest.raises(ValueError):
        delta.read(spark, target)
    assert delta.add(rows(3), target, "s-0") and not delta.add(rows(5), target, "s-0")  # run again: stored once
    rows(7).write.parquet(f"{target}/data/s-1-stopped")                                 # written, never committed
    assert delta.read(spark, target).count() == 3
    seen = list(delta.live(spark, target))
    delta.add(rows(2), target, "s-1")                                                   # meanwhile
    delta.replace_live(rows(3), target, seen)
    assert delta.read(spark, target).count() == 5
    assert not delta.add(rows(3), target, "s-0") and delta.read(spark, target).count() == 5  # again, after it was replaced
    with pytest.raises(RuntimeError):
        delta.replace_live(rows(3), target, seen)


def test_streams_with_new_checkpoints_do_not_pass_for_old_ones(spark, tmp_path):
    landing, target = tmp_path / "in", str(tmp_path / "t")
    land(spark, landing, "a", "SELECT 1 AS id")
    schema = spark.createDataFrame([], "id int").schema
    for progress in ("p", "q"):
        I.ingest(I.file_stream(spark, f"{landing}/*", schema), target, str(tmp_path / progress)).awaitTermination()
    assert I.read_ingested(spark, target).count() == 2 and len(delta.live(spark, target)) == 2
