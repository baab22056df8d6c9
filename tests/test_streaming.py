import numpy as np
from pyspark.sql import functions as F

from resona.sources.files import encode_wav
from resona.streaming import windows


def run(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_counts_with_lateness(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("ts", "event_type", "user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.event_time(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run(windows.tumbling(stream, "1 hour", "event_type"), "append", "tumbling_rows", tmp_path)
    closed = spark.table("tumbling_rows")
    batch = events.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert 0 < closed.count() <= batch.count() and closed.agg(F.sum("n")).first()[0] <= events.count()
    run(windows.sliding(stream, "1 hour", "30 minutes"), "complete", "sliding_rows", tmp_path)
    assert spark.table("sliding_rows").agg(F.sum("n")).first()[0] == 2 * events.count()
    run(windows.sessions(stream, "30 minutes", "user_id"), "append", "session_rows", tmp_path)
    assert spark.table("session_rows").count() > 0


def test_late_rows_are_left_out(spark, tmp_path):
    """A row later than the watermark allows is dropped, one within it counts."""
    schema = "ts timestamp_ntz, k string"
    for part in ([("2024-05-01 10:00:00", "a"), ("2024-05-01 12:00:00", "a")], [("2024-05-01 12:00:00", "a")], [("2024-05-01 10:05:00", "late"), ("2024-05-01 11:55:00", "in time"), ("2024-05-01 14:00:00", "a")], [("2024-05-01 16:00:00", "a")]):
        rows = spark.createDataFrame(part, "t string, k string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "k")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = windows.event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late")), lateness="10 minutes")
    run(windows.tumbling(stream, "1 hour", "k"), "append", "late_rows", tmp_path)
    assert {r.k: r.n for r in spark.table("late_rows").filter("k <> 'a'").collect()} == {"in time": 1}


def test_frames_out_of_order_give_no_change(spark, tmp_path):
    for part in ([("f", 1, [1.0, 0.0]), ("f", 0, [0.0, 2.0]), ("g", 0, [0.0, 0.0])], [("f", 3, [2.0, 0.0]), ("f", 1, [0.0, 1.0]), ("g", 4, [1.0, 1.0])]):
        spark.createDataFrame(part, "file_id string, frame_idx long, embedding array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema("file_id string, frame_idx long, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames"))
    run(windows.running_change(stream), "append", "change_rows", tmp_path)
    assert sorted(map(tuple, spark.table("change_rows").collect())) == [("f", 1, 1.0), ("f", 3, 0.0), ("g", 4, 0.0)]


def test_running_top3(spark, tmp_path):
    for i, rows in enumerate(([("a", 0.1), ("a", 0.9), ("b", 0.5)], [("a", 0.8), ("a", 0.7)])):
        spark.createDataFrame(rows, "file_id string, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_id string, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(windows.running_top3(stream), "update", "top3_rows", tmp_path)
    last = {}
    for r in spark.table("top3_rows").collect():
        if r.n >= last.get(r.file_id, (0, 0))[0]:
            last[r.file_id] = (r.n, round(r.top3_mean, 6))
    assert last == {"a": (4, 0.8), "b": (1, 0.5)}


def test_files_are_scored_as_they_land(spark, tmp_path):
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.wav").write_bytes(encode_wav(0.3 * np.sin(np.arange(96_000) / 9)))
    run(windows.score_landing(spark, str(tmp_path / "land")), "append", "landed_rows", tmp_path)
    assert spark.table("landed_rows").count() == 3
