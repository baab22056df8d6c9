"""The test tables seen as manifests, scores, frames and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB forms of the views below, for the oracles.
SQL = {
    "scored": "SELECT CAST(d.doc_id AS VARCHAR) AS file_id, CAST(d.n_chars AS DOUBLE) AS score, CAST(l.toxic AS INTEGER) AS is_spoof, "
    "d.lang, d.source, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)",
    "manifest": "SELECT CAST(d.doc_id AS VARCHAR) AS file_id, d.doc_id, CAST(l.toxic AS INTEGER) AS label, CAST(d.doc_id % 5 AS INTEGER) AS fold, "
    "d.source AS generator, d.lang FROM documents d JOIN labels l USING (doc_id)",
    "window_scores": "SELECT user_id, event_id, ts, least(1.0::DOUBLE, value / 500.0::DOUBLE) AS score FROM events",
    "frames": "SELECT vec_id // 50 AS seq, CAST(vec_id % 50 AS INTEGER) AS idx, 0.4::DOUBLE + 0.2::DOUBLE * (vec_id % 50) AS frame_time, "
    "CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings",
    "trace": "SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a label: score is the length, spoof is toxic."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(read(spark, d, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").cast("string").alias("file_id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").cast("int").alias("is_spoof"),
        "lang", "source", "n_chars", "quality",
    )


def manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    rows = docs.join(read(spark, d, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").cast("string").alias("file_id"), "doc_id", F.col("toxic").cast("int").alias("label"),
        (F.col("doc_id") % 5).cast("int").alias("fold"), F.col("source").alias("generator"), "lang",
    )


def window_scores(spark: SparkSession, d: str) -> DataFrame:
    """Events as windows of a user's file."""
    return read(spark, d, "events").select("user_id", "event_id", "ts", F.least(F.lit(1.0), F.col("value") / F.lit(500.0)).alias("score"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as sequences of 50 frames."""
    return read(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 50).cast("long").alias("seq"), (F.col("vec_id") % 50).cast("int").alias("idx"),
        (F.lit(0.4) + F.lit(0.2) * (F.col("vec_id") % 50)).alias("frame_time"), F.transform("embedding", lambda x: x.cast("double")).alias("e"), "label",
    )


def trace(spark: SparkSession, d: str) -> DataFrame:
    """Event values as a sample sequence per user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("user_id", "event_id", "ts", "value").withColumn("i", F.row_number().over(w) - 1)
