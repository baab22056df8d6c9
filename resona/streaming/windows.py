"""Incremental scoring: windowed counts with lateness, running summaries, landing folders."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import RUNNER_SUFFIXES


def event_time(stream: DataFrame, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """The stream with a watermark; local timestamps are taken as the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling(stream: DataFrame, width: str, *groups: str, ts: str = "ts") -> DataFrame:
    return stream.groupBy(F.window(ts, width), *groups).agg(F.count(F.lit(1)).alias("n"))


def sliding(stream: DataFrame, width: str, slide: str, *groups: str, ts: str = "ts") -> DataFrame:
    return stream.groupBy(F.window(ts, width, slide), *groups).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, gap: str, *groups: str, ts: str = "ts") -> DataFrame:
    return stream.groupBy(F.session_window(ts, gap), *groups).agg(F.count(F.lit(1)).alias("n"))


def running_top3(stream: DataFrame, key: str = "file_id", score: str = "score") -> DataFrame:
    """(key, top3_mean, n) after each batch that brought a key new scores; three numbers of state per key."""
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, n = state.get if state.exists else ([], 0)
        best = list(best)
        for pdf in batches:
            values = pdf["score"].tolist()
            best = sorted([*best, *values], reverse=True)[:3]
            n += len(values)
        state.update((best, n))
        yield pd.DataFrame({key: [k[0]], "top3_mean": [sum(best) / len(best)], "n": [n]})

    rows = stream.select(key, F.col(score).alias("score"))
    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, top3_mean double, n long", "best array<double>, n long", "update", GroupStateTimeout.NoTimeout
    )


def running_change(stream: DataFrame, key: str = "file_id", order: str = "frame_idx", vector: str = "embedding") -> DataFrame:
    """(key, order, change) of each frame after a key's first: one less the cosine to the frame before.

    The state of a key is its latest frame.  Frames of a batch are taken in
    order; one that comes after a later one gives no row.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}

    def update(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(order)
        at, before = state.get if state.exists else (None, None)
        places, changes = [], []
        for i, e in zip(pdf[order].tolist(), pdf[vector], strict=True):
            if at is not None and i <= at:
                continue
            now = np.asarray(e, float)
            if before is not None:
                old = np.asarray(before, float)
                length = float(np.linalg.norm(old) * np.linalg.norm(now))
                places.append(i)
                changes.append(1.0 - float(old @ now) / length if length else 0.0)
            at, before = i, now
        state.update((int(at), [float(x) for x in before]))
        yield pd.DataFrame({key: [k[0]] * len(places), order: places, "change": changes})

    rows = stream.select(key, order, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, change double"
    return rows.groupBy(key).applyInPandasWithState(update, schema, "at long, before array<double>", "append", GroupStateTimeout.NoTimeout)


def landing_files(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = RUNNER_SUFFIXES) -> DataFrame:
    """Audio files as they land in a directory; scoring a file needs no state, so it is exact."""
    from ..sources import paths

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(directory)
    return stream.filter(paths.suffix("path").isin(*suffixes))


def score_landing(spark: SparkSession, directory: str, scorer: str = "spectral-flatness") -> DataFrame:
    """Window scores of files as they land."""
    from ..operators.scoring import score_windows
    from ..sources.files import decode

    return score_windows(decode(landing_files(spark, directory)), scorer, spread=False)
