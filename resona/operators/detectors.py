"""Per-file detectors and features over waveform and embedding tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import cepstral, mains, novelty, residual, splice
from ..functions.udfs import SPLICE_FEATURES
from ..schema import NOVELTY, SPLICE

NOVELTY_FEATURES = ("novelty_max", "novelty_top3_mean", "novelty_p95", "novelty_n_peaks")


def _each(waveforms: DataFrame, one, schema: str) -> DataFrame:
    """``one(file_id, rate, samples) -> dict`` over every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [one(*r) for r in zip(pdf["file_id"], pdf["sample_rate"], pdf["samples"], strict=True)]
            if found:
                yield pd.DataFrame(found)

    return waveforms.select("file_id", "sample_rate", "samples").mapInPandas(rows, schema)


def splices(waveforms: DataFrame) -> DataFrame:
    """Candidates, maxima and note of every waveform."""

    def one(file_id, rate, samples) -> dict:
        r = splice.detect(samples, int(rate))
        return {
            "file_id": file_id, "sample_rate": r.sample_rate, "duration_sec": r.duration_sec, "candidates": [vars(c) for c in r.candidates], "max_score": r.max_score,
            "max_timbre": r.max_timbre, "max_level_db": r.max_level_db, "max_transient": r.max_transient, "max_frequency_hz": r.max_frequency_hz, "note": r.note,
        }

    return _each(waveforms, one, SPLICE)


def splice_features(waveforms: DataFrame) -> DataFrame:
    return _each(waveforms, lambda f, r, x: {"file_id": f, **splice.features(x, int(r))}, "file_id string, " + ", ".join(f"{c} double" for c in SPLICE_FEATURES))


def cpps(waveforms: DataFrame) -> DataFrame:
    return _each(waveforms, lambda f, r, x: {"file_id": f, "cpps": cepstral.cpps(x, int(r))}, "file_id string, cpps double")


def lfcc(waveforms: DataFrame, permissive: bool = False) -> DataFrame:
    """(file_id, lfcc) with 120 numbers; with ``permissive`` zeros where a waveform cannot be analysed."""

    def one(file_id, rate, samples) -> dict:
        try:
            if samples is None or not len(samples) or not np.isfinite(np.asarray(samples, float)).all():
                raise AnalysisError(f"{file_id}: no finite samples")
            return {"file_id": file_id, "lfcc": cepstral.lfcc(samples, int(rate)).tolist()}
        except Exception:
            if not permissive:
                raise
            return {"file_id": file_id, "lfcc": [0.0] * 120}

    return _each(waveforms, one, "file_id string, lfcc array<double>")


def residuals(waveforms: DataFrame, kind: str = "lowpass") -> DataFrame:
    """(file_id, vector) with 257 numbers; null where a waveform cannot be analysed."""

    def one(file_id, rate, samples) -> dict:
        try:
            return {"file_id": file_id, "vector": residual.residual(samples, kind).tolist()}
        except Exception:  # scoring gives such files the middle score
            return {"file_id": file_id, "vector": None}

    return _each(waveforms, one, "file_id string, vector array<double>")


def mains_checks(waveforms: DataFrame, nominal: float = 60.0) -> DataFrame:
    """Frequency trace of the mains hum, its jumps, deviation and verdict."""

    def one(file_id, rate, samples) -> dict:
        times, freqs = mains.trace(samples, int(rate), nominal)
        state = mains.stability(freqs) if len(freqs) else {"std": None, "verdict": "too_short"}
        return {"file_id": file_id, "times": times.tolist(), "freqs": freqs.tolist(), "jumps": mains.jumps(freqs), "std": state["std"], "verdict": state["verdict"]}

    return _each(waveforms, one, "file_id string, times array<double>, freqs array<double>, jumps array<int>, std double, verdict string")


def embedding_novelty(frames: DataFrame, scales: Sequence[int] = novelty.SCALES, local_score: str | None = None) -> DataFrame:
    """Novelty results per file of (file_id, frame_idx, frame_time, embedding) rows."""
    scales = tuple(scales)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        local = pdf["local_score"].to_numpy() if local_score else None
        r = novelty.detect(np.stack(pdf["embedding"].to_list()), pdf["frame_time"].to_numpy(), scales, local_scores=local)
        return pd.DataFrame([{
            "file_id": pdf["file_id"].iloc[0], "candidates": [vars(c) for c in r.candidates], "max_score": r.max_score, "top3_mean": r.top3_mean, "p95": r.p95,
            "strongest_time_sec": r.strongest_time_sec, "boundary_times": r.boundary_times.tolist(), "curve": r.curve.tolist(),
            "scale_curves": {k: v.tolist() for k, v in r.scale_curves.items()}, "n_windows": r.n_windows, "note": r.note,
        }]) if not local_score else pd.DataFrame([{"file_id": pdf["file_id"].iloc[0], **novelty.features(r)}])

    cols = ["file_id", "frame_idx", "frame_time", "embedding"]
    rows = frames.select(*cols, *([F.col(local_score).alias("local_score")] if local_score else []))
    schema = NOVELTY
    if local_score:
        names = (*NOVELTY_FEATURES, "local_max", "local_min", "local_range", "local_max_jump", "local_p90")
        schema = "file_id string, " + ", ".join(f"{c} double" for c in names)
    return rows.groupBy("file_id").applyInPandas(one, schema)


def novelty_table(results: DataFrame) -> DataFrame:
    """The four novelty features of novelty results."""
    return results.select("file_id", F.col("max_score").alias("novelty_max"), F.col("top3_mean").alias("novelty_top3_mean"), F.col("p95").alias("novelty_p95"), F.size("candidates").cast("double").alias("novelty_n_peaks"))


def feature_distributions(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Distributions of the novelty features by label; blank or repeated file_ids are an error."""
    from .aggregate import assert_finite, distributions
    from .validate import check_ids

    check_ids(labels, "file_id", "labels", AnalysisError)
    rows = novelty_table(embedding_novelty(frames)).join(labels, "file_id", "left").cache()
    assert_finite(rows, NOVELTY_FEATURES)
    return distributions(rows, "label", NOVELTY_FEATURES)


def frame_embeddings(waveforms: DataFrame, embed: str, options: tuple = (), window: int = 12_800, hop: int = 3_200, rate: int = 16_000) -> DataFrame:
    """Embeddings of overlapping frames by a pluggable model 'module:factory', made once per worker."""
    from .scoring import loaded
    from .windows import window_samples, windows

    cut = windows(waveforms.withColumn("_n", F.size("samples").cast("long")), "_n", window, hop, rate)
    cut = cut.select("file_id", F.col("window_idx").cast("int").alias("frame_idx"), ((F.col("start_sample") + window / 2) / F.lit(float(rate))).alias("frame_time"), window_samples(F.col("samples"), F.col("start_sample").cast("int"), window).alias("samples"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(embed, options)
        for pdf in batches:
            if len(pdf):
                e = model(np.stack(pdf["samples"].to_list()))
                yield pdf.drop(columns=["samples"]).assign(embedding=[r.tolist() for r in np.asarray(e, float)])

    return cut.mapInPandas(rows, "file_id string, frame_idx int, frame_time double, embedding array<double>")


def layer_statistics(layers: DataFrame) -> DataFrame:
    """Concatenated mean and deviation per layer of (file_id, layer, frame, masked, state) rows."""
    long = layers.filter("NOT masked").select("file_id", "layer", F.posexplode("state").alias("dim", "x"))
    stats = long.groupBy("file_id", "layer", "dim").agg(F.avg("x").alias("m"), F.sqrt(F.var_pop("x") + F.lit(1e-8)).alias("s"))
    per = stats.groupBy("file_id", "layer").agg(F.sort_array(F.collect_list(F.struct("dim", "m", "s"))).alias("v"))
    per = per.select("file_id", "layer", F.concat(F.transform("v", lambda r: r["m"]), F.transform("v", lambda r: r["s"])).alias("v"))
    whole = per.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("layer", "v"))).alias("w"))
    return whole.select("file_id", F.flatten(F.transform("w", lambda r: r["v"])).alias("features"))


class Spectrum:
    """A frozen embedding without weights: log energies in 16 linear bands."""

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(batch, axis=1)) ** 2
        cut = np.linspace(0, power.shape[1], 17).astype(int)
        return np.log(np.add.reduceat(power, cut[:-1], axis=1) + 1e-6) + 20.0
