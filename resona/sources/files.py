"""Audio files: discovery and decoding."""

from __future__ import annotations

import importlib
import io
import wave
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RunnerError
from ..functions import dsp
from ..schema import ANALYSIS_SUFFIXES, RUNNER_SUFFIXES, SAMPLE_RATE, WAVEFORM
from . import paths
from .flac import decode_flac


def _listing(spark: SparkSession, directory: str, recursive: bool, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        return reader.load(directory)
    except Exception as e:  # Spark names a missing path in several ways
        if "PATH_NOT_FOUND" in str(e):
            raise RunnerError(f"no such directory: {directory}") from e
        raise


def discover(spark: SparkSession, directory: str, suffixes: Sequence[str] = RUNNER_SUFFIXES) -> DataFrame:
    """path, relative, filename, length, content of the audio files below a directory, with their place ``_ord``.

    Suffixes match in any case; the order is by relative path without case,
    then by full path.  A directory without audio files is an error.  Content is
    read only where a later step asks for it.
    """
    found = _listing(spark, directory, True)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(hadoop).toString().rstrip("/") + "/"
    kept = found.filter(paths.suffix("path").isin(*suffixes))
    kept = kept.withColumn("relative", F.expr(f"substring(path, {len(root) + 1})")).withColumn("filename", paths.basename("path"))
    if kept.select("path").isEmpty():
        raise RunnerError(f"no audio files in {directory}")
    return kept.select("path", "relative", "filename", "length", "content")


def in_order(files: DataFrame) -> DataFrame:
    """The files in the order of discovery."""
    return files.orderBy(F.lower("relative"), "path")


def collect_files(spark: SparkSession, path: str) -> DataFrame:
    """A single file, or the files below a directory, by path (the analysis tool's suffixes)."""
    found = _listing(spark, path, True)
    return found.filter(paths.suffix("path").isin(*ANALYSIS_SUFFIXES)).orderBy("path")


def test_files(spark: SparkSession, directory: str) -> DataFrame:
    """The WAV files right in a directory as unlabelled manifest rows: label 'unknown', fold -1."""
    found = _listing(spark, directory, False, "*.wav")
    return found.select("path", paths.basename("path").alias("filename"), F.lit("unknown").alias("label"), F.lit(-1).alias("fold")).orderBy("path")


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono doubles in -1..1 and the sample rate of a PCM WAV of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(n)
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(float) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def encode_wav(samples: np.ndarray, rate: int = SAMPLE_RATE, width: int = 2) -> bytes:
    """A mono PCM WAV."""
    out = io.BytesIO()
    top = (1 << (8 * width - 1)) - 1
    ints = np.clip(np.rint(np.asarray(samples, float) * (top + 1)), -top - 1, top).astype(np.int64)
    raw = (ints + 128).astype(np.uint8).tobytes() if width == 1 else ints.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def decoder_of(content: bytes, name: str, decoders: Mapping[str, str] | None = None) -> Callable[[bytes], tuple[np.ndarray, int]]:
    """What turns the content into mono samples and their rate: WAV and FLAC by their first bytes, others by suffix.

    ``decoders`` names further ones 'module:function' by suffix; a worker imports them when it first meets the suffix.
    """
    if content[:4] == b"fLaC":
        return decode_flac
    suffix = ("." + name.lower().rpartition(".")[2]) if "." in name else ""
    where = (decoders or {}).get(suffix)
    if where:
        module, _, function = where.partition(":")
        return getattr(importlib.import_module(module), function)
    if suffix in RUNNER_SUFFIXES and suffix not in (".wav", ".flac") and content[:4] not in (b"RIFF", b"RIFX"):
        raise ValueError(f"no decoder for {suffix} files")
    return decode_wav


def load_audio(content: bytes, rate: int = SAMPLE_RATE, normalise: bool = True, name: str = "", decoders: Mapping[str, str] | None = None) -> np.ndarray:
    """Mono samples at ``rate``, finite, and with ``normalise`` brought to a peak of one."""
    x, have = decoder_of(content, name, decoders)(content)
    x = dsp.resample(x, have, rate)
    if not len(x):
        raise ValueError("no samples")
    if not np.isfinite(x).all():
        raise ValueError("samples are not finite")
    return dsp.peak_normalised(x) if normalise else x


def decode(
    files: DataFrame, rate: int = SAMPLE_RATE, normalise: bool = True, permissive: bool = False, key: str = "path", length: int | None = None, most_seconds: float | None = None,
    decoders: Mapping[str, str] | None = None,
) -> DataFrame:
    """Waveforms (file_id, sample_rate, samples) of the files' content, one task per batch of files.

    A file that cannot be decoded fails the query; with ``permissive`` it keeps its row,
    null samples and the reason in column ``error``.  ``length`` cuts or fills
    with zeros; ``most_seconds`` cuts.  WAV and FLAC are decoded here, other
    formats by ``decoders`` ('module:function' by suffix).
    """
    others = dict(decoders or {})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            samples, errors = [], []
            for name, content in zip(pdf["file_id"], pdf["content"], strict=True):
                try:
                    x = load_audio(bytes(content), rate, normalise, name, others)
                    if most_seconds is not None:
                        x = x[: int(most_seconds * rate)]
                    if length is not None:
                        x = np.concatenate([x[:length], np.zeros(max(0, length - len(x)))])
                    samples.append(x.astype(np.float32))
                    errors.append(None)
                except Exception as e:  # the decoder's errors have many types
                    if not permissive:
                        raise RunnerError(f"{name}: {e}") from e
                    samples.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"file_id": pdf["file_id"], "sample_rate": np.int32(rate), "samples": samples, "error": errors})

    slim = files.select(F.col(key).alias("file_id"), "content")
    out = slim.mapInPandas(rows, WAVEFORM + ", error string")
    return out if permissive else out.drop("error")
