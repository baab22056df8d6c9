"""Helpers shared by the training-data operators.

Everything that must outlive a lost executor is written as Parquet below the
folder the cluster names in ``spark.checkpoint.dir``; a private folder is made
only where that setting is absent and the master is local (unit tests).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import scratch

#: Rows that a worker has in hand at once as Python objects.
ROWS_AT_ONCE = 1000
#: What a worker keeps from task to task, by who keeps it.
HELD: dict[str, dict] = {}
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def hand_back() -> None:
    """Returns freed memory to the system, as workers live on and allocators keep what they had at their peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def forget(keeps: str | None) -> None:
    """Drops all that this worker holds but ``keeps``."""
    for name in [n for n in HELD if n != keeps]:
        del HELD[name]


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], many: int | None = ROWS_AT_ONCE, keeps: str | None = None) -> Callable:
    """``rows``, given ``many`` rows at a time (None: batches as they come), in a worker that keeps nothing but ``keeps``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, many or max(1, batch.num_rows)):
                yield batch.slice(at, many)
                if many:
                    hand_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)  # by a function of this module: a dictionary would travel to the worker as a copy
        try:
            yield from rows(pieces(batches))
        finally:
            hand_back()

    return run


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stored:
    """A DataFrame written to the shared folder: cut lineage, read many times."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished, unreferenced stages."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> list[Column]:
    """(k1, k2): 64-bit XXH64 and 32-bit CRC of the text, null as empty."""
    return [F.xxhash64(whole_text(column)).alias("k1"), F.crc32(whole_text(column).cast("binary")).alias("k2")]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def piece_count(spark: SparkSession) -> int:
    """Pieces that a group is ranked in: they grow with the shuffle, within bounds that keep the table of pieces small."""
    return min(512, max(64, partitions(spark)))


def spread_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, salts: int | None = None, salt: Column | None = None) -> DataFrame:
    """Adds ``name``: the row's 0-based gapless rank within ``group``.

    A group is cut into ``salts`` pieces by a hash of ``order``, ranked piece by
    piece, and each piece starts where the one before ends, so that a group
    holding a third of all rows never meets in one task.  The order within a
    group is (piece, order), the same for the same rows however they arrive.
    ``salt`` numbers the pieces instead of the hash; where it grows with
    ``order``, ranks follow ``order`` alone.
    """
    salts = salts or piece_count(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int") if salt is None else salt.cast("int"))
    keys = [*group, "_salt"]
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    )
    starts = starts.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_start")
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1)
    match = [ranked[k].eqNullSafe(starts[f"_g_{k}"]) for k in keys]
    joined = ranked.join(starts, on=_all(match), how="inner")
    return joined.withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_salt", "_in", "_start", *[f"_g_{k}" for k in keys])


def _all(conditions: Iterable[Column]) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
