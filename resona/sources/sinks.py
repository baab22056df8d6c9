"""Small text results, written whole or not at all; caches and models."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RunnerError
from ..schema import SUMMARY_COLUMNS


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, system, source, target) -> None:
    """Renames over the target, so that it is there before, during and after."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, system.makeQualified(target), how)


def _publish(lines: DataFrame, path: str) -> None:
    """One text file: written beside its place, then renamed into it."""
    spark = lines.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    folder, system = _system(spark, aside)
    try:
        lines.coalesce(1).write.text(aside, lineSep="\n")
        part = next(s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("part-"))
        target, _ = _system(spark, path)
        try:
            _replace(spark, system, part, target)
        except Exception as e:  # the store's errors come through as one of Py4J's
            raise RunnerError(f"cannot write {path}") from e
        crc, _ = _system(spark, path.rpartition("/")[0] + "/." + path.rpartition("/")[2] + ".crc")
        if system.exists(crc):
            system.delete(crc, False)
    finally:
        system.delete(folder, True)


def write_score_tsv(rows: DataFrame, path: str, order: list, digits: str = ".10g", header: tuple[str, str] | None = ("filename", "cm-score")) -> None:
    """filename and score, tab separated, in ``order``; checked whole before anything is written."""
    score = F.col("score").cast("double")
    checked = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(score.isNull() | F.isnan(score) | (score < 0) | (score > 1)).alias("bad"),
        F.count_if(F.col("filename").isNull() | (F.col("filename") == "")).alias("blank"),
    ).first()
    if checked["bad"] or checked["blank"]:
        raise RunnerError(f"{checked['bad']} scores are not in 0..1, {checked['blank']} names are blank")

    # one line per file: text of a float as C's printf would give it
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: format(v, digits))

    printed = F.pandas_udf(text, "string")
    number = printed if digits.endswith("g") else (lambda c: F.format_string(f"%{digits}", c))
    body = rows.select(F.struct(*order).alias("o"), F.concat_ws("\t", "filename", number(score)).alias("value"))
    lines = body.orderBy("o").select("value")
    if header:
        top = rows.sparkSession.createDataFrame([("\t".join(header),)], "value string")
        numbered = body.select(F.lit(1).alias("k"), "o", "value")
        lines = numbered.unionByName(top.select(F.lit(0).alias("k"), "value"), allowMissingColumns=True).repartition(1).sortWithinPartitions("k", "o").select("value")
    _publish(lines, path)


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    """filename and score with six decimals, by name."""
    write_score_tsv(rows, path, ["filename"], ".6f", ("filename", "cm-score") if header else None)


def write_summaries(rows: DataFrame, path: str) -> None:
    """CSV of the summary columns; other columns are left out."""
    rows.select(*[c for c in SUMMARY_COLUMNS if c in rows.columns]).coalesce(1).write.mode("overwrite").csv(path, header=True)


class FeatureCache:
    """Parquet caches named by what they were made from: a change of inputs or settings misses the cache."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, settings: Mapping[str, object], inputs: DataFrame, key: str) -> str:
        row = inputs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).cast("string").alias("h")).first()
        text = json.dumps([name, dict(settings), row["n"], row["h"]], sort_keys=True, default=str)
        return f"{self.root}/{name}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"

    def get(self, name: str, settings: Mapping[str, object], inputs: DataFrame, key: str, make) -> DataFrame:
        """The cached table, made by ``make(inputs)`` where it is missing."""
        path = self.path(name, settings, inputs, key)
        target, system = _system(self.spark, path + "/_SUCCESS")
        if not system.exists(target):
            make(inputs).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
