"""Delimited tables: headers checked before Spark reads the rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataContractError, FusionDataError, ScoreTableError
from ..operators.joins import join_predictions
from ..operators.metrics import evaluate_min_dcf
from ..operators.validate import check_labels, check_scores, reject_duplicate_columns
from ..schema import MANIFEST_COLUMNS, SPOOF


def delimiter(name: str) -> str:
    """One character; 'tab', '\\t' and 'comma' by name."""
    known = {"tab": "\t", "\\t": "\t", "comma": ","}.get(name.lower(), name)
    if len(known) != 1:
        raise ScoreTableError(f"a delimiter is one character: {name!r}")
    return known


def delimiter_of(path: str) -> str:
    return "\t" if path.lower().endswith((".tsv", ".tab")) else ","


def header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names of the first line, without a byte order mark."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    return next(csv.reader(io.StringIO(first[0][0].removeprefix("﻿")), delimiter=sep), [])


def read_text_table(spark: SparkSession, path: str, required: Sequence[str], sep: str = "\t") -> DataFrame:
    """All columns as text; ScoreTableError without a header, with repeated or without required columns."""
    sep = delimiter(sep)
    names = header(spark, path, sep)
    if not names:
        raise ScoreTableError(f"{path}: no header")
    missing = [c for c in required if c not in names]
    if missing:
        raise ScoreTableError(f"{path}: no column {', '.join(missing)}")
    if len(set(names)) != len(names):
        raise ScoreTableError(f"{path}: repeated columns")
    schema = ", ".join(f"`{c}` string" for c in names)
    return spark.read.schema(schema).option("enforceSchema", True).csv(path, header=True, sep=sep)


def read_table(spark: SparkSession, table: DataFrame | str, context: str = "table") -> DataFrame:
    """A DataFrame as it is, or a CSV or TSV file with its types inferred; repeated headers are an error."""
    if isinstance(table, DataFrame):
        reject_duplicate_columns(table.columns, context)
        return table
    sep = delimiter_of(table)
    names = header(spark, table, sep)
    reject_duplicate_columns(names, context)
    if not names:
        raise FusionDataError(f"{context}: no header")
    df = spark.read.csv(table, header=True, sep=sep, inferSchema=True)
    df = df.toDF(*names)
    return df.withColumn("file_id", F.col("file_id").cast("string")) if "file_id" in names else df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue: text columns, fold as a number; a missing column or blank fold is an error."""
    names = header(spark, path, ",")
    missing = [c for c in ("path", "label", "fold") if c not in names]
    if missing:
        raise DataContractError(f"{path}: no column {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in names)
    rows = spark.read.schema(schema).csv(path, header=True)
    out = rows.withColumn("fold", F.col("fold").try_cast("int"))
    if not out.filter(F.col("fold").isNull()).isEmpty():
        raise DataContractError(f"{path}: blank fold")
    return out.select(*[c for c in MANIFEST_COLUMNS if c in names], *[c for c in names if c not in MANIFEST_COLUMNS])


def read_headerless_scores(spark: SparkSession, path: str) -> DataFrame:
    """(filename, score) of the lines with exactly two tab-separated fields."""
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).filter(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("filename"), F.trim(F.get(parts, F.lit(1))).cast("double").alias("score"))


def read_predictions(spark: SparkSession, path: str, id_column: str = "id", score_column: str = "score", sep: str = "\t") -> DataFrame:
    return check_scores(read_text_table(spark, path, [id_column, score_column], sep), id_column, score_column)


def read_labels(spark: SparkSession, path: str, id_column: str = "id", label_column: str = "label", sep: str = "\t") -> DataFrame:
    return check_labels(read_text_table(spark, path, [id_column, label_column], sep), id_column, label_column)


def load_evaluation(
    spark: SparkSession, scores: str, labels: str, id_column: str = "id", score_column: str = "score", label_column: str = "label", sep: str = "\t", allow_extra: bool = False
) -> DataFrame:
    """(id, label, score) of two files, joined strictly."""
    predictions = read_predictions(spark, scores, id_column, score_column, sep)
    return join_predictions(read_labels(spark, labels, id_column, label_column, sep), predictions, allow_extra)


def evaluate_files(spark: SparkSession, scores: str, labels: str, **options) -> Mapping[str, float]:
    """minDCF of a score file against a label file."""
    rows = load_evaluation(spark, scores, labels, **options).withColumn("is_spoof", (F.col("label") == SPOOF).cast("int"))
    return evaluate_min_dcf(rows, "score", "is_spoof").first().asDict()


def report(result: Mapping[str, float]) -> str:
    """Six lines."""
    return "\n".join([
        f"minDCF: {result['min_dcf']:.6f}", f"threshold: {result['threshold']:.10g}", f"P_miss: {result['p_miss']:.6f}", f"P_fa: {result['p_fa']:.6f}",
        f"bona fide: {result['n_bonafide']}", f"spoof: {result['n_spoof']}",
    ])
