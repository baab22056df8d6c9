"""Strict keyed joins of manifests, features, predictions and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ScoreTableError
from .validate import check_feature_source, check_manifest, shown


def build_feature_table(manifest: DataFrame, sources: Mapping[str, DataFrame], order: str | None = None) -> DataFrame:
    """The manifest with every source's features, joined one to one on file_id.

    Every source must cover exactly the manifest's ids.  Columns keep the order
    of the sources.  Rows have no order of their own: name an ``order`` column of
    the manifest to keep it for the sink.
    """
    base = check_manifest(manifest.withColumnRenamed(order, "_ord") if order else manifest)
    out, taken = base, []
    for name, source in sources.items():
        features = check_feature_source(source, name, base, taken)
        taken += features
        out = out.join(source.select("file_id", *features), "file_id", "left")
    return out.withColumnRenamed("_ord", order) if order else out


def missing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def join_predictions(labels: DataFrame, predictions: DataFrame, allow_extra: bool = False) -> DataFrame:
    """(id, label, score) of every label; a label without prediction, or the reverse unless allowed, is an error."""
    lost = missing_ids(labels, predictions, "id")
    extra = None if allow_extra else missing_ids(predictions, labels, "id")
    for what, gap in (("without prediction", lost), ("without label", extra)):
        if gap is not None:
            many = gap.count()
            if many:
                raise ScoreTableError(f"{what}: {shown([r[0] for r in gap.orderBy('id').limit(5).collect()], many)}")
    return labels.join(predictions, "id", "inner")


def blend(main: DataFrame, other: DataFrame, key: str = "filename", score: str = "score", weight: float = 0.7) -> DataFrame:
    """weight * main + (1 - weight) * other, or main alone where the other has no row."""
    b = other.select(F.col(key), F.col(score).alias("_other"))
    mixed = F.lit(weight) * F.col(score) + F.lit(1.0 - weight) * F.col("_other")
    return main.join(b, key, "left").withColumn(score, F.coalesce(mixed, F.col(score))).drop("_other")


def append_new(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a dimension table of one row per key."""
    return rows.join(table, key, "left")


def stack_columns(scores: Mapping[str, DataFrame], key: str = "file_id", score: str = "score") -> DataFrame:
    """One row per key with a column of each table's scores, columns sorted by name."""
    out = None
    for name in sorted(scores):
        part = scores[name].select(key, F.col(score).alias(name))
        out = part if out is None else out.join(part, key)
    return out

