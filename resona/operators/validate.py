"""Checks of tables and columns; each table is looked at in one aggregation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataContractError, FusionDataError, InferenceError, ScoreTableError
from ..schema import BONAFIDE, FUSION_MANIFEST, LABEL_WORDS, SPOOF

_SHOWN = 5


def shown(ids: Sequence[str], total: int | None = None) -> str:
    """The first few ids and how many more there are."""
    total = len(ids) if total is None else total
    text = ", ".join(repr(i) for i in ids[:_SHOWN])
    return text + (f" and {total - _SHOWN} more" if total > _SHOWN else "")


def not_finite(column: str | Column) -> Column:
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def finite_or_null(column: str | Column) -> Column:
    """The number, or null where it is not finite."""
    c = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def label_code(column: str | Column) -> Column:
    """0 or 1 for the usual spellings of either class; null for anything else.  Booleans are no labels."""
    c = F.col(column) if isinstance(column, str) else column
    text = F.lower(F.trim(c.cast("string")))
    text = F.regexp_replace(text, r"^([01])\.0$", "$1")
    words = F.create_map(*[F.lit(x) for pair in LABEL_WORDS.items() for x in pair])
    return F.element_at(words, text).cast("tinyint")


def reject_duplicate_columns(columns: Sequence[str], context: str) -> None:
    twice = sorted({c for c in columns if list(columns).count(c) > 1})
    if twice:
        raise FusionDataError(f"{context}: duplicate columns {', '.join(twice)}")


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def _check_id_column(df: DataFrame, column: str, context: str, error: type[DataContractError]) -> None:
    if column not in df.columns:
        raise error(f"{context}: no column {column!r}")
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise error(f"{context}: {column!r} must be text")


def _name_ids(ids: DataFrame, what: str, error: type[DataContractError]) -> None:
    """Raises an error that names the first few of ``ids``."""
    first = [r[0] for r in ids.orderBy(ids.columns[0]).limit(_SHOWN).collect()]
    raise error(f"{what}: {shown(first, ids.count())}")


def check_ids(df: DataFrame, column: str, context: str, error: type[DataContractError] = FusionDataError) -> None:
    """The id column exists, is text, and every id is non-blank and unique (one pass)."""
    _check_id_column(df, column, context, error)
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    found = per.agg(F.count_if(_blank(column)).alias("blank"), F.count_if(F.col("_n") > 1).alias("twice")).first()
    if found["blank"]:
        raise error(f"{context}: blank {column!r}")
    if found["twice"]:
        _name_ids(per.filter("_n > 1").select(column), f"{context}: duplicate ids", error)


def check_manifest(manifest: DataFrame) -> DataFrame:
    """file_id, label (0/1), fold of a valid manifest, checked in one pass; FusionDataError otherwise."""
    reject_duplicate_columns(manifest.columns, "manifest")
    for c in FUSION_MANIFEST:
        if c not in manifest.columns:
            raise FusionDataError(f"manifest: no column {c!r}")
    _check_id_column(manifest, "file_id", "manifest", FusionDataError)
    is_text = isinstance(manifest.schema["fold"].dataType, T.StringType)
    no_fold = _blank("fold") if is_text else F.col("fold").isNull()
    bad_type = isinstance(manifest.schema["label"].dataType, T.BooleanType)
    coded = manifest.withColumn("_label", F.lit(None).cast("tinyint") if bad_type else label_code("label"))
    per = coded.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(no_fold).alias("_f"), F.count_if(F.col("_label").isNull()).alias("_l"))
    found = per.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_blank("file_id")).alias("blank"), F.count_if(F.col("_n") > 1).alias("twice"), F.sum("_f").alias("folds"), F.sum("_l").alias("labels")
    ).first()
    if not found["n"]:
        raise FusionDataError("manifest: no rows")
    if found["blank"]:
        raise FusionDataError("manifest: blank 'file_id'")
    if found["twice"]:
        _name_ids(per.filter("_n > 1").select("file_id"), "manifest: duplicate ids", FusionDataError)
    if found["folds"]:
        raise FusionDataError(f"manifest: {found['folds']} blank folds")
    if found["labels"]:
        raise FusionDataError(f"manifest: {found['labels']} unknown labels")
    return coded.select("file_id", F.col("_label").alias("label"), "fold", *[c for c in manifest.columns if c == "_ord"])


def check_feature_source(source: DataFrame, name: str, manifest: DataFrame, taken: Iterable[str]) -> list[str]:
    """Feature columns of a source that fits the manifest one to one; FusionDataError otherwise.

    Coverage, uniqueness and finiteness come from one outer join of ids; ids are
    looked up again only to be named in an error.
    """
    reject_duplicate_columns(source.columns, name)
    _check_id_column(source, "file_id", name, FusionDataError)
    owned = sorted({"label", "fold"} & set(source.columns))
    if owned:
        raise FusionDataError(f"{name}: columns of the manifest {', '.join(owned)}")
    features = [c for c in source.columns if c != "file_id"]
    if not features:
        raise FusionDataError(f"{name}: no features")
    clash = sorted(set(features) & set(taken))
    if clash:
        raise FusionDataError(f"{name}: features already taken {', '.join(clash)}")
    text = [c for c in features if not isinstance(source.schema[c].dataType, T.NumericType)]
    if text:
        raise FusionDataError(f"{name}: not numeric {', '.join(text)}")
    bad = [F.count_if(not_finite(c)).alias(f"_b{i}") for i, c in enumerate(features)]
    have = source.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"), *bad)
    both = manifest.select("file_id", F.lit(1).alias("_m")).join(have, "file_id", "full_outer")
    found = both.agg(
        F.count_if(F.col("_n").isNotNull() & _blank("file_id")).alias("blank"), F.count_if(F.col("_n") > 1).alias("twice"), F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_m").isNull()).alias("unknown"), *[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(features))],
    ).first()
    if found["blank"]:
        raise FusionDataError(f"{name}: blank 'file_id'")
    for what, rows in (("twice", "_n > 1"), ("missing", "_n IS NULL"), ("unknown", "_m IS NULL")):
        if found[what]:
            _name_ids(both.filter(rows).select("file_id"), f"{name}: {'duplicate' if what == 'twice' else what} ids", FusionDataError)
    wrong = [c for i, c in enumerate(features) if found[f"_b{i}"]]
    if wrong:
        raise FusionDataError(f"{name}: not finite {', '.join(wrong)}")
    return features


def check_scores(df: DataFrame, id_column: str = "id", score_column: str = "score") -> DataFrame:
    """(id, score) of a valid prediction table read as text; ScoreTableError otherwise."""
    rows = df.select(F.trim(F.col(id_column).cast("string")).alias("id"), F.col(score_column).cast("string").try_cast("double").alias("score"))
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("blank"), F.count_if(not_finite("score")).alias("bad")
    ).first()
    if not found["n"]:
        raise ScoreTableError("no predictions")
    if found["blank"]:
        raise ScoreTableError("blank prediction id")
    if found["bad"]:
        raise ScoreTableError(f"{found['bad']} scores are not finite numbers")
    check_ids(rows, "id", "predictions", ScoreTableError)
    return rows


def check_labels(df: DataFrame, id_column: str = "id", label_column: str = "label") -> DataFrame:
    """(id, label) of a valid label table, label exactly bonafide or spoof; ScoreTableError otherwise."""
    rows = df.select(F.trim(F.col(id_column).cast("string")).alias("id"), F.trim(F.col(label_column).cast("string")).alias("label"))
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("blank"),
        F.count_if(~F.coalesce(F.col("label").isin(BONAFIDE, SPOOF), F.lit(False))).alias("bad"),
    ).first()
    if not found["n"]:
        raise ScoreTableError("no labels")
    if found["blank"]:
        raise ScoreTableError("blank label id")
    if found["bad"]:
        raise ScoreTableError(f"{found['bad']} labels are neither {BONAFIDE} nor {SPOOF}")
    check_ids(rows, "id", "labels", ScoreTableError)
    return rows


def check_window_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """The same rows; InferenceError if a score is not a finite number in 0..1 (nothing is clipped)."""
    bad = df.filter(not_finite(score) | (F.col(score) < 0) | (F.col(score) > 1)).limit(1).count()
    if bad:
        raise InferenceError("a window score is not in 0..1")
    return df


def asserted_score(score: str = "score") -> Column:
    """The score, checked row by row as it is used: a lazy form of ``check_window_scores``."""
    c = F.col(score).cast("double")
    return F.when(~(not_finite(c) | (c < 0) | (c > 1)), c).otherwise(F.raise_error(F.lit("a score is not in 0..1")).cast("double"))


def clipped(score: str | Column) -> Column:
    """The score within 0..1."""
    c = F.col(score) if isinstance(score, str) else score
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def check_cv_table(df: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """Feature columns of a table fit for cross validation; FusionDataError otherwise."""
    check_ids(df, "file_id", "feature table")
    for c in ("label", "fold"):
        if c not in df.columns:
            raise FusionDataError(f"feature table: no column {c!r}")
    chosen = list(features) if features is not None else [c for c in df.columns if c not in (*FUSION_MANIFEST, "_ord")]
    if not chosen:
        raise FusionDataError("no features")
    if len(set(chosen)) != len(chosen):
        raise FusionDataError("a feature is chosen twice")
    for c in chosen:
        if c in FUSION_MANIFEST:
            raise FusionDataError(f"{c!r} is no feature")
        if c not in df.columns:
            raise FusionDataError(f"unknown feature {c!r}")
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise FusionDataError(f"feature {c!r} is not numeric")
    found = df.agg(
        F.count_if(F.col("label") == 0).alias("_0"), F.count_if(F.col("label") == 1).alias("_1"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("fold").isNull()).alias("_f"), *[F.count_if(not_finite(c)).alias(c) for c in chosen],
    ).first().asDict()
    if found["_0"] + found["_1"] != found["_n"]:
        raise FusionDataError("labels must be 0 or 1")
    if not found["_0"] or not found["_1"]:
        raise FusionDataError("both classes are required")
    if found["_f"]:
        raise FusionDataError("blank fold")
    wrong = [c for c in chosen if found[c]]
    if wrong:
        raise FusionDataError(f"not finite: {', '.join(wrong)}")
    return chosen


def valid_waveform(samples: str | Column, rate: str | Column | None = None, expected: int = 16_000, seconds: float = 0.0, silent: bool = True) -> Column:
    """Whether a waveform is non-empty, finite, long enough, at the expected rate and, unless ``silent``, not all zero."""
    x = F.col(samples) if isinstance(samples, str) else samples
    ok = x.isNotNull() & (F.size(x) > 0) & (F.size(x) >= seconds * expected)
    ok = ok & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    if rate is not None:
        ok = ok & ((F.col(rate) if isinstance(rate, str) else rate) == expected)
    if not silent:
        ok = ok & F.exists(x, lambda v: v != 0)
    return F.coalesce(ok, F.lit(False))
