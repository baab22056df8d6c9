"""Summaries of window scores, features and signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..schema import HIGH_SCORE
from .metrics import running_counts


def top3_mean(scores: DataFrame, group: str | Sequence[str], score: str = "score") -> DataFrame:
    """Mean of each group's three largest scores, or of all where there are fewer.

    The rank's bound lets every map task pass on three rows of a group at most.
    """
    keys = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    best = scores.select(*keys, score).withColumn("_rank", F.row_number().over(w)).filter("_rank <= 3")
    return best.groupBy(*keys).agg(F.avg(score).alias("top3_mean"))


def running_values(rows: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values s of each group with their count nb, the count cb up to them and the total tb.

    Equal values meet in partial sums and the counts run in two phases, so no
    group's values meet in one task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("s"))
    return running_counts(counts.agg(F.count(F.lit(1)).alias("nb"), F.lit(0).cast("long").alias("ns")), groups)


def percentile_of(share: float) -> Column:
    """The exact percentile of ``running_values``, as an aggregate: linear between the two values around its place."""
    place = F.lit(share) * (F.col("tb") - 1)
    at = lambda rank: F.min(F.when(F.col("cb") > rank, F.col("s")))  # noqa: E731  the value at a 0-based rank
    part = F.max(place - F.floor(place))
    below, above = at(F.floor(place)), at(F.ceil(place))
    return F.when(below == above, below).otherwise((1 - part) * below + part * above)


def window_summary(scores: DataFrame, group: str | Sequence[str] = "file_id", score: str = "score", threshold: float = HIGH_SCORE) -> DataFrame:
    """Mean, maximum, mean of the top three, 90th percentile and share of high windows per file.

    The top three come from a rank, so no group's scores are gathered in a list.
    """
    keys = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    ranked = scores.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(
        F.avg(score).alias("mean"),
        F.max(score).alias("max"),
        F.avg(F.when(F.col("_rank") <= 3, F.col(score))).alias("top3_mean"),
        F.percentile(score, F.lit(0.9)).alias("p90"),
        F.avg((F.col(score) >= threshold).cast("double")).alias("high_window_fraction"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def verdict(score: Column, threshold: float = HIGH_SCORE) -> Column:
    """FAKE at and above the threshold, else REAL."""
    return F.when(score >= threshold, F.lit("FAKE")).otherwise(F.lit("REAL"))


def distributions(rows: DataFrame, label: str, features: Sequence[str], order: str | None = None) -> DataFrame:
    """n, mean, std (population), min, median, p95, max of each feature by label.

    Null labels are a group of their own.  With ``order``, column ``_first``
    holds each label's first place.  A null or non-finite feature raises AnalysisError.
    """
    long = rows.unpivot([label, *([order] if order else [])], list(features), "feature", "value")
    first = [F.min(order).alias("_first")] if order else []
    moments = long.groupBy(label, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), *first
    )
    places = running_values(long, "value", [label, "feature"]).groupBy(F.col(label).alias("_label"), F.col("feature").alias("_feature"))
    places = places.agg(percentile_of(0.5).alias("median"), percentile_of(0.95).alias("p95"))
    both = moments.join(places, F.col(label).eqNullSafe(F.col("_label")) & (F.col("feature") == F.col("_feature")), "left")
    return both.select(label, "feature", "n", "mean", "std", "min", "median", "p95", "max", *(["_first"] if order else []))


def assert_finite(rows: DataFrame, columns: Sequence[str]) -> None:
    """Raises AnalysisError if any value is null, NaN or infinite."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns]
    found = rows.agg(*bad).first().asDict()
    wrong = sorted(c for c, n in found.items() if n)
    if wrong:
        raise AnalysisError(f"not finite: {', '.join(wrong)}")


def local_score_features(scores: DataFrame, group: str, order: Sequence[str], score: str = "score") -> DataFrame:
    """max, min, range, largest step and 90th percentile of an ordered score sequence."""
    w = Window.partitionBy(group).orderBy(*order)
    steps = scores.withColumn("_step", F.abs(F.col(score) - F.lag(score).over(w)))
    return steps.groupBy(group).agg(
        F.max(score).alias("local_max"),
        F.min(score).alias("local_min"),
        (F.max(score) - F.min(score)).alias("local_range"),
        F.coalesce(F.max("_step"), F.lit(0.0)).alias("local_max_jump"),
        F.percentile(score, F.lit(0.9)).alias("local_p90"),
    )


def top_windows(scores: DataFrame, group: str, start: str, score: str = "score", k: int = 10) -> DataFrame:
    """The k highest windows of each file, ties by earlier start, with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(score), start)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def score_stats(scores: DataFrame, score: str = "score", middle: float = 0.5) -> DataFrame:
    """min, max, median, mean, and counts above and below the middle, from counts per distinct score."""
    n = F.col("nb")
    return running_values(scores, score).agg(
        F.min("s").alias("min"), F.max("s").alias("max"), percentile_of(0.5).alias("median"), (F.sum(F.col("s") * n) / F.sum(n)).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("s") > middle, n)), F.lit(0)).alias("above"), F.coalesce(F.sum(F.when(F.col("s") < middle, n)), F.lit(0)).alias("below"),
    )


def masked_mean_std(rows: DataFrame, group: Sequence[str], value: str, mask: str | None = None) -> DataFrame:
    """Mean, and root of the population variance plus 1e-8, over the rows the mask keeps."""
    kept = rows.filter(mask) if mask else rows
    return kept.groupBy(*group).agg(F.avg(value).alias("mean"), F.sqrt(F.var_pop(value) + F.lit(1e-8)).alias("std"))


def stability(rows: DataFrame, group: str, value: str, least: float = 0.005, most: float = 0.08) -> DataFrame:
    """Population deviation of a trace and whether it is too_stable, too_erratic or plausible."""
    out = rows.groupBy(group).agg(F.stddev_pop(value).alias("std"))
    return out.withColumn("verdict", F.when(F.col("std") < least, "too_stable").when(F.col("std") > most, "too_erratic").otherwise("plausible"))


def importance(gains: DataFrame) -> DataFrame:
    """(feature, fold, gain) to mean and total gain, best first, ties by name."""
    return gains.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.sum("gain").alias("total_gain")).orderBy(F.desc("mean_gain"), "feature")


def centroid(rows: DataFrame, group: Sequence[str], frequency: str, energy: str) -> DataFrame:
    """Energy-weighted mean frequency."""
    return rows.groupBy(*group).agg((F.sum(F.col(frequency) * F.col(energy)) / (F.sum(energy) + F.lit(1e-12))).alias("centroid"))
