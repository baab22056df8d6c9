"""Detection metrics on score tables of any length.

Curves are built from counts per distinct score, so equal scores meet first in
partial sums.  Cumulative counts use two phases: ranges of scores are summed
side by side, and each range adds the totals of the ranges below it; nothing
is sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MetricError
from ..schema import C_FA, C_MISS, P_SPOOF

#: Ranges of scores that a cumulative sum is cut into at least; more where a shuffle has more partitions.
RANGES = 32


def distinct_scores(rows: DataFrame, score: str, is_spoof: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts of bona fide (nb) and spoof (ns) rows per distinct score s."""
    s = F.col(score).cast("double")
    return rows.groupBy(*groups, s.alias("s")).agg(
        F.sum(F.when(F.col(is_spoof).cast("int") == 0, 1).otherwise(0)).alias("nb"),
        F.sum(F.when(F.col(is_spoof).cast("int") == 1, 1).otherwise(0)).alias("ns"),
    )


def running_counts(counts: DataFrame, groups: Sequence[str] = (), descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds cb, cs (counts up to and including s) and tb, ts (totals) per group.

    Two-phase prefix sum: the cuts come from an approximate quantile sketch and
    decide only how work is dealt out, not the result.
    """
    ranges = ranges or max(RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = counts.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    if cuts:
        array = F.array(*[F.lit(float(c)) for c in cuts])
        part = F.size(F.filter(array, lambda c: c < F.col("s")))
    else:
        part = F.lit(0)
    dealt = counts.withColumn("_part", part)
    keys = list(groups)
    direction = F.desc if descending else F.asc
    totals = dealt.groupBy(*keys, "_part").agg(F.sum("nb").alias("_pb"), F.sum("ns").alias("_ps"))
    below = Window.partitionBy(*keys).orderBy(direction("_part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_pb").over(below), F.lit(0)).alias("_ob"), F.coalesce(F.sum("_ps").over(below), F.lit(0)).alias("_os"),
        F.sum("_pb").over(whole).alias("tb"), F.sum("_ps").over(whole).alias("ts"),
    )
    upto = Window.partitionBy(*keys, "_part").orderBy(direction("s")).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumns({"_ib": F.sum("nb").over(upto), "_is": F.sum("ns").over(upto)})
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    joined = inside.join(offsets, match)
    return joined.select(*keys, "s", "nb", "ns", (F.col("_ib") + F.col("_ob")).alias("cb"), (F.col("_is") + F.col("_os")).alias("cs"), "tb", "ts")


def _cost(p_spoof: float, c_miss: float, c_fa: float) -> tuple[Column, float]:
    target = 1.0 - p_spoof
    cost = F.lit(c_miss) * F.col("p_miss") * F.lit(target) + F.lit(c_fa) * F.col("p_fa") * F.lit(1.0 - target)
    return cost, min(c_miss * target, c_fa * (1.0 - target))


def min_dcf(
    rows: DataFrame, score: str, is_spoof: str, groups: Sequence[str] = (), p_spoof: float = P_SPOOF, c_miss: float = C_MISS, c_fa: float = C_FA
) -> DataFrame:
    """Least normalised detection cost and the threshold where it is reached, per group.

    Scores rise with the chance of spoof.  The curve starts where nothing is
    missed; among equal costs the highest threshold wins.  A group without both
    classes gets no row.
    """
    for name, value, top in (("p_spoof", p_spoof, 1.0), ("c_miss", c_miss, None), ("c_fa", c_fa, None)):
        if not 0 < value < (top or float("inf")):
            raise MetricError(f"{name} out of range: {value}")
    keys = list(groups)
    run = running_counts(distinct_scores(rows, score, is_spoof, keys), keys, descending=True).filter("tb > 0 AND ts > 0")
    tb, ts, s = F.col("tb").cast("double"), F.col("ts").cast("double"), F.col("s")
    own = F.struct(s.alias("threshold"), (F.col("cb") / tb).alias("p_miss"), ((F.col("ts") - F.col("cs")) / ts).alias("p_fa"), (-s).alias("_at"))
    # the curve starts above the highest score: that row gives two points
    start = F.struct((s + F.lit(0.001)).alias("threshold"), F.lit(0.0).alias("p_miss"), F.lit(1.0).alias("p_fa"), (-s - F.lit(0.001)).alias("_at"))
    highest = F.col("cb") + F.col("cs") == F.col("nb") + F.col("ns")
    points = run.select(*keys, "tb", "ts", F.explode(F.when(highest, F.array(start, own)).otherwise(F.array(own))).alias("p")).select(*keys, "tb", "ts", "p.*")
    cost, norm = _cost(p_spoof, c_miss, c_fa)
    both = points.withColumn("cost", cost)
    best = F.min(F.struct("cost", "_at", "threshold", "p_miss", "p_fa")).alias("b")
    out = both.groupBy(*keys).agg(best, F.first("tb").alias("n_bonafide"), F.first("ts").alias("n_spoof"))
    out = out.filter("b IS NOT NULL")
    return out.select(
        *keys, (F.col("b.cost") / F.lit(norm)).alias("min_dcf"), F.col("b.threshold").alias("threshold"), F.col("b.p_miss").alias("p_miss"),
        F.col("b.p_fa").alias("p_fa"), F.col("b.cost").alias("unnormalized_cost"), "n_bonafide", "n_spoof",
    )


def evaluate_min_dcf(rows: DataFrame, score: str, is_spoof: str, **costs: float) -> DataFrame:
    """``min_dcf`` of one table, checked first: both classes, finite scores, labels 0 or 1."""
    s = F.col(score).cast("double")
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad"),
        F.count_if(F.col(is_spoof).cast("int") == 0).alias("b"),
        F.count_if(F.col(is_spoof).cast("int") == 1).alias("s"),
    ).first()
    if not found["n"]:
        raise MetricError("no scores")
    if found["bad"]:
        raise MetricError(f"{found['bad']} scores are not finite")
    if found["b"] + found["s"] != found["n"]:
        raise MetricError("labels must be bona fide or spoof")
    if not found["b"] or not found["s"]:
        raise MetricError("both classes are required")
    return min_dcf(rows, score, is_spoof, **costs)


def det_curve(rows: DataFrame, score: str, is_spoof: str) -> DataFrame:
    """All N+1 points, one per row after the first: point, p_miss, p_fa, threshold (negated score).

    Among equal scores bona fide rows come first.
    """
    run = running_counts(distinct_scores(rows, score, is_spoof), descending=True)
    before_b, before_s = F.col("cb") - F.col("nb"), F.col("cs") - F.col("ns")
    highest = before_b + before_s == 0
    each = run.select(
        "tb", "ts", F.col("s"), before_b.alias("_b"), before_s.alias("_s"), "nb",
        F.explode(F.sequence(F.when(highest, 0).otherwise(1).cast("long"), F.col("nb") + F.col("ns"))).alias("_i"),
    )
    seen_b = F.col("_b") + F.least("_i", "nb")
    seen_s = F.col("_s") + F.greatest(F.lit(0), F.col("_i") - F.col("nb"))
    start = F.col("_i") == 0  # point 0 lies above the highest score
    return each.select(
        (F.col("_b") + F.col("_s") + F.col("_i")).alias("point"), F.when(start, 0.0).otherwise(seen_b / F.col("tb").cast("double")).alias("p_miss"),
        F.when(start, 1.0).otherwise((F.col("ts") - seen_s) / F.col("ts").cast("double")).alias("p_fa"),
        F.when(start, -F.col("s") - F.lit(0.001)).otherwise(-F.col("s")).alias("threshold"),
    )


def min_dcf_of_curve(curve: DataFrame, p_spoof: float = P_SPOOF, c_miss: float = C_MISS, c_fa: float = C_FA) -> DataFrame:
    """The first least cost of a table (point, p_miss, p_fa, threshold)."""
    outside = curve.filter("p_miss < 0 OR p_miss > 1 OR p_fa < 0 OR p_fa > 1 OR p_miss IS NULL OR p_fa IS NULL").limit(1).count()
    if outside:
        raise MetricError("probabilities must be between 0 and 1")
    cost, norm = _cost(p_spoof, c_miss, c_fa)
    best = curve.withColumn("cost", cost).agg(F.min(F.struct("cost", "point", "threshold", "p_miss", "p_fa")).alias("b"))
    return best.select(
        (F.col("b.cost") / F.lit(norm)).alias("min_dcf"), F.col("b.threshold").alias("threshold"), F.col("b.p_miss").alias("p_miss"),
        F.col("b.p_fa").alias("p_fa"), F.col("b.cost").alias("unnormalized_cost"),
    )


def eer_and_dcf(rows: DataFrame, score: str, is_spoof: str, p_spoof: float = P_SPOOF, c_miss: float = 1.0, c_fa: float = 4.0) -> DataFrame:
    """Equal error rate and least cost with spoof as the target; (NaN, NaN, 0.5) without both classes."""
    run = running_counts(distinct_scores(rows, score, is_spoof)).filter("tb > 0 AND ts > 0")
    fnr = (F.col("cs") - F.col("ns")) / F.col("ts").cast("double")
    fpr = (F.col("tb") - F.col("cb") + F.col("nb")) / F.col("tb").cast("double")
    rates = run.select("s", fnr.alias("fnr"), fpr.alias("fpr"))
    dcf = F.lit(c_miss * p_spoof) * F.col("fnr") + F.lit(c_fa * (1.0 - p_spoof)) * F.col("fpr")
    norm = min(c_miss * p_spoof, c_fa * (1.0 - p_spoof))
    best = rates.agg(
        F.min(F.struct(F.abs(F.col("fnr") - F.col("fpr")).alias("gap"), "s", "fnr", "fpr")).alias("e"),
        F.min(F.struct((dcf / F.lit(norm)).alias("dcf"), "s")).alias("d"),
    )
    return best.select(
        F.coalesce((F.col("e.fnr") + F.col("e.fpr")) / 2, F.lit(float("nan"))).alias("eer"),
        F.coalesce(F.col("d.dcf"), F.lit(float("nan"))).alias("min_dcf"),
        F.coalesce(F.col("d.s"), F.lit(0.5)).alias("threshold"),
    )


def auc(rows: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at their mean rank."""
    keys = list(groups)
    run = running_counts(distinct_scores(rows, score, label, keys), keys)
    n = F.col("nb") + F.col("ns")
    mean_rank = F.col("cb") + F.col("cs") - n + (n + 1) / F.lit(2.0)
    out = run.groupBy(*keys).agg(F.sum(F.col("ns") * mean_rank).alias("_r"), F.max("tb").alias("_n0"), F.max("ts").alias("_n1"))
    value = (F.col("_r") - F.col("_n1") * (F.col("_n1") + 1) / F.lit(2.0)) / (F.col("_n1") * F.col("_n0"))
    return out.filter("_n0 > 0 AND _n1 > 0").select(*keys, value.alias("auc"))


def confusion(rows: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Counts, accuracy and error rates with label 1 predicted at and above ``cut``."""
    y, hit = F.col(label).cast("int"), F.col(score) >= cut
    out = rows.agg(
        F.count_if((y == 1) & hit).alias("tp"), F.count_if((y == 0) & hit).alias("fp"), F.count_if((y == 0) & ~hit).alias("tn"), F.count_if((y == 1) & ~hit).alias("fn")
    )
    rate = lambda a, b: F.when(b > 0, a / b.cast("double"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.select(
        "*", rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr")
    )
