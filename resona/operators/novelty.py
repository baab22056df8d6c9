"""Novelty of embedding sequences: the relational form and the per-file form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _let(value, body):
    """``body`` of a value that is worked out once, not once for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(e):
    """The vector over its Euclidean length, scaled by its largest component first."""
    top = F.array_max(F.transform(e, lambda x: F.abs(x)))
    scaled = _let(top, lambda t: F.transform(e, lambda x: x / t))
    return _let(scaled, lambda s: _let(F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(s, lambda x: x / n)))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def kernel(scale: int) -> list[tuple[int, int, float]]:
    """(row, column, weight) of the checkerboard kernel: Gaussian weights, each sign's sum brought to one."""
    spread = max(scale / 2.0, 0.5)
    at = [i - scale + 0.5 for i in range(2 * scale)]
    bell = [math.exp(-0.5 * (x / spread) ** 2) for x in at]
    cells = [(i, j, bell[i] * bell[j] * (1 if (at[i] < 0) == (at[j] < 0) else -1)) for i in range(2 * scale) for j in range(2 * scale)]
    plus = sum(v for *_, v in cells if v > 0)
    minus = -sum(v for *_, v in cells if v < 0)
    return [(i, j, v / plus if v > 0 else v / minus) for i, j, v in cells]


def band_pairs(frames: DataFrame, group: str, index: str, vector: str, reach: int) -> DataFrame:
    """Cosine similarity (sim) of frames i <= j fewer than ``reach`` apart.

    Each frame offers itself to the places it can meet, so the range join is an
    equi-join on (group, place) and grows with n * reach.
    """
    normal = frames.select(group, F.col(index).alias("i"), unit(F.col(vector)).alias("u"))
    offered = normal.select(group, F.col("i").alias("j"), F.col("u").alias("w"), F.explode(F.sequence(F.col("i") - (reach - 1), F.col("i"))).alias("i"))
    sim = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("u"), F.col("w")))))
    return normal.join(offered, [group, "i"]).select(group, "i", "j", sim.alias("sim"))


def curves(frames: DataFrame, group: str, index: str, vector: str, scales: Sequence[int] = (2, 4)) -> DataFrame:
    """(group, scale, b, novelty) for every boundary b with a whole kernel around it."""
    spark = frames.sparkSession
    reach = 2 * max(scales)
    cells = [(s, i, j, v) for s in scales for i, j, v in kernel(s)]
    table = spark.createDataFrame(cells, "scale int, ki int, kj int, weight double")  # (2 * scale)**2 rows a scale
    pairs = band_pairs(frames, group, index, vector, reach)
    both = pairs.unionByName(pairs.filter("i < j").select(group, F.col("j").alias("i"), F.col("i").alias("j"), "sim"))
    met = both.join(F.broadcast(table), F.col("j") - F.col("i") == F.col("kj") - F.col("ki"))
    sizes = frames.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sums = met.groupBy(group, "scale", (F.col("i") - F.col("ki") + F.col("scale")).cast("int").alias("b")).agg(F.sum(F.col("sim") * F.col("weight")).alias("v"))
    return sums.join(sizes, group).filter("b >= scale AND b <= n - scale").select(group, "scale", "b", F.greatest(F.lit(0.0), F.col("v")).alias("novelty"))


def combined(curve: DataFrame, group: str) -> DataFrame:
    """Largest novelty of each boundary over the scales, and the first scale that has it."""
    best = F.min(F.struct((-F.col("novelty")).alias("minus"), "scale")).alias("x")
    return curve.groupBy(group, "b").agg(best).select(group, "b", (-F.col("x.minus")).alias("novelty"), F.col("x.scale").alias("scale"))


def summary(boundaries: DataFrame, group: str) -> DataFrame:
    """max, mean of the top three, 95th percentile, and the first strongest boundary."""
    w = Window.partitionBy(group).orderBy(F.desc("novelty"), "b")
    ranked = boundaries.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy(group).agg(
        F.max("novelty").alias("novelty_max"),
        F.avg(F.when(F.col("_rank") <= 3, F.col("novelty"))).alias("novelty_top3_mean"),
        F.percentile("novelty", F.lit(0.95)).alias("novelty_p95"),
        F.min(F.when(F.col("_rank") == 1, F.col("b"))).alias("strongest"),
    )
