"""Connected components of a link table by alternating large and small stars.

Nodes are longs.  Each round hangs every node on the smallest node it sees;
rounds end when the table no longer changes.  A round is two aggregations with
partial sums and two equi-joins whose hot side Spark can split, and its result
is written to the shared folder, so neither links nor labels reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(u, v): one star step; the result has u > v."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("c", "m").alias("m"))
    hung = both.join(least, both["u"] == least["c"])
    if large:
        moved = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("c").alias("u"), F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node that occurs in links(u, v); root is the smallest node reachable."""
    spark = links.sparkSession
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = Stored(down, name)
    mark = None
    while True:
        stepped = Stored(_star(_star(now.df, large=True), large=False), name)
        now.drop()
        now = stepped
        # a fixed point of both stars is a forest of stars: compare two order-free digests
        row = now.df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("d"),
            F.sum(F.xxhash64("v", F.lit(1), "u").cast("decimal(38,0)")).alias("e"),
        ).first()
        release(spark)
        if mark == tuple(row):
            break
        mark = tuple(row)
    leaves = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.unionByName(roots)
