"""Labelled rows for the classifiers: folds by document id, bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str | Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; a null id belongs to the fold of ''."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text, label of the labelled rows outside the held-out fold.

    At most about ``most`` rows, taken by a hash of the id, so that a model sees
    a bounded sample whatever the number of labels.  Null labels and
    contradictory labels of an id are left out; null text counts as empty; of
    the rows that share an id, one text is taken.
    """
    sure = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(fold("doc_id", folds) != held_out)
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_most")).filter("label = _most").drop("_most")
    )
    n = sure.count()
    if n > most:
        share = int(most / n * (1 << 30))
        sure = sure.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < share)
    # at most `most` ids: rows of fixed size, so the bound of the sample bounds the broadcast
    ids = sure.select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.min("label").alias("label")).select("doc_id", "t.text", "label")
