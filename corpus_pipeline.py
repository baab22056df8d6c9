"""From raw documents to packed training sequences.

STAGES run in order; each takes (spark, docs, sf_dir), and its result is
written as Parquet to the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resona.llm import mixing, packing, quality, simhash, substrings
from resona.llm.common import Stored, release, table
from resona.runtime import prepare

#: Target weight of each source for the mix and for the order of the sequences; None: rows ** 0.5.
WEIGHTS: dict[str, float] | None = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; the labels come from ``sf_dir``."""
    prepare(spark)
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    prepare(spark)
    return simhash.one_of_each(docs, simhash.copies(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that start anywhere else too."""
    prepare(spark)
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents laid out in the order of the Pfair mix."""
    prepare(spark)
    return mixing.mixed_documents(docs, WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where it stands in which training sequence; sequences follow the mix.

    A table keeps no order of rows, so a row's place in the mix is derived again.
    """
    prepare(spark)
    return packing.pack_mixed(docs, WEIGHTS)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the fitted classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stored = Stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            before.drop()
        docs, before = stored.df, stored
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
