"""The subpackage's queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, media, mixing, packing, quality, search, sharding, simhash, substrings, toxicity
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes the sources to weights rows ** 0.5."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 as a query against all documents."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, search.every_hundredth(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mixing, op2_media, op3_simhash, op4_toxicity, op5_licenses, op6_sharding, op7_repeats, op8_search, op9_packing, op10_quality,
    )
}

#: DuckDB SQL for the queries that SQL expresses; the others are tested against brute force in tests/llm:
#: SQL has no XXH64 or CRC-32, no tokenizer, compressor or image format, and fits no model.
ORACLES: dict[str, str] = {
    "op7_repeats": """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT r, h, unnest(generate_series(0, len(h) // 2 - 400)) AS p FROM d WHERE len(h) >= 800)),
    x AS (SELECT r, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
    g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM x),
    i AS (SELECT r, s, min(p) AS a, max(p) + 400 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS s FROM g) GROUP BY r, s),
    k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM i)
    SELECT any_value(d.doc_id) AS doc_id, any_value(len(h) // 2) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
        sha256(unhex(coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') || substr(any_value(h), CAST(2 * coalesce(max(b), 0) + 1 AS BIGINT)))) AS kept_sha256
    FROM d LEFT JOIN k ON k.r = d.r GROUP BY d.r""",
    "op8_search": search.ORACLE,
}
