import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.errors import AnalysisError, DataContractError, FusionDataError, InferenceError, ScoreTableError
from resona.operators import aggregate, joins, sampling, validate, windows
from resona.sources import paths


@pytest.mark.parametrize("seconds, many, last", [(2, 1, 0.0), (5, 1, 0.0), (5.5, 2, 0.5), (7, 5, 2.0), (7.2, 6, 2.2), (20, 31, 15.0)])
def test_window_starts(spark, seconds, many, last):
    df = spark.createDataFrame([("a", int(seconds * 16_000))], "file_id string, n_samples long")
    rows = windows.windows(df).orderBy("window_idx").collect()
    assert len(rows) == many and rows[-1].start == pytest.approx(last) and rows[-1].end == pytest.approx(seconds if seconds > 5 else min(5, seconds))


def test_short_windows_repeat(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<float>")
    row = df.select(
        windows.window_samples(F.col("x"), F.lit(0), 7).alias("w"), windows.fit_length(F.col("x"), 5).alias("z"), windows.fit_length(F.col("x"), 2).alias("c"), windows.repeat_to(F.col("x"), 4).alias("r")
    ).first()
    assert row.w == [1, 2, 3, 1, 2, 3, 1] and row.z == [1, 2, 3, 0, 0] and row.c == [1, 2] and row.r == [1, 2, 3, 1]


def test_window_summary(spark):
    df = spark.createDataFrame([("a", s) for s in (0.1, 0.2, 0.8, 0.9)], "file_id string, score double")
    row = aggregate.window_summary(df, threshold=0.5).first()
    assert (row["mean"], row["max"], row["high_window_fraction"], row["n_windows"]) == (pytest.approx(0.5), 0.9, 0.5, 4)
    assert row["top3_mean"] == pytest.approx(1.9 / 3) and row["p90"] == pytest.approx(0.87)
    assert aggregate.top3_mean(df, "file_id").first().top3_mean == pytest.approx(1.9 / 3)


def test_local_features(spark):
    scores = [0.1] * 14 + [0.8, 0.9] + [0.95] * 14
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(scores)], "f string, i int, score double")
    row = aggregate.local_score_features(df, "f", ["i"]).first()
    assert [row[c] for c in ("local_max", "local_min", "local_range", "local_max_jump", "local_p90")] == pytest.approx([0.95, 0.1, 0.85, 0.7, 0.95])


def test_distributions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "label string, x double")
    rows = {r.label: r for r in aggregate.distributions(df, "label", ["x"]).collect()}
    assert rows["a"]["std"] == 1.0 and rows["a"]["median"] == 2.0 and rows[None]["n"] == 1
    with pytest.raises(AnalysisError):
        aggregate.assert_finite(spark.createDataFrame([(float("nan"),)], "x double"), ["x"])


def test_jump_rule_matches_a_loop(spark):
    from resona.functions.mains import jumps

    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(0, 0.02, 80))
    x[40] += 1.0
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "g string, i int, v double")
    got = [r.i for r in windows.jump_flags(df, "g", ["i"], "v").filter("flag").orderBy("i").collect()]
    assert got == jumps(x) and 40 in got


MANIFEST = [("a.wav", "0", 2), ("b.wav", "1", 2), ("c.wav", "real", 5), ("d.wav", " Synthetic", 5)]


def manifest(spark, rows=MANIFEST):
    return spark.createDataFrame(rows, "file_id string, label string, fold int")


def source(spark, ids="dcba", **kw):
    return spark.createDataFrame([(f"{i}.wav", float(ord(i))) for i in ids], "file_id string, x double")


def test_feature_table(spark):
    more = source(spark).withColumnRenamed("x", "y")
    rows = joins.build_feature_table(manifest(spark), {"s": source(spark), "t": more}).orderBy("file_id").collect()
    assert [(r.file_id, r.label, r.x, r.y) for r in rows] == [("a.wav", 0, 97, 97), ("b.wav", 1, 98, 98), ("c.wav", 0, 99, 99), ("d.wav", 1, 100, 100)]


@pytest.mark.parametrize("ids", ["abc", "abcde", "abcdd"])
def test_feature_source_must_cover(spark, ids):
    with pytest.raises(FusionDataError):
        joins.build_feature_table(manifest(spark), {"s": source(spark, ids)})


def test_feature_source_rejects(spark):
    bad = [
        source(spark).withColumn("x", F.lit(float("nan"))), source(spark).withColumn("x", F.lit(float("inf"))), source(spark).withColumn("x", F.lit("t")),
        source(spark).withColumn("label", F.lit(1)), source(spark).select("file_id"), source(spark).select("file_id", "x", F.col("x").alias("x")),
    ]
    for b in bad:
        with pytest.raises(FusionDataError):
            joins.build_feature_table(manifest(spark), {"s": b})
    with pytest.raises(FusionDataError):
        joins.build_feature_table(manifest(spark), {"s": source(spark), "t": source(spark)})


def test_manifest_rejects(spark):
    for rows in ([("a", "odd", 1)], [("a", "0", None)], [("", "0", 1)], [("a", "0", 1), ("a", "1", 1)], []):
        with pytest.raises(FusionDataError):
            validate.check_manifest(manifest(spark, rows))
    with pytest.raises(FusionDataError):
        validate.check_manifest(spark.createDataFrame([("a", True, 1)], "file_id string, label boolean, fold int"))


def test_strict_prediction_join(spark):
    labels = validate.check_labels(spark.createDataFrame([("b", "bonafide"), ("a", "spoof")], "id string, label string"))
    good = validate.check_scores(spark.createDataFrame([("a", ".9"), ("b", ".1")], "id string, score string"))
    assert {r.id: r.score for r in joins.join_predictions(labels, good).collect()} == {"a": 0.9, "b": 0.1}
    extra = validate.check_scores(spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "0")], "id string, score string"))
    with pytest.raises(ScoreTableError):
        joins.join_predictions(labels, extra)
    assert joins.join_predictions(labels, extra, allow_extra=True).count() == 2
    with pytest.raises(ScoreTableError):
        joins.join_predictions(labels, good.filter("id = 'a'"))
    for bad in ([("a", "nan")], [("a", "inf")], [("a", "x")], [("a", "1"), ("a", "2")], [(" ", "1")], []):
        with pytest.raises(ScoreTableError):
            validate.check_scores(spark.createDataFrame(bad, "id string, score string"))


def test_blend_and_append(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.2)], "filename string, score double")
    b = spark.createDataFrame([("x", 1.0)], "filename string, score double")
    assert {r.filename: r.score for r in joins.blend(a, b).collect()} == {"x": pytest.approx(0.65), "y": 0.2}
    old = spark.createDataFrame([("p", 1)], "path string, v int")
    new = spark.createDataFrame([("p", 2), ("q", 3)], "path string, v int")
    assert sorted(map(tuple, joins.append_new(old, new).collect())) == [("p", 1), ("q", 3)]


def test_window_scores_are_never_clipped(spark):
    for bad in (float("nan"), -0.01, 1.01, None):
        with pytest.raises(InferenceError):
            validate.check_window_scores(spark.createDataFrame([(bad,)], "score double"))
    with pytest.raises(Exception, match="0..1"):
        spark.createDataFrame([(1.5,)], "score double").select(validate.asserted_score()).collect()


def test_folds_and_samples(spark):
    rows = spark.range(200).withColumnRenamed("id", "path")
    sizes = [r["count"] for r in sampling.assign_folds(rows, "path").groupBy("fold").count().collect()]
    assert sizes == [20] * 10
    exact = sampling.assign_folds(rows, "path", exact=True, order=["path"])
    assert sorted(r["count"] for r in exact.groupBy("fold").count().collect()) == [20] * 10
    import random

    want = sorted(random.Random(42).sample(range(200), 17))
    assert sorted(r.path for r in sampling.exact_sample(rows, ["path"], 17).collect()) == want
    groups = spark.createDataFrame([(g, f"{g}{i}") for g in "abc" for i in range(10)], "g string, k string")
    assert {r.g: r["count"] for r in sampling.capped_per_group(groups, "g", "k", 11).groupBy("g").count().collect()} == {"a": 4, "b": 4, "c": 3}
    with pytest.raises(DataContractError):
        sampling.split_by_fold(spark.createDataFrame([(None,)], "fold int"), 0)


def test_paths(spark):
    df = spark.createDataFrame([("C:\\Corpus\\gen\\Speaker 1\\a.b.WAV",)], "p string")
    row = df.select(paths.remap("p", "c:/corpus/", "/data/").alias("r")).select("r", paths.basename("r").alias("b"), paths.stem("r").alias("s"), paths.suffix("r").alias("x"), paths.parent("r").alias("u")).first()
    assert tuple(row) == ("/data/gen/Speaker 1/a.b.WAV", "a.b.WAV", "a.b", ".wav", "Speaker 1")


def test_finite_or_null(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(validate.finite_or_null("v")).collect()] == [1.5, None, None, None, None]
    w = spark.createDataFrame([([0.1, 0.2], 16_000), ([0.0, 0.0], 16_000), ([float("nan")], 16_000), ([0.1], 8_000), ([], 16_000)], "x array<double>, r int")
    assert [r[0] for r in w.select(validate.valid_waveform("x", "r", silent=False)).collect()] == [True, False, False, False, False]
