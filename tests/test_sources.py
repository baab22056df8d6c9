import numpy as np
import pytest
from pyspark.sql import functions as F

from resona import cli
from resona.errors import DataContractError, FusionDataError, InferenceError, RunnerError, ScoreTableError, ServiceError, ServiceNotConfigured
from resona.operators import detectors, explain, fingerprints, learning, scoring
from resona.sources import files, manifest, sinks, tables

R = 16_000


def tone(seconds, hz=440.0, rate=R):
    return 0.3 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("audio")
    (d / "nested").mkdir()
    (d / "Alpha.wav").write_bytes(files.encode_wav(tone(6)))
    (d / "nested" / "beta.WAV").write_bytes(files.encode_wav(np.random.default_rng(0).normal(0, 0.1, 2 * R), width=3))
    (d / "zeta.wav").write_bytes(files.encode_wav(tone(1.0, rate=8_000), rate=8_000, width=1))
    (d / "notes.txt").write_text("no audio")
    return d


def test_discovery_and_decoding(spark, folder):
    found = files.discover(spark, str(folder))
    assert [r.relative for r in files.in_order(found).select("relative").collect()] == ["Alpha.wav", "nested/beta.WAV", "zeta.wav"]
    rows = {r.file_id.rsplit("/", 1)[-1]: r for r in files.decode(found).collect()}
    assert len(rows["Alpha.wav"].samples) == 6 * R and len(rows["zeta.wav"].samples) == R
    assert max(map(abs, rows["beta.WAV"].samples)) == pytest.approx(1, abs=1e-4)
    assert [r.filename for r in files.test_files(spark, str(folder)).collect()] == ["Alpha.wav", "zeta.wav"]
    fixed = files.decode(found, length=100).select(F.size("samples").alias("n")).distinct().collect()
    assert [r.n for r in fixed] == [100]


def pcm(n, seed, depth=16):
    rng = np.random.default_rng(seed)
    return (np.cumsum(rng.normal(0, 40, n)) + 3000 * np.sin(np.arange(n) / 9)).astype(np.int64).clip(-(1 << (depth - 1)), (1 << (depth - 1)) - 1)


@pytest.mark.parametrize("options", [
    {}, {"kinds": [("verbatim",), ("fixed", 0), ("fixed", 1), ("fixed", 3), ("fixed", 4)]}, {"kinds": [("lpc", [1900, -850], 10)], "k": 5}, {"kinds": [("lpc", [700, 300, -80, 20], 9)], "split": 3, "k": 0},
    {"kinds": [("fixed", 2)], "split": 2, "method": 1, "escape": 1}, {"digest": False, "k": 14}, {"depth": 24}, {"block": 33}, {"kinds": [("fixed", 1)], "k": 0},
])
def test_flac_round_trip(options):
    from tests.flac_writer import encode

    x = pcm(5000, 61)
    got, rate = files.decode_flac(encode([x], **options))
    assert rate == R and (got * (1 << (options.get("depth", 16) - 1)) == x).all()


@pytest.mark.parametrize("layout", [None, 8, 9, 10])
def test_flac_channels(layout):
    from tests.flac_writer import encode

    a, b = pcm(3000, 62), pcm(3000, 63)
    got, _ = files.decode_flac(encode([a, b], layout=layout, kinds=[("fixed", 2), ("lpc", [1800, -800], 10)]))
    assert np.allclose(got, (a + b) / 2 / 32768)


def test_flac_constants_wasted_bits_and_broken_streams():
    from tests.flac_writer import encode

    still = np.full(600, -7)
    assert (files.decode_flac(encode([still], kinds=[("constant",)]))[0] * 32768 == still).all()
    x = pcm(2000, 64) // 16 * 16
    whole = encode([x], wasted=4)
    assert (files.decode_flac(whole)[0] * 32768 == x).all()
    for broken in (whole[:200], whole[:20], whole[: len(whole) // 2], whole[:500] + bytes([whole[500] ^ 1]) + whole[501:], b"fLaC"):
        with pytest.raises(ValueError):
            files.decode_flac(broken)


def middle_decoder(content):
    return np.full(R, len(content) / 1000), R


def test_decoders_by_suffix(spark, tmp_path):
    from tests.flac_writer import encode

    (tmp_path / "a.flac").write_bytes(encode([pcm(R, 65)], block=4096))
    (tmp_path / "b.mp3").write_bytes(b"x" * 500)
    (tmp_path / "c.ogg").write_bytes(b"OggS")
    found = files.discover(spark, str(tmp_path))
    rows = {r.file_id.rsplit("/", 1)[-1]: r for r in files.decode(found, permissive=True, normalise=False, decoders={".mp3": "tests.test_sources:middle_decoder"}).collect()}
    assert len(rows["a.flac"].samples) == R and rows["b.mp3"].samples[5] == 0.5 and "no decoder for .ogg" in rows["c.ogg"].error


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_widths(width):
    x, rate = files.decode_wav(files.encode_wav(tone(0.1), width=width))
    assert rate == R and np.allclose(x, tone(0.1), atol=2.0 ** (2 - 8 * width))


def test_missing_and_empty_directories(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    for d in (tmp_path, tmp_path / "nowhere"):
        with pytest.raises(RunnerError):
            files.discover(spark, str(d))


def test_batch_to_tsv(spark, folder, tmp_path):
    out = tmp_path / "out.tsv"
    rows = scoring.score_directory(spark, str(folder), str(out)).collect()
    lines = out.read_text().split("\n")
    assert lines[0] == "filename\tcm-score" and lines[-1] == "" and [x.split("\t")[0] for x in lines[1:-1]] == ["Alpha.wav", "beta.WAV", "zeta.wav"]
    assert [x.split("\t")[1] for x in lines[1:-1]] == [format(r.score, ".10g") for r in rows]


class Broken:
    def __call__(self, batch):
        return np.full(len(batch), np.nan)


def test_nothing_is_written_on_failure(spark, folder, tmp_path):
    out = tmp_path / "out.tsv"
    with pytest.raises(Exception, match="0..1"):
        scoring.score_directory(spark, str(folder), str(out), "tests.test_sources:Broken")
    bad = spark.createDataFrame([("a", 1.5)], "filename string, score double")
    with pytest.raises(RunnerError):
        sinks.write_tsv(bad, str(out))
    assert not out.exists() and not list(tmp_path.iterdir())


def test_windows_and_file_results(spark):
    df = spark.createDataFrame([("a", R, tone(7.2).tolist()), ("b", R, tone(2).tolist())], "file_id string, sample_rate int, samples array<float>")
    rows = scoring.score_windows(df).orderBy("file_id", "window_idx").collect()
    assert [r.start for r in rows if r.file_id == "a"] == pytest.approx([0, 0.5, 1, 1.5, 2, 2.2]) and [(r.start, r.end) for r in rows if r.file_id == "b"] == [(0, 2)]
    result = {r.file_id: r for r in scoring.file_results(scoring.score_windows(df)).collect()}
    assert result["a"].n_windows == 6 and len(result["a"].windows) == 6 and result["a"].bonafide_score == pytest.approx(1 - result["a"].fake_probability)
    assert scoring.probability(np.array([0.0, 50, -50])) == pytest.approx([0.5, 0, 1])


def test_analysis_skips_bad_files(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "a")
    (tmp_path / "a" / "bad.wav").write_bytes(b"not audio")
    rows = {r.file_id.rsplit("/", 1)[-1]: r for r in scoring.analyse(spark, str(tmp_path / "a")).collect()}
    assert rows["bad.wav"].error and rows["Alpha.wav"].error is None and rows["Alpha.wav"].verdict in ("FAKE", "REAL")
    with pytest.raises(Exception, match="bad.wav"):
        files.decode(files.discover(spark, str(tmp_path / "a"))).count()


def test_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("﻿id\tscore\na\t.9\nb\t.1\n", "utf-8")
    (tmp_path / "l.tsv").write_text("id\tlabel\nb\tbonafide\na\tspoof\n")
    got = tables.evaluate_files(spark, str(tmp_path / "s.tsv"), str(tmp_path / "l.tsv"))
    assert got["min_dcf"] == 0 and tables.report(got).count("\n") == 5
    (tmp_path / "c.csv").write_text("file,prediction\na,.1\nb,.9\n")
    (tmp_path / "d.csv").write_text("file,class\na,bonafide\nb,spoof\n")
    got = tables.evaluate_files(spark, str(tmp_path / "c.csv"), str(tmp_path / "d.csv"), id_column="file", score_column="prediction", label_column="class", sep="comma")
    assert got["min_dcf"] == 0
    (tmp_path / "e.csv").write_text("file_id,score,score\na,1,2\n")
    with pytest.raises(FusionDataError):
        tables.read_table(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ScoreTableError):
        tables.read_predictions(spark, str(tmp_path / "c.csv"), sep=",")
    with pytest.raises(ScoreTableError):
        tables.delimiter("ab")
    (tmp_path / "h.tsv").write_text("a\t0.5\nbroken\nb\t1\tx\n")
    assert [tuple(r) for r in tables.read_headerless_scores(spark, str(tmp_path / "h.tsv")).collect()] == [("a", 0.5)]
    assert cli.main(["evaluate", "--scores", str(tmp_path / "s.tsv"), "--labels", str(tmp_path / "l.tsv")], spark) == 0
    assert cli.main(["evaluate", "--scores", str(tmp_path / "s.tsv"), "--labels", str(tmp_path / "d.csv")], spark) == 1


def test_manifest(spark, tmp_path):
    for p in ("gen1/a/1.wav", "gen1/a/2.wav", "gen2/sentence_3_irish.wav", "gen2/.hidden.wav", "other/x.wav"):
        (tmp_path / "fake" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "fake" / p).write_bytes(b"x")
    for p in ("19-198-0001.flac", "26-495-0002.flac"):
        (tmp_path / "real").mkdir(exist_ok=True)
        (tmp_path / "real" / p).write_bytes(b"x")
    fake = manifest.synthetic_rows(manifest.files_of(spark, str(tmp_path / "fake")), ["gen1", "gen2"], "gen2")
    real = manifest.real_rows(manifest.files_of(spark, str(tmp_path / "real")), "libri", manifest.leading_speaker)
    rows = manifest.build(fake, [real], folds=2)
    found = {r.path.rsplit("/", 1)[-1]: r for r in rows.collect()}
    assert len(found) == 5 and found["sentence_3_irish.wav"].accent_style == "irish" and found["sentence_3_irish.wav"].fold == 1
    assert found["1.wav"].speaker == "a" and found["19-198-0001.flac"].speaker == "libri_19" and {found[f].fold for f in found if f.endswith("flac")} == {0, 1}
    assert manifest.counts(rows) == {("spoof", "gen1"): 2, ("spoof", "gen2"): 1, ("bonafide", "real"): 2}
    assert manifest.update(rows, real).count() == 5
    named = {r.path.rsplit("/", 1)[-1]: (r.source, r.is_real) for r in fingerprints.named_sources(rows).collect()}
    assert named["1.wav"] == ("gen1", False) and named["19-198-0001.flac"] == ("real_libri", True)
    rows.coalesce(1).write.csv(str(tmp_path / "m"), header=True)
    assert tables.read_manifest(spark, str(tmp_path / "m")).count() == 5
    (tmp_path / "bad.csv").write_text("path,label,fold\na,spoof,\n")
    with pytest.raises(DataContractError):
        tables.read_manifest(spark, str(tmp_path / "bad.csv"))


def test_accepted_samples(spark):
    df = spark.createDataFrame([("a", 10, [0.0] * 14), ("b", 10, [0.0] * 20), ("c", 10, [0.0] * 100), ("d", 10, None), ("e", 10, [0.0] * 30)], "file_id string, sample_rate int, samples array<float>")
    rows = manifest.accepted_samples(df, 2).collect()
    assert [(r.file_id, r.filename, len(r.samples)) for r in rows] == [("b", "sample_000000.wav", 20), ("c", "sample_000001.wav", 80)]


def test_cache_knows_its_inputs(spark, tmp_path):
    cache = sinks.FeatureCache(spark, str(tmp_path))
    made = []

    def make(df):
        made.append(1)
        return df.withColumn("y", F.col("x") * 2)

    a = spark.createDataFrame([("k", 1)], "id string, x int")
    for _ in range(2):
        assert cache.get("f", {"n": 1}, a, "id", make).first().y == 2
    cache.get("f", {"n": 2}, a, "id", make)
    cache.get("f", {"n": 1}, spark.createDataFrame([("j", 1)], "id string, x int"), "id", make)
    assert len(made) == 3


def test_detectors_over_tables(spark):
    y = tone(3, 220)
    y[24_000:] *= 6
    df = spark.createDataFrame([("step", R, y.tolist()), ("still", R, tone(3, 220).tolist())], "file_id string, sample_rate int, samples array<float>")
    f = {r.file_id: r for r in detectors.splice_features(df).collect()}
    assert f["step"].splice_n_candidates >= 1 and f["still"].splice_n_candidates == 0
    s = {r.file_id: r for r in detectors.splices(df).collect()}
    assert abs(s["step"].candidates[0].time_sec - 1.5) <= 0.08 and s["still"].note == ""
    assert detectors.lfcc(spark.createDataFrame([("x", R, None)], df.schema), permissive=True).first().lfcc == [0.0] * 120
    frames = detectors.frame_embeddings(df, "resona.operators.detectors:Spectrum")
    labels = spark.createDataFrame([("step", "partial"), ("still", "bonafide")], "file_id string, label string")
    assert {r.label for r in detectors.feature_distributions(frames, labels).collect()} == {"partial", "bonafide"}
    layers = spark.createDataFrame([("a", 0, 0, False, [1.0]), ("a", 0, 1, False, [3.0]), ("a", 1, 0, False, [5.0]), ("a", 1, 1, True, [9.0])], "file_id string, layer int, frame int, masked boolean, state array<double>")
    assert detectors.layer_statistics(layers).first().features == pytest.approx([2, 1, 5, 1e-4], abs=1e-6)


def test_relational_and_local_novelty_agree(spark):
    from resona.functions import novelty as local
    from resona.operators import novelty as relational

    e = np.random.default_rng(1).normal(size=(20, 6))
    df = spark.createDataFrame([("a", i, 0.2 * i, v.tolist()) for i, v in enumerate(e)], "file_id string, frame_idx int, frame_time double, embedding array<double>")
    want = local.detect(e, 0.2 * np.arange(20))
    for r in relational.curves(df, "file_id", "frame_idx", "embedding").collect():
        if r.b < 20:
            assert r.novelty == pytest.approx(want.scale_curves[r.scale][r.b], abs=1e-9)
    got = detectors.embedding_novelty(df).first()
    assert got.max_score == pytest.approx(want.max_score) and got.scale_curves.keys() == {2, 4}


def test_fingerprints(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{s}{i}", s, s == "real", (rng.normal(m, 1, 3)).tolist()) for s, m in (("real", 0), ("fake", 6)) for i in range(40)] + [("lost", "real", True, None)]
    df = spark.createDataFrame(rows, "file_id string, source string, is_real boolean, vector array<double>")
    prints = fingerprints.fit(df.filter("vector IS NOT NULL"), "source", "is_real", "vector", "file_id")
    got = {r.file_id: r for r in fingerprints.score(df, prints, "vector").collect()}
    x = np.array([r[3] for r in rows if r[1] == "real" and r[3]])
    inv = np.linalg.inv(np.cov(x, rowvar=False) + 1e-6 * np.eye(3))
    d = x[0] - x.mean(axis=0)
    assert got["real0"].d_real == pytest.approx(np.sqrt(d @ inv @ d)) and got["lost"].score == 0.5
    assert all(got[k].score < 0.5 for k in got if k.startswith("real")) and all(got[k].score > 0.5 for k in got if k.startswith("fake"))


def test_cross_validation(spark):
    rng = np.random.default_rng(71)
    rows = [(f"f{i}", i % 2, (2, 5, 9)[i % 3], (2 if i % 2 else -2) + rng.normal(0, 0.8), rng.normal()) for i in range(180)]
    df = spark.createDataFrame([(a, b, c, float(d), float(e)) for a, b, c, d, e in rows], "file_id string, label int, fold int, signal double, noise double")
    cv = learning.cross_validate(df, " Logistic ", ["signal", "noise"])
    got = {r.file_id: r.score for r in cv.predictions.collect()}
    assert len(got) == 180 and cv.min_dcf < 0.2 and cv.importance is None
    # the held-out fold's scores by an independent Newton solve on the training folds
    x = np.array([r[3:] for r in rows])
    y = np.array([r[1] for r in rows])
    k = np.array([r[2] for r in rows])
    m, s = x[k != 2].mean(axis=0), x[k != 2].std(axis=0)
    z = np.c_[(x - m) / s, np.ones(180)]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z[k != 2] @ w))
        reg = np.array([1, 1, 0.0])
        h = z[k != 2].T @ (z[k != 2] * (p * (1 - p))[:, None]) + np.diag(reg)
        w -= np.linalg.solve(h, z[k != 2].T @ (p - y[k != 2]) + reg * w)
    want = 1 / (1 + np.exp(-z @ w))
    assert [got[f"f{i}"] for i in range(180) if k[i] == 2] == pytest.approx([want[i] for i in range(180) if k[i] == 2], abs=2e-3)
    one = spark.createDataFrame([("a", 0, 2, 1.0), ("b", 0, 2, 2.0), ("c", 1, 5, 1.0), ("d", 1, 5, 2.0)], "file_id string, label int, fold int, score double")
    with pytest.raises(learning.FusionModelError):
        learning.cross_validate(one)
    for bad in (["label"], ["nope"], ["signal", "signal"], []):
        with pytest.raises(FusionDataError):
            learning.cross_validate(df, "logistic", bad)
    with pytest.raises(learning.FusionModelError):
        learning.create_model("oracle")


def test_boosted_and_projection(spark):
    rng = np.random.default_rng(72)
    rows = [(f"f{i}", i % 2, float(i % 2 + rng.normal(0, 0.2)), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "file_id string, label int, a double, b double")
    model = learning.train_boosted(df, ["a", "b"], maxIter=3, maxDepth=2)
    assert model.importance()["a"] > model.importance()["b"] and model.score(df).filter("(score > 0.5) = (label = 1)").count() > 110
    assert learning.class_weights(df.filter("label = 0 OR a > 1")).select("weight").distinct().count() == 2
    x = rng.normal(size=(50, 5)) * [5, 2, 1, 0.5, 0.1] + 3
    vec = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    p = learning.Projection(2).fit(vec, "v")
    got = np.array([r.projected for r in p.apply(vec).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)


def test_explanations(spark):
    scores = spark.createDataFrame([("dir/a.wav", 0.5 * i, 0.1 * i) for i in range(9)] + [("dir/a.wav", 9.0, 0.8)], "file_id string, start double, score double")
    row = explain.context_json(explain.context(scores)).first()
    assert '"file":"a.wav"' in row.json and "dir" not in row.json and '"verdict":"FAKE"' in row.json and row.json.index('"start":4.0') < row.json.index('"start":9.0')
    rec = explain.record({"file": "C:\\x\\a.wav", "top3_mean": float("nan"), "fake_probability": 0.4, "windows": [{"start": 1.0, "score": float("inf")}, {"start": 0.5, "end": 5.5, "score": 0.91}], "splice": 1})
    assert rec["file"] == "a.wav" and rec["score"] == 0.4 and rec["top_windows"] == [{"start": 0.5, "end": 5.5, "score": 0.91}] and rec["metadata"] == "not supplied" and "several" in rec["disagreement"]
    deep = {}
    at = deep
    for _ in range(9):
        at["x"] = {}
        at = at["x"]
    assert explain.bounded({"l": list(range(500)), "n": float("nan"), "d": deep})["n"] is None and len(explain.bounded(list(range(500)))) == 100
    assert explain.explain({"file": "a"}, lambda p, t: {"output": [{"content": [{"text": " fine "}]}]}, model="m") == explain.Reply("fine", "m")
    assert explain.explain({"file": "a"}, lambda p, t: {"output_text": "so", "id": "r-1", "model": "m-2"}, model="m") == explain.Reply("so", "m-2", "r-1")
    with pytest.raises(ServiceNotConfigured):
        explain.explain({"file": "a"})
    for reply in ({}, {"output": []}):
        with pytest.raises(ServiceError):
            explain.explain({"file": "a"}, lambda p, t, r=reply: r)

    def fails(p, t):
        raise ValueError("x" * 900)

    with pytest.raises(ServiceError) as e:
        explain.explain({"file": "a"}, fails)
    assert len(str(e.value)) == 500


def test_sql_functions(spark):
    from resona.functions import udfs

    udfs.register(spark)
    spark.createDataFrame([("a", tone(3, 220).tolist())], "f string, samples array<double>").createOrReplaceTempView("clips")
    row = spark.sql("SELECT splice_score(samples) AS s, size(lfcc(samples)) AS l, size(rfp_residual(samples)) AS r, cpps(samples) AS c FROM clips").first()
    assert row.s < 0.85 and row.l == 120 and row.r == 257 and row.c > 5
    assert spark.sql("SELECT top3_mean(x) AS t FROM VALUES (0.1D), (0.2D), (0.8D), (0.9D) AS v(x)").first().t == pytest.approx(1.9 / 3)
    assert [r.start_sample for r in spark.sql("SELECT * FROM explode_windows(115200, 80000, 8000)").collect()] == [0, 8000, 16000, 24000, 32000, 35200]


def test_scorers(spark):
    assert scoring.loaded("resona.operators.scoring:SpectralFlatness") is scoring.loaded("resona.operators.scoring:SpectralFlatness")
    with pytest.raises(scoring.AssetError):
        scoring.require_assets("/nowhere", ("model.bin",))
    scoring.check_architecture({}, "Scorer")
    scoring.check_architecture({"architecture": ["Scorer"]}, "Scorer")
    with pytest.raises(scoring.AssetError):
        scoring.check_architecture({"architecture": "Other"}, "Scorer")
    df = spark.createDataFrame([("b", R, tone(2).tolist())], "file_id string, sample_rate int, samples array<float>")
    assert 0 <= scoring.whole_clip_scores(df).first().score <= 1
    with pytest.raises(Exception, match=InferenceError.__name__):
        scoring.score_windows(df, "tests.test_sources:Broken").collect()
