import numpy as np

from resona.operators import learning, training
from resona.sources.files import encode_wav


def test_training_pipeline(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = ["path,label,generator,speaker,sentence_id,accent_style,source_format,group_id,fold"]
    (tmp_path / "audio").mkdir()
    for i in range(24):
        fake = i % 2
        t = np.arange(9_000) / 16_000
        x = 0.3 * np.sin(2 * np.pi * (300 + 5 * i) * t) + (0.1 if fake else 0.001) * rng.normal(size=len(t))
        (tmp_path / "audio" / f"f{i}.wav").write_bytes(encode_wav(np.clip(x, -1, 1)))
        rows.append(f"C:\\old\\f{i}.wav,{'spoof' if fake else 'bonafide'},{'g' + str(i % 4) if fake else 'real'},s,{i},,wav,{i},{i % 3}")
    (tmp_path / "audio" / "broken.wav").write_bytes(b"x")
    rows.append("C:\\old\\broken.wav,spoof,g1,s,99,,wav,99,1")
    (tmp_path / "m.csv").write_text("\n".join(rows) + "\n")
    config = training.TrainingConfig(str(tmp_path / "m.csv"), f"file://{tmp_path}/audio", "c:/old/", components=4, rounds=2, depth=2, cache=str(tmp_path / "cache"))
    train, val = training.load_manifest(spark, config)
    assert train.count() == 17 and val.count() == 8
    assert training.sample_manifest(train, max_fake=4, max_real=3).groupBy("label").count().orderBy("label").collect()[0]["count"] == 3
    table = training.features(spark, train, config, "train")
    assert table.filter("file_id = 'broken.wav'").first().lfcc == [0.0] * 120
    model = training.train(table, config)
    scores = model.score(training.features(spark, val, config, "val")).cache()
    found = training.evaluate(scores)
    assert found["auc"] > 0.9 and scores.count() == 8
    training.write_scores(scores, str(tmp_path / "out"))
    assert (tmp_path / "out_ensemble.tsv").read_text().startswith("filename\tcm-score\n") and (tmp_path / "out_lfcc_trees.tsv").exists()


def test_command_lines(spark, tmp_path, capsys):
    """The early pipeline in two runs, fingerprints of a manifest, a submission, a catalogue and the asset check."""
    from resona.cli import main

    rng = np.random.default_rng(33)
    t = np.arange(9_000) / 16_000
    for folder in ("audio/gen0", "audio/gen1", "real", "test"):
        (tmp_path / folder).mkdir(parents=True)
    rows = ["path,label,generator,speaker,sentence_id,accent_style,source_format,group_id,fold"]
    for i in range(30):
        fake = i % 2
        x = 0.3 * np.sin(2 * np.pi * (250 + 3 * i) * t) + (0.1 if fake else 0.002) * rng.normal(size=len(t))
        where = f"audio/gen{i % 4 // 2}/f{i}.wav" if fake else f"real/{i}-1-{i}.wav"
        (tmp_path / where).write_bytes(encode_wav(np.clip(x, -1, 1)))
        rows.append(f"{tmp_path}/{where},{'spoof' if fake else 'bonafide'},{'gen' + str(i % 4 // 2) if fake else 'real'},corpus_{i},{i},,wav,{i},{i % 3}")
        if i < 6:
            (tmp_path / "test" / f"t{i}.wav").write_bytes(encode_wav(np.clip(x, -1, 1)))
    (tmp_path / "m.csv").write_text("\n".join(rows) + "\n")
    run = lambda *a: main([str(x) for x in a], spark)
    early = ("train-early", "--manifest", tmp_path / "m.csv", "--prefix", f"{tmp_path}/", "--data-root", tmp_path, "--test-dir", tmp_path / "test", "--output", tmp_path / "early.tsv", "--cache", tmp_path / "cache")
    assert run(*early, "--train-only") == 2
    assert run(*early, "--extract-only") == 0 and not (tmp_path / "early.tsv").exists()
    assert run(*early, "--train-only") == 0
    scores = dict(line.split("\t") for line in (tmp_path / "early.tsv").read_text().splitlines()[1:])
    assert sorted(scores) == [f"t{i}.wav" for i in range(6)] and all((float(scores[f"t{i}.wav"]) > 0.5) == bool(i % 2) for i in range(6))
    assert run("fingerprints", "--manifest", tmp_path / "m.csv", "--prefix", f"{tmp_path}/", "--data-root", tmp_path, "--output", tmp_path / "prints", "--scores", tmp_path / "rfp.tsv") == 0
    assert spark.read.parquet(str(tmp_path / "prints")).count() == 3 and len((tmp_path / "rfp.tsv").read_text().splitlines()) == 11
    assert run("submit", "--test-dir", tmp_path / "test", "--output", tmp_path / "one.tsv") == 0
    (tmp_path / "other.tsv").write_text("".join(f"{f}\t{s}\n" for f, s in scores.items()))
    assert run("submit", "--test-dir", tmp_path / "test", "--output", tmp_path / "two.tsv", "--xgb-tsv", tmp_path / "other.tsv", "--ensemble-weight", 0.25) == 0
    one, two = (dict(line.split("\t") for line in (tmp_path / f).read_text().splitlines()) for f in ("one.tsv", "two.tsv"))
    for f, s in one.items():
        assert abs(float(two[f]) - 0.25 * float(s) - 0.75 * float(scores[f])) < 2e-6
    assert run("submit", "--test-dir", tmp_path / "test", "--output", tmp_path / "x.tsv", "--model-dir", tmp_path, "--asset", "weights.bin") == 2
    assert run("assets", tmp_path, "m.csv") == 0 and run("assets", tmp_path, "weights.bin") == 2
    assert run("catalogue", tmp_path / "all.csv", "--synthetic", tmp_path / "audio", "--generators", "gen1,gen0", "--real", f"corpus={tmp_path}/real") == 0
    made = spark.read.csv(str(tmp_path / "all.csv"), header=True)
    assert made.count() == 30 and {(r.generator, r.fold) for r in made.filter("label = 'spoof'").collect()} == {("gen1", "0"), ("gen0", "1")}
    assert "bonafide real: 15" in capsys.readouterr().out


def test_models_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(f"f{i}", i % 2, float(i % 2) + 0.01 * i) for i in range(40)], "file_id string, label int, a double")
    for model, kind in ((learning.Logistic().fit(df, ["a"]), learning.Logistic), (learning.Boosted(maxIter=2, minInstancesPerNode=1).fit(df, ["a"]), learning.Boosted)):
        model.save(str(tmp_path / kind.__name__))
        again = kind.load(str(tmp_path / kind.__name__))
        assert [r.score for r in again.score(df).collect()] == [r.score for r in model.score(df).collect()]
    _, found = training.train_and_evaluate(df, df, ["a"])
    assert found["accuracy"] > 0.9


def test_oof_gbt_is_the_whole_job(spark, small, monkeypatch):
    from resona.plans import signals

    used, fit = [], learning.Boosted.fit

    def quick(self, *args, **kwargs):
        used.append(self.parameters)
        few = learning.Boosted(maxIter=1)
        fit(few, *args, **kwargs)
        self.__dict__.update(few.__dict__)
        return self

    monkeypatch.setattr(learning.Boosted, "fit", quick)
    rows = signals.oof_gbt(spark, small).collect()
    wanted = signals._features(spark, small).select("file_id", "fold").collect()
    assert used and all(p == learning.BOOSTED for p in used) and len(used) == len({r.fold for r in wanted})
    assert sorted(r.file_id for r in rows) == sorted(r.file_id for r in wanted) and all(0 <= r.score <= 1 for r in rows)
