"""Command lines: score, analyse, evaluate, submit, blend, train, train-early, fingerprints, catalogue, update-manifest, assets."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import DataContractError, ExecutionError
from .runtime import prepare
from .schema import HIGH_SCORE


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="resona", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("score", help="score a directory to a TSV, or nothing at all")
    p.add_argument("directory")
    p.add_argument("output")
    p.add_argument("--scorer", default="spectral-flatness")

    p = sub.add_parser("analyse", help="window results of a file or directory; bad files are reported and skipped")
    p.add_argument("path")
    p.add_argument("--threshold", type=float, default=HIGH_SCORE)
    p.add_argument("--csv")
    p.add_argument("--scorer", default="spectral-flatness")

    p = sub.add_parser("evaluate", help="minDCF of a score table against a label table")
    p.add_argument("--scores", required=True)
    p.add_argument("--labels", required=True)
    p.add_argument("--id-column", default="id")
    p.add_argument("--score-column", default="score")
    p.add_argument("--label-column", default="label")
    p.add_argument("--delimiter", default="tab")
    p.add_argument("--allow-extra-predictions", action="store_true")

    p = sub.add_parser("blend", help="blend a score TSV with another, by file name")
    p.add_argument("main")
    p.add_argument("other")
    p.add_argument("output")
    p.add_argument("--ensemble-weight", type=float, default=0.7)

    p = sub.add_parser("train", help="train on a manifest, score its validation fold or a test directory, write score files")
    p.add_argument("--manifest", required=True)
    p.add_argument("--data-root", required=True)
    p.add_argument("--output-prefix", required=True)
    p.add_argument("--prefix", default="", help="path prefix of the manifest to replace by the data root")
    p.add_argument("--test-dir")
    p.add_argument("--val-fold", type=int, default=0)
    p.add_argument("--no-val", action="store_true")
    p.add_argument("--max-fake", type=int, default=0)
    p.add_argument("--max-real", type=int, default=0)
    p.add_argument("--components", type=int, default=512)
    p.add_argument("--rounds", type=int, default=500)
    p.add_argument("--embed", default="resona.operators.detectors:Spectrum")
    p.add_argument("--cache")

    p = sub.add_parser("submit", help="score a test directory's WAV files whole, blend with another table if given")
    p.add_argument("--test-dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--model-dir")
    p.add_argument("--asset", action="append", default=[], help="a file that the model directory must hold")
    p.add_argument("--scorer", default="spectral-flatness")
    p.add_argument("--xgb-tsv")
    p.add_argument("--ensemble-weight", type=float, default=0.7)

    p = sub.add_parser("train-early", help="embeddings, a logistic model on them and a score file of a test directory")
    p.add_argument("--manifest", required=True)
    p.add_argument("--data-root", required=True)
    p.add_argument("--test-dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--cache", required=True)
    p.add_argument("--prefix", default="")
    p.add_argument("--val-fold", type=int, default=0)
    p.add_argument("--sample-per-gen", type=int, default=0)
    p.add_argument("--sample-real", type=int, default=0)
    p.add_argument("--embed", default="resona.operators.detectors:Spectrum")
    p.add_argument("--extract-only", action="store_true")
    p.add_argument("--train-only", action="store_true")

    p = sub.add_parser("fingerprints", help="fingerprints of a manifest's sources, and the scores of one fold")
    p.add_argument("--manifest", required=True)
    p.add_argument("--data-root", required=True)
    p.add_argument("--output", required=True, help="Parquet table of the fingerprints")
    p.add_argument("--prefix", default="")
    p.add_argument("--fold", type=int, default=0)
    p.add_argument("--scores", help="score table of the fold")

    p = sub.add_parser("catalogue", help="manifest of synthetic recordings by generator and of real corpora")
    p.add_argument("output")
    p.add_argument("--synthetic", required=True, help="directory of generator/[speaker/]file")
    p.add_argument("--generators", required=True, help="names in the order of their folds, comma separated")
    p.add_argument("--accent-generator")
    p.add_argument("--real", action="append", default=[], metavar="NAME=DIRECTORY")

    p = sub.add_parser("assets", help="whether a model directory holds its files")
    p.add_argument("directory")
    p.add_argument("file", nargs="+")

    p = sub.add_parser("update-manifest", help="append new files to a manifest")
    p.add_argument("manifest")
    p.add_argument("directory")
    p.add_argument("output")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 on success, 1 on bad inputs or failed work, 2 where the model is missing."""
    from .errors import AssetError

    args = parser().parse_args(argv)
    spark = prepare(spark or SparkSession.builder.getOrCreate())
    try:
        return _run(args, spark)
    except AssetError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except (DataContractError, ExecutionError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    from .operators import scoring
    from .operators.joins import blend
    from .sources import manifest, sinks, tables

    if args.command == "score":
        rows = scoring.score_directory(spark, args.directory, args.output, args.scorer)
        print(f"{rows.count()} files to {args.output}")
    elif args.command == "analyse":
        found = scoring.analyse(spark, args.path, args.threshold, args.scorer).cache()
        for r in found.orderBy("file_id").toLocalIterator():
            print(f"{r['file_id']}: {r['error']}" if r["error"] else f"{r['file_id']}: {r['verdict']} {r['top3_mean']:.4f} over {r['n_windows']} windows")
        if found.filter("error IS NULL").isEmpty():
            return 1
        if args.csv:
            sinks.write_summaries(found.filter("error IS NULL").withColumnRenamed("file_id", "file"), args.csv)
    elif args.command == "evaluate":
        result = tables.evaluate_files(
            spark, args.scores, args.labels, id_column=args.id_column, score_column=args.score_column, label_column=args.label_column,
            sep=tables.delimiter(args.delimiter), allow_extra=args.allow_extra_predictions,
        )
        print(tables.report(result))
    elif args.command == "blend":
        mixed = blend(tables.read_headerless_scores(spark, args.main), tables.read_headerless_scores(spark, args.other), weight=args.ensemble_weight)
        sinks.write_tsv(mixed, args.output, header=False)
    elif args.command == "train":
        from .operators import training
        from .sources.files import test_files

        names = ("manifest", "data_root", "prefix", "val_fold", "no_val", "max_fake", "max_real", "components", "rounds", "embed", "cache")
        config = training.TrainingConfig(**{n: getattr(args, n) for n in names})
        rows, held = training.load_manifest(spark, config)
        model = training.train(training.features(spark, rows, config, "train"), config)
        if args.test_dir:
            held = test_files(spark, args.test_dir)
        scores = model.score(training.features(spark, held, config, "test", args.test_dir)).cache()
        if not args.test_dir and not args.no_val:
            print(", ".join(f"{k}: {v}" for k, v in training.evaluate(scores).items()))
        training.write_scores(scores, args.output_prefix)
    elif args.command == "submit":
        rows = scoring.submit(spark, args.test_dir, args.output, args.scorer, args.model_dir, tuple(args.asset), args.xgb_tsv, args.ensemble_weight)
        print(f"{rows.count()} files to {args.output}")
    elif args.command == "train-early":
        from .operators import training

        config = training.TrainingConfig(
            args.manifest, args.data_root, args.prefix, args.val_fold, max_real=args.sample_real, embed=args.embed, cache=args.cache,
            max_fake=args.sample_per_gen * tables.read_manifest(spark, args.manifest).filter("label = 'spoof'").select("generator").distinct().count(),
        )
        found = training.early_pipeline(spark, config, args.test_dir, args.output, args.extract_only, args.train_only)
        print("embeddings kept" if found is None else ", ".join(f"{k}: {v}" for k, v in found.items()))
    elif args.command == "fingerprints":
        from .operators import fingerprints
        from .sources.paths import remap

        rows = tables.read_manifest(spark, args.manifest).withColumn("path", remap("path", args.prefix, args.data_root))
        fingerprints.build_from_manifest(spark, rows.filter(F.col("fold") != args.fold), args.data_root).write.mode("overwrite").parquet(args.output)
        scores, found = fingerprints.evaluate_on_manifest(spark, rows, spark.read.parquet(args.output), args.data_root, args.fold)
        print(", ".join(f"{k}: {v}" for k, v in found.items()))
        if args.scores:
            sinks.write_tsv(scores.select(F.col("file_id").alias("filename"), "score"), args.scores)
    elif args.command == "catalogue":
        real = [manifest.real_rows(manifest.files_of(spark, where), name, manifest.leading_speaker) for name, _, where in (r.partition("=") for r in args.real)]
        synthetic = manifest.synthetic_rows(manifest.files_of(spark, args.synthetic), args.generators.split(","), args.accent_generator)
        rows = (manifest.build(synthetic, real) if real else synthetic).cache()
        rows.withColumn("_p", F.col("path")).orderBy("_p").drop("_p").coalesce(1).write.mode("overwrite").csv(args.output, header=True)
        for (label, generator), n in sorted(manifest.counts(rows).items()):
            print(f"{label} {generator}: {n}")
    elif args.command == "assets":
        scoring.require_assets(args.directory, tuple(args.file))
        print("complete")
    else:
        old = tables.read_manifest(spark, args.manifest)
        new = manifest.real_rows(manifest.files_of(spark, args.directory), "extra")
        manifest.update(old, new).withColumn("_p", F.col("path")).orderBy("_p").drop("_p").coalesce(1).write.mode("overwrite").csv(args.output, header=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
