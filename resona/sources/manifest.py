"""The catalogue of synthetic and real recordings, built from their paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import append_new
from ..operators.sampling import assign_folds
from ..schema import BONAFIDE, MANIFEST_COLUMNS, SPOOF
from . import paths


def files_of(spark: SparkSession, root: str, suffixes: Sequence[str] = (".wav", ".flac", ".mp3")) -> DataFrame:
    """(path, relative) of the files below ``root``, dotfiles left out; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/") + "/"
    found = found.filter(paths.suffix("path").isin(*suffixes) & ~paths.basename("path").startswith("."))
    return found.withColumn("relative", F.expr(f"substring(path, {len(base) + 1})"))


def synthetic_rows(files: DataFrame, generators: Sequence[str], accent_generator: str | None = None) -> DataFrame:
    """Rows of files laid out as generator/[speaker/]file; the fold is the generator's place.

    Files of ``accent_generator`` are named sentence_<n>_<accent>.
    """
    folds = F.create_map(*[x for i, g in enumerate(generators) for x in (F.lit(g), F.lit(i))])
    parts = F.split("relative", "/")
    generator = F.get(parts, F.lit(0))
    speaker = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(generator)
    name = paths.stem("relative")
    accented = generator == F.lit(accent_generator or "")
    sentence = F.when(accented, F.regexp_extract(name, r"^sentence_(\d+)_", 1)).otherwise(F.regexp_extract(name, r"(\d+)", 1))
    rows = files.withColumns({
        "generator": generator, "label": F.lit(SPOOF), "speaker": speaker, "sentence_id": sentence,
        "accent_style": F.when(accented, F.regexp_extract(name, r"^sentence_\d+_(.+)$", 1)).otherwise(F.lit("")),
        "source_format": F.ltrim(paths.suffix("relative"), F.lit(".")), "fold": F.element_at(folds, generator),
    })
    rows = rows.filter(F.col("fold").isNotNull())
    return rows.withColumn("group_id", F.concat_ws("_", "generator", "speaker", "sentence_id")).select(*MANIFEST_COLUMNS)


def real_rows(files: DataFrame, corpus: str, speaker=None) -> DataFrame:
    """Rows of one real corpus without folds; ``speaker`` maps the stem to the speaker (else the corpus)."""
    name = paths.stem("relative")
    who = speaker(name) if speaker else F.lit(corpus)
    rows = files.withColumns({
        "label": F.lit(BONAFIDE), "generator": F.lit("real"), "speaker": F.concat(F.lit(corpus + "_"), who), "sentence_id": name, "accent_style": F.lit(""),
        "source_format": F.ltrim(paths.suffix("relative"), F.lit(".")), "fold": F.lit(None).cast("int"),
    })
    return rows.withColumn("group_id", F.concat_ws("_", F.lit(corpus), "sentence_id")).select(*MANIFEST_COLUMNS)


def leading_speaker(name):
    """Speakers of corpora whose stems read <speaker>-<chapter>-<utterance>."""
    return F.get(F.split(name, "-"), F.lit(0))


def build(synthetic: DataFrame, real: Sequence[DataFrame], folds: int = 10, seed: int = 42, exact: bool = False) -> DataFrame:
    """The whole catalogue: real rows get folds by a seeded shuffle."""
    all_real = real[0]
    for more in real[1:]:
        all_real = all_real.unionByName(more)
    dealt = assign_folds(all_real.drop("fold"), "path", folds, seed, exact, ["path"])
    return synthetic.unionByName(dealt.select(*MANIFEST_COLUMNS))


def counts(manifest: DataFrame) -> Mapping[tuple[str, str], int]:
    return {(r["label"], r["generator"]): r["n"] for r in manifest.groupBy("label", "generator").agg(F.count(F.lit(1)).alias("n")).collect()}


def accepted_samples(waveforms: DataFrame, limit: int, least: float = 1.5, most: float = 8.0, order: str = "file_id") -> DataFrame:
    """The first ``limit`` waveforms of at least ``least`` seconds, cut to ``most``, named in sequence."""
    from pyspark.sql import Window

    n = F.size("samples")
    rate = F.col("sample_rate")
    kept = waveforms.filter(F.col("samples").isNotNull() & (n >= rate * least)).orderBy(order).limit(limit)
    cut = kept.withColumn("samples", F.slice("samples", F.lit(1), (rate * most).cast("int")))
    place = F.row_number().over(Window.orderBy(order)) - 1  # `limit` rows
    return cut.withColumn("filename", F.format_string("sample_%06d.wav", place))


def update(manifest: DataFrame, new: DataFrame, folds: int = 10, seed: int = 42) -> DataFrame:
    """The manifest with the new rows whose path it lacks; they get folds by a seeded shuffle."""
    dealt = assign_folds(new.drop("fold"), "path", folds, seed).select(*MANIFEST_COLUMNS)
    return append_new(manifest.select(*MANIFEST_COLUMNS), dealt)
