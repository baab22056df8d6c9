"""The training pipeline: two feature families, boosted trees on each, a stacked model, score files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AssetError
from ..sources import files, sinks, tables
from ..sources.paths import basename, remap
from . import detectors, learning, metrics
from .sampling import capped_per_group, sample_rows, split_by_fold
from .learning import expand
from .validate import label_code


@dataclass(frozen=True)
class TrainingConfig:
    """What to train on and how; zero caps take every row."""

    manifest: str
    data_root: str
    prefix: str = ""
    val_fold: int = 0
    no_val: bool = False
    max_fake: int = 0
    max_real: int = 0
    max_seconds: float = 5.0
    embed: str = "resona.operators.detectors:Spectrum"
    components: int = 512
    rounds: int = 500
    depth: int = 6
    seed: int = 42
    cache: str | None = None


def load_manifest(spark: SparkSession, config: TrainingConfig) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows with their files' paths; synthetic rows capped evenly over generators."""
    rows = tables.read_manifest(spark, config.manifest).withColumn("path", remap("path", config.prefix, config.data_root))
    train, val = split_by_fold(rows, config.val_fold, config.no_val)
    return sample_manifest(train, config.max_fake, config.max_real, config.seed), val


def sample_manifest(rows: DataFrame, max_fake: int = 0, max_real: int = 0, seed: int = 42) -> DataFrame:
    code = label_code("label")
    fake, real = rows.filter(code == 1), rows.filter(code == 0)
    if max_fake:
        fake = capped_per_group(fake, "generator", "path", max_fake, seed)
    if max_real:
        real = sample_rows(real, "path", max_real, seed)
    return fake.select(*rows.columns).unionByName(real.select(*rows.columns))


def waveforms(spark: SparkSession, rows: DataFrame, root: str, max_seconds: float | None) -> DataFrame:
    """Decoded audio of the manifest's files below ``root``; what cannot be decoded has null samples.

    The folder is read once and its files meet the manifest's paths in a join,
    so no list of paths passes through the driver's Python.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  a local path with and without its scheme
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    wanted = rows.select(plain("path").alias("_wanted")).distinct()
    kept = found.join(wanted, plain("path") == F.col("_wanted"), "left_semi")
    return files.decode(kept, normalise=False, permissive=True, most_seconds=max_seconds).withColumn("file_id", basename("file_id"))


def pooled(frames: DataFrame) -> DataFrame:
    """Mean and deviation over the frames (file_id, embedding) of each clip, side by side."""
    long = frames.select("file_id", F.posexplode("embedding").alias("dim", "x"))
    per = long.groupBy("file_id", "dim").agg(F.avg("x").alias("m"), F.sqrt(F.var_pop("x") + F.lit(1e-8)).alias("s"))
    both = per.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("dim", "m", "s"))).alias("v"))
    return both.select("file_id", F.concat(F.transform("v", lambda r: r["m"]), F.transform("v", lambda r: r["s"])).alias("embedding"))


def clip_embeddings(audio: DataFrame, embed: str) -> DataFrame:
    """Pooled embeddings of each clip's frames."""
    return pooled(detectors.frame_embeddings(audio.filter("samples IS NOT NULL AND size(samples) > 0"), embed))


def features(spark: SparkSession, rows: DataFrame, config: TrainingConfig, name: str, root: str | None = None) -> DataFrame:
    """file_id, label, embedding, lfcc of the files below ``root`` (the data root); zeros stand in for files that cannot be analysed."""

    def make(inputs: DataFrame) -> DataFrame:
        audio = waveforms(spark, inputs, root or config.data_root, config.max_seconds).cache()
        embedded = clip_embeddings(audio.drop("error"), config.embed)
        width = embedded.agg(F.max(F.size("embedding"))).first()[0] or 1
        out = detectors.lfcc(audio.drop("error"), permissive=True).join(embedded, "file_id", "left")
        return out.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), width)))

    settings = {"embed": config.embed, "seconds": config.max_seconds}
    made = sinks.FeatureCache(spark, config.cache).get(name, settings, rows, "path", make) if config.cache else make(rows)
    labels = rows.select(basename("path").alias("file_id"), F.coalesce(label_code("label").cast("int"), F.lit(-1)).alias("label"))
    return made.join(labels, "file_id")


@dataclass
class Trained:
    """The fitted models; ``score`` gives a score of each and of the stack."""

    projection: learning.Projection
    width: int
    by_embedding: learning.Boosted
    by_lfcc: learning.Boosted
    stacked: learning.Logistic

    def _wide(self, rows: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        rows, a = learning.expand(self.projection.apply(rows), "projected", self.width, "e")
        rows, b = learning.expand(rows, "lfcc", 120, "c")
        return rows, a, b

    def score(self, rows: DataFrame) -> DataFrame:
        wide, _, _ = self._wide(rows)
        both = self.by_lfcc.score(self.by_embedding.score(wide, "embedding_score"), "lfcc_score")
        out = self.stacked.score(both.withColumnsRenamed({"embedding_score": "embedding_trees", "lfcc_score": "lfcc_trees"}))
        return out.select("file_id", "label", "embedding_trees", "lfcc_trees", "score")


def train(rows: DataFrame, config: TrainingConfig) -> Trained:
    known = rows.filter("label >= 0").cache()
    projection = learning.Projection(config.components).fit(known, "embedding")
    width = len(projection.explained)
    out = Trained(projection, width, None, None, None)
    wide, a, b = out._wide(known)
    wide = wide.cache()
    options = {"maxIter": config.rounds, "maxDepth": config.depth, "seed": config.seed}
    out.by_embedding = learning.train_boosted(wide, a, **options)
    out.by_lfcc = learning.train_boosted(wide, b, **options)
    ids = known.select("file_id", "label")
    base = {"embedding_trees": out.by_embedding.score(wide).select("file_id", "score"), "lfcc_trees": out.by_lfcc.score(wide).select("file_id", "score")}
    out.stacked, _ = learning.stack(base, ids)
    return out


def evaluate(scores: DataFrame) -> dict:
    """EER, least cost, AUC and accuracy of labelled scores."""
    known = scores.filter("label >= 0")
    out = metrics.eer_and_dcf(known, "score", "label").first().asDict()
    area = metrics.auc(known, "score", "label").first()
    return out | {"auc": area["auc"] if area else None, "accuracy": metrics.confusion(known, "score", "label").first()["accuracy"]}


def write_scores(scores: DataFrame, prefix: str) -> None:
    """Three score files: of either base model and of the stack."""
    for column in ("embedding_trees", "lfcc_trees", "score"):
        name = "ensemble" if column == "score" else column
        sinks.write_tsv(scores.select(F.col("file_id").alias("filename"), F.col(column).alias("score")), f"{prefix}_{name}.tsv")


def train_and_evaluate(training: DataFrame, validation: DataFrame, columns: list[str]) -> tuple[learning.Logistic, dict]:
    """The early pipeline: unscaled logistic regression and its accuracy and AUC on the validation rows."""
    model = learning.Logistic(scaled=False).fit(training, columns)
    return model, evaluate(model.score(validation))


def early_features(spark: SparkSession, rows: DataFrame, config: TrainingConfig, name: str, root: str | None = None, cached_only: bool = False) -> DataFrame:
    """file_id, label and embedding of the files, kept in the cache; with ``cached_only`` what an earlier run has kept."""
    if not config.cache:
        raise AssetError("the early pipeline keeps its embeddings in a cache")

    def make(inputs: DataFrame) -> DataFrame:
        if cached_only:
            raise AssetError(f"no cached embeddings for {name}: extract them first")
        return clip_embeddings(waveforms(spark, inputs, root or config.data_root, config.max_seconds).drop("error"), config.embed)

    kept = sinks.FeatureCache(spark, config.cache).get(f"early-{name}", {"embed": config.embed, "seconds": config.max_seconds}, rows, "path", make)
    labels = rows.select(basename("path").alias("file_id"), F.coalesce(label_code("label").cast("int"), F.lit(-1)).alias("label"))
    return kept.withColumn("file_id", basename("file_id")).join(labels, "file_id")


def early_pipeline(spark: SparkSession, config: TrainingConfig, test_dir: str, output: str, extract_only: bool = False, train_only: bool = False) -> dict | None:
    """Embeddings of training, validation and test files, then a logistic model on them and a score file of the test files.

    ``extract_only`` stops once the embeddings are kept; ``train_only`` starts from those of an earlier run.
    """
    train, val = load_manifest(spark, config)
    parts = (("train", train, None), ("val", val, None), ("test", files.test_files(spark, test_dir), test_dir))
    kept = {name: early_features(spark, rows, config, name, root, train_only) for name, rows, root in parts}
    if extract_only:
        return None
    width = kept["train"].agg(F.max(F.size("embedding"))).first()[0] or 0
    wide = {name: expand(rows, "embedding", width, "e") for name, rows in kept.items()}
    model, found = train_and_evaluate(wide["train"][0].filter("label >= 0"), wide["val"][0], wide["train"][1])
    sinks.write_tsv(model.score(wide["test"][0]).select(F.col("file_id").alias("filename"), "score"), output)
    return found
