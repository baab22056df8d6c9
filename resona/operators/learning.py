"""Fusion models, fold-safe cross validation, projections and stacking on MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FusionModelError
from .metrics import evaluate_min_dcf
from .validate import check_cv_table, not_finite

#: The logistic baseline and the boosted baselines.
LOGISTIC = {"C": 1.0, "max_iter": 2000, "seed": 42}
BOOSTED = {"maxDepth": 3, "maxIter": 200, "stepSize": 0.03, "minInstancesPerNode": 50, "seed": 42}
BOOSTED_TRAINING = {"maxDepth": 6, "maxIter": 500, "stepSize": 0.05, "minInstancesPerNode": 1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
#: Rows that a partition of training rows holds at most, and folds that are fitted side by side.
ROWS_OF_PARTITION, SIDE_BY_SIDE = 20_000, 4
_P = "_probability"


class Logistic:
    """Standardised L2 logistic regression; scaling is learnt from the training rows only."""

    def __init__(self, c: float = LOGISTIC["C"], max_iter: int = LOGISTIC["max_iter"], scaled: bool = True):
        self.c, self.max_iter, self.scaled = c, max_iter, scaled

    def fit(self, rows: DataFrame, features: Sequence[str], label: str = "label") -> Logistic:
        self.features = list(features)
        stats = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
        k = range(len(self.features))
        self.mean = [float(stats[f"m{i}"]) if self.scaled else 0.0 for i in k]
        self.scale = [(float(stats[f"s{i}"]) or 1.0) if self.scaled else 1.0 for i in k]
        # mean loss plus regParam / 2 |w|^2 is the usual objective over C * n
        trainer = LogisticRegression(
            featuresCol="_f", labelCol=label, probabilityCol=_P, rawPredictionCol="_raw", predictionCol="_hit", regParam=1.0 / (self.c * stats["_n"]), elasticNetParam=0.0,
            standardization=False, maxIter=self.max_iter, tol=1e-9,
        )
        self.model = trainer.fit(self._vectors(rows).withColumn(label, F.col(label).cast("double")))
        return self

    def _vectors(self, rows: DataFrame) -> DataFrame:
        z = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.mean, self.scale, strict=True)]
        return rows.withColumn("_f", array_to_vector(F.array(*z)))

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        out = self.model.transform(self._vectors(rows))
        return out.withColumn(name, synthetic_probability()).drop("_f", _P, "_raw", "_hit")

    def importance(self) -> dict[str, float] | None:
        return None


    def save(self, path: str) -> None:
        """The fitted model and its scaling."""
        self.model.write().overwrite().save(path + "/model")
        spark = SparkSession.getActiveSession()
        rows = list(zip(range(len(self.features)), self.features, self.mean, self.scale, strict=True))
        spark.createDataFrame(rows, "i int, feature string, mean double, scale double").coalesce(1).write.mode("overwrite").parquet(path + "/scaling")

    @classmethod
    def load(cls, path: str) -> Logistic:
        out = cls()
        rows = SparkSession.getActiveSession().read.parquet(path + "/scaling").orderBy("i").collect()
        out.features, out.mean, out.scale = [r["feature"] for r in rows], [r["mean"] for r in rows], [r["scale"] for r in rows]
        out.model = LogisticRegressionModel.load(path + "/model")
        return out


class Boosted:
    """Gradient-boosted trees; gain shares as importance."""

    def __init__(self, **parameters):
        self.parameters = BOOSTED | parameters

    def fit(self, rows: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None) -> Boosted:
        self.features = list(features)
        self.assembler = VectorAssembler(inputCols=self.features, outputCol="_f")
        extra = {"weightCol": weight} if weight else {}
        trainer = GBTClassifier(featuresCol="_f", labelCol=label, predictionCol="_hit", **self.parameters, **extra)
        # every round is a few jobs over all partitions: small tables need few
        parts = max(1, -(-rows.count() // ROWS_OF_PARTITION))
        kept = self.assembler.transform(rows.select(*self.features, F.col(label).cast("double").alias(label), *([weight] if weight else []))).coalesce(parts).cache()
        self.model = trainer.fit(kept)
        kept.unpersist()
        return self

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        out = self.model.transform(self.assembler.transform(rows))
        return out.withColumn(name, synthetic_probability("probability")).drop("_f", "probability", "rawPrediction", "_hit")

    def importance(self) -> dict[str, float]:
        return dict(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True))


    def save(self, path: str) -> None:
        self.assembler.write().overwrite().save(path + "/assembler")
        self.model.write().overwrite().save(path + "/model")

    @classmethod
    def load(cls, path: str) -> Boosted:
        out = cls()
        out.assembler, out.model = VectorAssembler.load(path + "/assembler"), GBTClassificationModel.load(path + "/model")
        out.features = out.assembler.getInputCols()
        return out


def synthetic_probability(column: str = _P) -> Column:
    """Probability of class 1."""
    return F.element_at(vector_to_array(F.col(column)), 2)


_MODELS = {"logistic": Logistic, "logistic_regression": Logistic, "lightgbm": Boosted, "boosted": Boosted}


def create_model(name: str) -> Logistic | Boosted:
    """A fresh model by name, in any case."""
    try:
        return _MODELS[name.strip().lower()]()
    except (KeyError, AttributeError):
        raise FusionModelError(f"unknown model {name!r}; known are {', '.join(sorted(_MODELS))}") from None


@dataclass
class CrossValidation:
    """Out-of-fold scores and what they are worth."""

    predictions: DataFrame
    metric: dict
    features: list[str]
    importance: list[tuple[str, float, float]] | None = field(default=None)

    @property
    def min_dcf(self) -> float:
        return self.metric["min_dcf"]

    @property
    def threshold(self) -> float:
        return self.metric["threshold"]

    @property
    def p_miss(self) -> float:
        return self.metric["p_miss"]

    @property
    def p_fa(self) -> float:
        return self.metric["p_fa"]


def cross_validate(table: DataFrame, model: str = "logistic", features: Sequence[str] | None = None) -> CrossValidation:
    """Each fold is scored by a model that never saw it; one score per row.

    Every fold's training rows must hold both classes, and there must be two folds.
    """
    chosen = check_cv_table(table, features)
    create_model(model)
    rows = table.select("file_id", F.col("label").cast("int").alias("label"), "fold", *chosen).cache()
    folds = [r["fold"] for r in rows.groupBy("fold").agg(F.min("file_id").alias("first")).orderBy("first").collect()]  # few by design
    if len(folds) < 2:
        raise FusionModelError("at least two folds are required")

    def fold_scores(k) -> tuple[DataFrame, dict[str, float] | None]:
        train, held = rows.filter(F.col("fold") != F.lit(k)), rows.filter(F.col("fold") == F.lit(k))
        if train.select("label").distinct().count() < 2:
            raise FusionModelError(f"training rows without fold {k!r} hold one class only")
        fitted = create_model(model).fit(train, chosen)
        return fitted.score(held).select("file_id", "label", "fold", "score"), fitted.importance()

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:  # a fit is many small jobs: folds fill each other's gaps
        found = list(pool.map(inheritable_thread_target(rows.sparkSession)(fold_scores), folds))
    parts = reduce(DataFrame.unionByName, (scored for scored, _ in found))
    gains = [gain for _, gain in found if gain is not None]
    counted = parts.agg(F.count(F.lit(1)).alias("n"), F.count_if(~not_finite("score")).alias("finite"), F.count_distinct("file_id").alias("ids")).first()
    if not counted["n"] == counted["finite"] == counted["ids"] == rows.count():
        raise FusionModelError("a row has no finite out-of-fold score, or more than one")
    found = evaluate_min_dcf(parts, "score", "label").first().asDict()
    ranked = None
    if gains:
        total = {c: sum(g[c] for g in gains) for c in chosen}
        ranked = sorted(((c, t / len(gains), t) for c, t in total.items()), key=lambda x: (-x[1], x[0]))
    return CrossValidation(parts, found, chosen, ranked)


def class_weights(rows: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Adds the weight n0 / max(n1, 1) for class 1 and 1 for class 0."""
    n = rows.agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).first()
    return rows.withColumn(name, F.when(F.col(label) == 1, F.lit(n["a"] / max(n["b"], 1))).otherwise(F.lit(1.0)))


def train_boosted(rows: DataFrame, features: Sequence[str], label: str = "label", **parameters) -> Boosted:
    """The training pipeline's trees: weighted classes, 500 rounds unless told otherwise."""
    return Boosted(**(BOOSTED_TRAINING | parameters)).fit(class_weights(rows, label), features, label, "weight")


class Projection:
    """Principal components of an array column, centred on the training rows."""

    def __init__(self, dimensions: int = 512):
        self.dimensions = dimensions

    def fit(self, rows: DataFrame, column: str) -> Projection:
        n, width = rows.select(F.count(F.lit(1)), F.max(F.size(column))).first()
        k = min(self.dimensions, width, n)
        self.column = column
        means = rows.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()  # one row per dimension
        self.mean = [float(r["m"]) for r in means]
        self.model = PCA(k=k, inputCol="_f", outputCol="_p").fit(self._centred(rows))
        return self

    def _centred(self, rows: DataFrame) -> DataFrame:
        middle = F.array(*[F.lit(m) for m in self.mean])
        return rows.withColumn("_f", array_to_vector(F.zip_with(self.column, middle, lambda x, m: x.cast("double") - m)))

    def apply(self, rows: DataFrame, name: str = "projected") -> DataFrame:
        return self.model.transform(self._centred(rows)).withColumn(name, vector_to_array("_p")).drop("_f", "_p")

    @property
    def explained(self) -> np.ndarray:
        return self.model.explainedVariance.toArray()


def expand(rows: DataFrame, column: str, width: int, prefix: str) -> tuple[DataFrame, list[str]]:
    """An array column as numbered columns."""
    names = [f"{prefix}{i}" for i in range(width)]
    return rows.select("*", *[F.get(column, F.lit(i)).alias(n) for i, n in enumerate(names)]), names


def stack(base: Mapping[str, DataFrame], labels: DataFrame, key: str = "file_id") -> tuple[Logistic, DataFrame]:
    """An unscaled logistic model over the base scores, columns by name, and the stacked training scores."""
    from .joins import stack_columns

    table = stack_columns(base, key).join(labels, key).cache()
    names = sorted(base)
    model = Logistic(max_iter=500, scaled=False).fit(table, names)
    return model, model.score(table).select(key, "label", *names, "score")
