"""Classifiers over stroke features with Spark ML: missing-value indicators, balanced weights, held-out scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matching import classification_report

#: Features of another version are not read by a model.
FEATURE_VERSION = 2  # 263 values; version 1 had 240


def dense(features: Column) -> Column:
    """A vector of the features with 0 for missing ones, followed by what is missing (ML vectors hold no missing values)."""
    return array_to_vector(F.concat(F.transform(features, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(None)), F.lit(0.0))), F.transform(features, lambda v: (v.isNull() | F.isnan(v.cast("double"))).cast("double"))))


def fit(rows: DataFrame, target: str, features: str = "features", trees: int = 20, depth: int = 6, seed: int = 0) -> PipelineModel:
    """A forest for one target; each label weighs as much as the others."""
    counts = rows.groupBy(target).agg(F.count("*").alias("_n"))  # one row per label
    weights = counts.withColumn("_w", F.sum("_n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_n"))).drop("_n")
    weighted = rows.join(weights, target).withColumn("_v", dense(F.col(features)))
    return Pipeline(stages=[
        StringIndexer(inputCol=target, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=["_v"], outputCol="_x"),
        RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_p"),
    ]).fit(weighted)


def predict(model: PipelineModel, rows: DataFrame, target: str, features: str = "features") -> DataFrame:
    """rows with <target>_pred and <target>_conf (to 3 places)."""
    labels = [*model.stages[0].labels]
    out = model.stages[2].transform(model.stages[1].transform(rows.withColumn("_v", dense(F.col(features)))))
    p = F.slice(vector_to_array("_p"), 1, len(labels))
    names = F.array(*[F.lit(x) for x in labels])
    return out.withColumn("_a", p).select(*rows.columns, F.element_at(names, F.array_position("_a", F.array_max("_a")).cast("int")).alias(f"{target}_pred"), F.round(F.array_max("_a"), 3).alias(f"{target}_conf"))


#: What is said of a stroke.
TARGETS = ("hand", "technique", "lean", "feet")


def fit_all(rows: DataFrame, targets: tuple[str, ...] = TARGETS, **options) -> dict[str, PipelineModel]:
    """A forest for each target."""
    return {t: fit(rows.where(F.col(t).isNotNull()), t, **options) for t in targets}


def predict_all(fitted: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """rows with <target>_pred and <target>_conf of every target."""
    for target, model in fitted.items():
        rows = predict(model, rows, target)
    return rows


def side_report(predicted: DataFrame, side: str | None = "right", targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """target, n, accuracy, macro_f1 of predicted labels, over the strokes of one side (None: both)."""
    rows = predicted if side is None else predicted.where(F.col("side") == side)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("label"), F.col(f"{t}_pred").alias("guess")) for t in targets]))
    return classification_report(rows.select(each.alias("r")).select("r.*"), "label", "guess", "target")


def heuristic(first_of_rally: Column) -> Column:
    """What is said without a model: a rally's first stroke is a serve, all else is unknown."""
    return F.struct(F.lit("unknown").alias("hand"), F.when(first_of_rally, "serve").otherwise("unknown").alias("technique"), F.lit("unknown").alias("lean"), F.lit("unknown").alias("feet"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(f"{path}/v{FEATURE_VERSION}")


def load(path: str) -> PipelineModel:
    """The model for this version of the features; one of another version isn't found."""
    return PipelineModel.load(f"{path}/v{FEATURE_VERSION}")
