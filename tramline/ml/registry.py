"""Kept models, their metrics and versions."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.sources import claims

METRICS_LOG = "model string, score double, logged_at timestamp, version string"


def best_models(metrics: DataFrame) -> DataFrame:
    """Best algorithm per target by test score; the first name on a tie."""
    best = F.min(F.struct((-F.col("test_score")).alias("minus"), "algorithm", "task")).alias("best")
    return metrics.groupBy("target").agg(best).select(
        "target", "best.task", "best.algorithm", (-F.col("best.minus")).alias("test_score")
    )


def best_overall(metrics: DataFrame) -> DataFrame:
    return best_models(metrics).orderBy(F.desc("test_score"), "target").limit(1)


def wins(metrics: DataFrame) -> DataFrame:
    """Targets won per algorithm."""
    return best_models(metrics).groupBy("algorithm").agg(F.count("*").alias("wins"))


def next_version(log: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Latest version of each model with the patch raised; ``0.0.1`` for a new model."""
    part = F.split("version", r"\.")
    number = F.struct(*[
        F.get(part, F.lit(i)).cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))
    ])
    latest = log.groupBy("model").agg(F.max(number).alias("v"))
    if models is not None:
        latest = models.select("model").distinct().join(latest, "model", "left")
    raised = F.concat_ws(".", "v.major", "v.minor", F.col("v.patch") + 1)
    return latest.select(
        "model", F.when(F.col("v").isNull(), "0.0.1").otherwise(raised).alias("next_version")
    )


def claim_version(spark: SparkSession, path: str, model: str) -> str:
    """The next version of a model, claimed by creating its file.

    Creating fails if the file is there, so of two writers that want one version the later
    takes the next; a claim without metrics (a writer that died) is never given again.
    """
    folder = f"{path}/versions/{quote(model, safe='')}"
    wanted = spark.createDataFrame([(model,)], "model string")
    while True:
        log = spark.createDataFrame([(model, v) for v in claims.names(spark, folder)], "model string, version string")
        version = next_version(log, wanted).first()["next_version"]
        if claims.claim(spark, folder, version):
            return version


def log_metrics(spark: SparkSession, path: str, model: str, score: float) -> str:
    """Append score, time and next version of a model; returns the version."""
    version = claim_version(spark, path, model)
    spark.createDataFrame([(model, float(score), version)], "model string, score double, version string").select(
        "model", "score", F.current_timestamp().alias("logged_at"), "version"
    ).write.mode("append").parquet(f"{path}/metrics")
    return version


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_LOG).parquet(f"{path}/metrics")


def keep_winner(spark: SparkSession, path: str, preparation: PipelineModel, winner: Model, metrics: DataFrame) -> PipelineModel:
    """Preparation (with its encoders) and the winner of a grid as one saved pipeline."""
    whole = PipelineModel(stages=[*preparation.stages, winner])
    save_best(spark, path, whole, metrics)
    return whole


def save_best(spark: SparkSession, path: str, model: PipelineModel, metrics: DataFrame) -> None:
    """The pipeline (preprocessing and model together) with its metrics row."""
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def load_best(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/metrics")
