"""Fitted models on shared storage, with one row of training metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from vectide.operators.trainer import Network, load_network, save_network


def save_model(model: PipelineModel | Network, training: DataFrame, folder: str) -> None:
    """Writes the fitted model (its scaling included) and the one-row `training` table."""
    if training.limit(2).count() != 1:
        raise ValueError("training must have one row")
    if isinstance(model, Network):
        save_network(training.sparkSession, model, f"{folder}/network")
    else:
        model.write().overwrite().save(f"{folder}/model")
    training.write.mode("overwrite").parquet(f"{folder}/training")


def load_model(spark: SparkSession, folder: str) -> PipelineModel | Network:
    try:
        return load_network(spark, f"{folder}/network")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return PipelineModel.load(f"{folder}/model")


def model_info(spark: SparkSession, folder: str) -> tuple[str, DataFrame | None]:
    """("ready", training metadata), ("no_model", None), or ("error", None) for an unreadable model."""
    try:
        training = spark.read.parquet(f"{folder}/training")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return "no_model", None
        return "error", None
    try:
        load_model(spark, folder)
    except Exception:  # the parts may fail to load in any way
        return "error", None
    return "ready", training
