"""Result tables and models kept between jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerscope.session import staging_path


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, codec: str = "none") -> None:
    df.write.mode("overwrite").option("header", True).csv(path, compression=codec)


def read_parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it is there, else the frame ``build`` describes."""
    stored = read_parquet_or_none(spark, path)
    return build() if stored is None else stored


def read_parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    stored = read_parquet_or_none(spark, path)
    return spark.createDataFrame([], schema) if stored is None else stored


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        stored = spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema)
    return stored


def stage_model(spark: SparkSession, model: Model, label: str) -> Model:
    """Write a fitted model to the staging folder and read it back, without the summary of its training.

    A logistic model's summary holds the session, which tasks cannot be sent once the session has observed a figure.
    """
    path = staging_path(spark, label)
    model.write().save(path)
    return type(model).load(path)


def save_model(
    model: PipelineModel, path: str, name: str, features: Sequence[str], metrics: DataFrame
) -> None:
    """Keep a fitted pipeline with its name, feature order and the comparison table."""
    model.write().overwrite().save(f"{path}/model")
    about = metrics.agg(F.collect_list(F.struct(*metrics.columns)).alias("metrics")).select(
        F.lit(name).alias("model_name"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        "metrics",
    )  # one row: metrics has a row per model
    about.write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, str, list[str], DataFrame]:
    about = read_parquet_or_none(spark, f"{path}/about")
    if about is None:
        raise FileNotFoundError(f"no model at {path}: train and save one first")
    row = about.select("model_name", "features").first()
    metrics = about.select(F.explode("metrics").alias("m")).select("m.*")
    return PipelineModel.load(f"{path}/model"), row["model_name"], list(row["features"]), metrics
