"""Writers for training data, predictions, detections and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.forest import IsolationModel
from .tables import ACTUAL_TOKEN, PRED_TOKEN


def write_training(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Labelled rows to `path`/labelled, normal rows without their label to `path`/normal."""
    def save(rows, name):
        writer = rows.write.mode("overwrite")
        (writer.option("header", True).csv if format == "csv" else writer.parquet)(f"{path}/{name}")

    save(df, "labelled")
    save(df.filter(F.col("label") == "Normal").drop("label"), "normal")


def prediction_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(ACTUAL_TOKEN), "actual", F.lit(" " + PRED_TOKEN), "pred").alias("value"))


def write_predictions(df: DataFrame, path: str) -> None:
    """Append (actual, pred) rows to a prediction log."""
    prediction_lines(df).write.mode("append").text(path)


def write_prediction_stream(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start appending a stream of (actual, pred) rows to a prediction log.

    Spark's file sink notes each micro-batch's files in the folder, so a batch that is run again after a restart from the checkpoint
    adds its lines once; read the folder with `read_prediction_log`.
    """
    writer = prediction_lines(stream).writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start(path)


def write_detections(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start appending a detection stream to a Parquet table (exactly once per checkpoint)."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start(path)


def save_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_isolation(model: IsolationModel, path: str) -> None:
    """The node table plus a one-row table of its settings, both Parquet."""
    spark = model.nodes.sparkSession
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    facts = spark.createDataFrame(
        [(model.sample, model.offset, list(model.columns))], "sample int, offset double, columns array<string>"
    )
    facts.write.mode("overwrite").parquet(f"{path}/facts")


def load_isolation(spark: SparkSession, path: str) -> IsolationModel:
    facts = spark.read.parquet(f"{path}/facts").first()
    return IsolationModel(spark.read.parquet(f"{path}/nodes"), facts["sample"], facts["offset"], tuple(facts["columns"]))
