"""The attack classifier: an MLlib random forest over the five training features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MODEL_FEATURES, TRAINING_FEATURES
from ..session import shared_dir
from .training import add_class_weights


@dataclass(frozen=True)
class ForestSettings:
    """Fixed default values of the classifier."""

    trees: int = 200
    depth: int = 20
    min_leaf: int = 5
    seed: int = 42


def train_classifier(df: DataFrame, settings: ForestSettings = ForestSettings()) -> PipelineModel:
    """Fit label index -> scaling -> forest -> label name, with balanced class weights."""
    shared_dir(df.sparkSession)
    weighted = add_class_weights(df.select(*TRAINING_FEATURES, "label")).checkpoint()
    indexer = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(weighted)
    stages = [
        VectorAssembler(inputCols=TRAINING_FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        RandomForestClassifier(
            featuresCol="scaled", labelCol="label_index", weightCol="weight", numTrees=settings.trees,
            maxDepth=settings.depth, minInstancesPerNode=settings.min_leaf, seed=settings.seed,
            # Deep trees: keep each row's node instead of shipping the growing trees to every task.
            cacheNodeIds=True, checkpointInterval=10,
        ),
        IndexToString(inputCol="prediction", outputCol="class_label", labels=indexer.labels),
    ]
    return Pipeline(stages=stages).fit(indexer.transform(weighted))


def score_classifier(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add `class_label` to feature rows."""
    as_trained = df.withColumn("conn_count", F.col(MODEL_FEATURES[-1])) if "conn_count" not in df.columns else df
    scored = model.transform(as_trained)
    return scored.select(*df.columns, "class_label")
