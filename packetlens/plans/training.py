"""Labelled flows in, fitted models and their evaluation out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classifier import ForestSettings, score_classifier, train_classifier
from ..operators.evaluate import classification_report
from ..operators.forest import IsolationModel, IsolationSettings, score_isolation, train_isolation_forest
from ..operators.scoring import combine_scores
from ..operators.training import NORMAL_CAP, cap_rows, prepare_training, rebalance, stratified_split
from ..schemas import MODEL_FEATURES, TRAINING_FEATURES
from ..session import shared_dir


@dataclass(frozen=True)
class Models:
    isolation: IsolationModel
    classifier: PipelineModel
    report: DataFrame


def train_models(
    flows: DataFrame,
    key: list[str] = (),
    isolation: IsolationSettings = IsolationSettings(),
    forest: ForestSettings = ForestSettings(),
    normal_cap: int = NORMAL_CAP,
) -> Models:
    """Prepare, train both models and report the classifier on the held-out rows.

    `key` names columns of `flows` that identify a row, for reproducible sampling.
    """
    # Written to the shared folder after each step: the next one reads its rows several times.
    shared_dir(flows.sparkSession)
    sampling = list(key) or None
    rows = prepare_training(flows, list(key)).checkpoint()
    normal = cap_rows(rows.filter(F.col("label") == "Normal"), normal_cap, sampling).checkpoint()
    split = stratified_split(rebalance(rows, key=sampling).checkpoint(), key=sampling).checkpoint()
    classifier = train_classifier(split.filter(~F.col("is_test")), forest)
    tested = score_classifier(split.filter("is_test"), classifier)
    report = classification_report(tested.select(F.col("label").alias("actual"), F.col("class_label").alias("pred")))
    return Models(train_isolation_forest(normal, isolation, sampling), classifier, report)


def model_scorer(isolation: IsolationModel, classifier: PipelineModel):
    """Both models as one scorer for `detect`."""

    def score(df: DataFrame) -> DataFrame:
        renamed = dict(zip(MODEL_FEATURES, TRAINING_FEATURES))
        rows = df.withColumns({new: F.col(old) for old, new in renamed.items() if old != new})
        both = score_classifier(score_isolation(rows, isolation), classifier)
        return combine_scores(both).select(*df.columns, "ml_score", "ml_label")

    return score
