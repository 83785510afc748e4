"""Evaluating predictions: accuracy, per-class report, confusion matrix.

Everything starts from counts per (actual, pred), combined map-side, so the size of the later
steps depends on the number of classes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prediction_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("samples"))


def accuracy(df: DataFrame) -> DataFrame:
    """Share of rows with pred = actual."""
    right = F.count_if(F.col("actual") == F.col("pred"))
    return df.agg(F.count(F.lit(1)).alias("samples"), (right / F.count(F.lit(1))).alias("accuracy"))


def _cells(df: DataFrame) -> DataFrame:
    return df.groupBy("actual", "pred").agg(F.count(F.lit(1)).alias("n"))


def _per_class(df: DataFrame) -> DataFrame:
    # Each cell counts for its actual class (support) and for its predicted one.
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when((F.col("actual") == F.col("pred")) & (F.col("s.support") > 0), F.col("n")).otherwise(0)
    return (
        _cells(df).withColumn("s", F.explode(sides))
        .groupBy(F.col("s.label").alias("label"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum(hit).alias("hits"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_report(df: DataFrame) -> DataFrame:
    """precision, recall, f1, support per label, then accuracy, `macro avg` and `weighted avg` rows."""
    scored = _per_class(df).withColumns({
        "precision": _ratio(F.col("hits"), F.col("predicted")), "recall": _ratio(F.col("hits"), F.col("support")),
    })
    p, r = F.col("precision"), F.col("recall")
    per_class = scored.withColumn("f1", _ratio(2 * p * r, p + r))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = per_class.agg(*[F.avg(c).alias(c) for c in names], total.alias("support"))
    weighted = per_class.agg(*[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names], total.alias("support"))
    overall = per_class.agg(
        *[(F.sum("hits") / total).alias(c) for c in names], total.alias("support")
    )
    out = ["label", *names, "support"]
    rows = per_class.select(*out)
    for name, part in (("accuracy", overall), ("macro avg", macro), ("weighted avg", weighted)):
        rows = rows.unionByName(part.withColumn("label", F.lit(name)).select(*out))
    return rows


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Count of every (actual, pred) pair over the union of labels, zero cells included."""
    cells = _cells(df)
    both = F.array_distinct(F.flatten(F.collect_set(F.array("actual", "pred"))))
    labels = cells.agg(F.sort_array(both).alias("labels"))
    grid = labels.select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("pred")
    )
    return grid.join(cells, ["actual", "pred"], "left").select(
        "actual", "pred", F.coalesce("n", F.lit(0)).alias("n")
    )
