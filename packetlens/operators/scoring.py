"""Scores and labels for feature rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MODEL_FEATURES
from .features import feature_bucket
from .spread import TASK_ROWS, deal, tasks_for

Scorer = Callable[[DataFrame], DataFrame]
"""A scorer takes feature rows and adds `ml_score` DOUBLE and `ml_label` STRING."""


def _usable() -> Column:
    ok = F.lit(True)
    for c in MODEL_FEATURES:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def score_heuristic(df: DataFrame) -> DataFrame:
    """The scorer used when no model is supplied. Unusable features score (0, Normal)."""
    # The limits, scores and labels of the heuristic.
    ports, syns, rate = F.col("unique_ports"), F.col("syn_count"), F.col("packet_rate")
    severe = (ports > 20) | (syns > 40) | (rate > 400)
    odd = (rate > 100) | (syns > 15)
    score = F.when(~_usable(), 0.0).when(severe, 1.0).when(odd, 0.7).otherwise(0.0)
    label = (
        F.when(~_usable(), "Normal").when(ports > 20, "PortScan").when(syns > 40, "SYNFlood")
        .when(rate > 400, "DoS").when(odd, "Suspicious").otherwise("Normal")
    )
    return df.withColumns({"ml_score": score, "ml_label": label})


def combine_scores(df: DataFrame) -> DataFrame:
    """ml_score, ml_label from `raw_score` (isolation, negative), `is_anomaly` and `class_label`."""
    # The score floors of an anomaly (.5) and of a named class (.6), four decimals.
    label = F.coalesce(F.col("class_label"), F.lit("Normal"))
    isolated = F.coalesce(F.col("is_anomaly"), F.lit(False))
    base = F.when(isolated, F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.col("raw_score") * -2.0))).otherwise(0.0)
    score = F.when(label != "Normal", F.greatest(base, F.lit(0.6))).otherwise(base)
    return df.withColumns({"ml_score": F.floor(score * 10000.0 + 0.5) / 10000.0, "ml_label": label})


def score_bucketed(
    df: DataFrame, scorer: Scorer, order: list[str], rows_each: int = 1_000_000, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Score one row per feature bucket (the first by `order`) and give its result to the bucket.

    Buckets are reduced with map-side combine. A bucket of more than `rows_each` rows has its scored row copied once for
    each so many and its rows dealt to the copies, so that it meets them in as many tasks as its size asks; all others
    have one copy. Large buckets, at most one for each `rows_each` rows, are known to all tasks. Rows meet their scores in a
    task for each `task_rows` of them, so that no task's sort grows with the table; they are counted for that, which runs a job.
    """
    tasks = tasks_for(df, task_rows)
    rows = feature_bucket(df)
    columns = [*MODEL_FEATURES, "syn_ratio", "port_scan_rate", "bytes_per_sec"]
    first = F.min(F.struct(*order, *[F.col(c).alias("f_" + c) for c in columns])).alias("first")
    sized = rows.groupBy("bucket").agg(first, F.ceil(F.count(F.lit(1)) / rows_each).cast("int").alias("_copies"))
    sample = sized.select("bucket", "_copies", *[F.col("first.f_" + c).alias(c) for c in columns])
    scored = scorer(sample).select("bucket", "_copies", "ml_score", "ml_label")
    copies = scored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    large = F.broadcast(sized.filter("_copies > 1").select(F.col("bucket").alias("_large"), "_copies"))
    dealt = rows.join(large, F.col("bucket").eqNullSafe(F.col("_large")), "left")
    salt = F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*order), F.col("_copies"))).cast("int")
    dealt = deal(dealt.withColumn("_salt", salt).drop("_large", "_copies"), tasks, "bucket", "_salt")
    return dealt.join(deal(copies, tasks, "bucket", "_salt"), ["bucket", "_salt"]).drop("bucket", "_salt")


def bucket_reuse(df: DataFrame) -> DataFrame:
    """How many rows share how many buckets, and the share of scores that are reused."""
    per_bucket = feature_bucket(df).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return per_bucket.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("buckets"),
        ((F.sum("n") - F.count(F.lit(1))) / F.sum("n")).alias("reuse_ratio"),
    )
