"""Capture-side rate cap and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import PROTOCOLS
from ..schemas import SECOND_US
from .spread import positions, slot

DEFAULT_CAP = 100_000
FINE_US = 1000


def rate_cap(
    df: DataFrame, cap: int = DEFAULT_CAP, bucket_us: int = SECOND_US, keys: list[str] = (), order: list[str] | None = None
) -> DataFrame:
    """The first `cap` packets of every time bucket (per key, if keys are given).

    Ranks come from counts per millisecond, so a flooded bucket is never sorted in one task, and
    milliseconds wholly beyond the cap are dropped before the sort.
    """
    order = order or ["ts_us", *[c for c in df.columns if c != "ts_us"]]
    bucketed = df.withColumn("bucket", slot("ts_us", bucket_us))
    fine = slot("ts_us", min(FINE_US, bucket_us))
    ranked = positions(bucketed, [*keys, "bucket"], fine, order, "_rank", upto=cap)
    return ranked.filter(F.col("_rank") <= cap).drop("_rank", "bucket")


def capture_counters(df: DataFrame, cap: int = DEFAULT_CAP, bucket_us: int = SECOND_US) -> DataFrame:
    """seen / filtered / dropped / sent, from packet counts per bucket alone."""
    wanted = F.col("protocol").isin(*PROTOCOLS)
    buckets = df.groupBy(slot("ts_us", bucket_us).alias("bucket")).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(wanted).alias("kept")
    )
    return buckets.agg(
        F.sum("seen").alias("seen"),
        F.sum(F.col("seen") - F.col("kept")).alias("filtered"),
        F.sum(F.greatest(F.lit(0), F.col("kept") - cap)).alias("dropped"),
        F.sum(F.least(F.lit(cap), F.col("kept"))).cast("bigint").alias("sent"),
    )
