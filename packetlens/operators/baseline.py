"""Adaptive baselines and thresholds over rate series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequential import CHUNK_ROWS, fold, long_keys
from .spread import join_keys

# Fixed values: (jump ratio above which it applies, weight of the new value).
JUMP_WEIGHTS = ((5.0, 0.7), (2.0, 0.5))
STEADY_WEIGHT = 0.3
NEVER = 1e18  # threshold while there are too few samples


def next_baseline(b: float, x: float | None) -> float:
    """The baseline after a normal rate `x`; the bigger the jump, the faster it follows. A null rate leaves it."""
    if x is None:
        return b
    if b == 0.0:
        return x
    ratio = x / b
    weight = next((w for bound, w in JUMP_WEIGHTS if ratio > bound), STEADY_WEIGHT)
    return (1.0 - weight) * b + weight * x


def baseline_ewma(
    df: DataFrame, keys: list[str], order: list[str], value: str, block: Column | None = None, chunk_rows: int | None = CHUNK_ROWS
) -> DataFrame:
    """Add `baseline` (before the row) and `baseline_after` per key, in order.

    The rows of each key are counted first; keys of more than `chunk_rows` are folded in parallel chunks. `block` is a
    coarse prefix of the order for these (by default from the range of its first column). Without keys there is one
    baseline for all rows. A null value leaves the baseline as it is; a null key is a key like any other.
    """
    outputs = T.StructType([
        T.StructField("baseline", T.DoubleType()), T.StructField("baseline_after", T.DoubleType())
    ])

    def step(state, x):
        before, = state or (0.0,)
        after = next_baseline(before, x)
        return (after,), (before, after)

    state = T.StructType([T.StructField("baseline", T.DoubleType())])
    long = long_keys(df, keys, chunk_rows) if keys and chunk_rows else None
    return fold(df, keys, order, [value], outputs, step, state, (0.0,), block, chunk_rows or CHUNK_ROWS, long=long)


def final_baseline(df: DataFrame, keys: list[str], order: list[str], value: str, **how) -> DataFrame:
    """One row per key: the baseline after its last row."""
    rows = baseline_ewma(df, keys, order, value, **how)
    return rows.groupBy(*keys).agg(F.max_by("baseline_after", F.struct(*order)).alias("baseline"))


def adaptive_threshold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    block: Column,
    window: int = 300,
    k: float = 3.0,
    warmup: int = 50,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Score each row against the mean and deviation of the `window` rows before it in its key.

    Adds seen, samples, mean, stddev, lifetime_min, lifetime_max, threshold, warmed_up,
    is_suspicious (above mean + k sigma) and is_attack (above mean + 2k sigma). To reset, add a
    segment column to `keys`.

    `block` is a coarse prefix of `order`. Counts and extremes by block give each row its exact position and its key's lifetime
    extremes; chunks of `chunk_rows` positions (plus the `window` rows before) are then worked on
    independently, so a key of any length is spread over many tasks.
    """
    chunk_rows = max(chunk_rows, window)
    # One small row per block says what came before it: how many rows, and the lifetime extremes.
    sized = df.groupBy(*keys, block.alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = sized.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.min("_lo").over(earlier).alias("_lo"), F.max("_hi").over(earlier).alias("_hi"),
    )
    in_block = W.partitionBy(*keys, "_block").orderBy(*order)
    so_far = in_block.rowsBetween(W.unboundedPreceding, -1)
    placed = join_keys(df.withColumn("_block", block), before, [*keys, "_block"]).withColumns({
        "seen": F.col("_before") + F.row_number().over(in_block) - 1,
        "lifetime_min": F.least("_lo", F.min(value).over(so_far)),
        "lifetime_max": F.greatest("_hi", F.max(value).over(so_far)),
    }).drop("_before", "_lo", "_hi", "_block")
    # The last rows of a chunk are copied into the next one, as its history.
    homed = placed.withColumn("_home", F.floor(F.col("seen") / chunk_rows).cast("bigint"))
    near_end = F.col("seen") % chunk_rows >= chunk_rows - window
    chunks = F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    rows = homed.withColumn("_chunk", F.explode(chunks))
    past = W.partitionBy(*keys, "_chunk").orderBy("seen").rowsBetween(-window, -1)
    scored = rows.withColumns({
        "samples": F.count(value).over(past),
        "mean": F.avg(value).over(past),
        "stddev": F.stddev_samp(value).over(past),
    }).filter(F.col("_home") == F.col("_chunk"))
    enough = F.col("samples") >= 2
    ready = (F.col("seen") >= warmup) & enough
    limit = F.col("mean") + k * F.col("stddev")
    return scored.withColumns({
        "threshold": F.when(enough, limit).otherwise(NEVER),
        "warmed_up": F.col("seen") >= warmup,
        "is_suspicious": F.coalesce(ready & (F.col(value) > limit), F.lit(False)),
        "is_attack": F.coalesce(
            ready & (F.col(value) > F.col("mean") + 2 * k * F.col("stddev")), F.lit(False)
        ),
    }).drop("_home", "_chunk")
