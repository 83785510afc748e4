"""Behaviour features of a packet, their scaling and their coarse buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MODEL_FEATURES

# Rounding step of each model feature in a bucket key.
BUCKET_STEPS = {
    "packet_rate": 5.0,
    "unique_ports": 1.0,
    "syn_count": 2.0,
    "avg_packet_size": 50.0,
    "connection_count": 5.0,
}
# Factor or divisor of each derived feature in a bucket key.
BUCKET_FACTORS = {"syn_ratio": 20.0, "port_scan_rate": 5.0}
BUCKET_DIVISORS = {"bytes_per_sec": 1000.0}
NOT_A_NUMBER = -1  # bucket value of NaN; others are 0 or more
FLAT = 1e-9  # ranges and deviations below this scale to 0


def features(stats: DataFrame, window_secs: int = 3) -> DataFrame:
    """Five raw and three derived features, all DOUBLE, from `flow_stats` columns."""
    source = F.col("src_total_packets").cast("double")
    ports = F.col("src_unique_dst_ports").cast("double")
    syns = F.col("syn_count").cast("double")
    return stats.withColumns({
        "unique_ports": ports,
        "syn_count": syns,
        "connection_count": source,
        "syn_ratio": F.when(source > 0, syns / source).otherwise(0.0),
        "port_scan_rate": ports / F.lit(float(window_secs)),
        "bytes_per_sec": F.col("packet_rate") * F.col("avg_packet_size"),
    })


def feature_bucket(df: DataFrame, name: str = "bucket") -> DataFrame:
    """Add a struct of eight longs, equal for near-identical feature rows. Null and NaN have values of their own."""

    def component(value: Column) -> Column:
        whole = F.floor(F.greatest(F.lit(0.0), value * 10.0)).cast("bigint")
        return F.when(value.isNull(), F.lit(None).cast("bigint")).when(F.isnan(value), NOT_A_NUMBER).otherwise(whole)

    def floor(value: Column) -> Column:
        return F.when(F.isnan(value), value).otherwise(F.floor(value).cast("double"))

    parts = [
        component(floor(F.col(c) / step + 0.5) * step).alias(c) for c, step in BUCKET_STEPS.items()
    ]
    parts += [component(floor(F.col(c) * factor)).alias(c) for c, factor in BUCKET_FACTORS.items()]
    parts += [component(floor(F.col(c) / divisor)).alias(c) for c, divisor in BUCKET_DIVISORS.items()]
    return df.withColumn(name, F.struct(*parts))


def fit_scaler(df: DataFrame, order: list[str], n: int = 200, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """One row of statistics over the first `n` rows by `order` (which must be unique).

    Columns: `rows_fitted`, `fit_size`, `last` (order key of the last fitted row) and a struct
    `<feature>` of min, max, mean, stddev per feature.
    """
    first = df.orderBy(*order).limit(n)
    stats = [
        F.struct(
            F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev")
        ).alias(c)
        for c in columns
    ]
    return first.agg(
        F.count(F.lit(1)).alias("rows_fitted"),
        F.max(F.lit(n)).alias("fit_size"),
        F.max(F.struct(*order)).alias("last"),
        *stats,
    )


def override_range(stats: DataFrame, feature: str, lo: float, hi: float) -> DataFrame:
    """Replace the fitted minimum and maximum of one feature."""
    changed = F.col(feature).withField("min", F.lit(float(lo))).withField("max", F.lit(float(hi)))
    return stats.withColumn(feature, changed)


def _scaled(value: Column, stat: Column, mode: str) -> Column:
    if mode == "minmax":
        width = stat["max"] - stat["min"]
        unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - stat["min"]) / width))
        return F.when(value.isNull() | F.isnan(value), value).when(width < FLAT, 0.0).otherwise(unit)
    if mode == "zscore":
        flat = stat["stddev"].isNull() | (stat["stddev"] < FLAT)
        return F.when(flat, 0.0).otherwise((value - stat["mean"]) / stat["stddev"])
    raise ValueError(f"unknown mode {mode}")


def _features_of(stats: DataFrame) -> list[str]:
    return [c for c in stats.columns if c not in ("rows_fitted", "fit_size", "last")]


def apply_scaler(df: DataFrame, stats: DataFrame, mode: str = "minmax") -> DataFrame:
    """Scale every fitted feature; other columns pass through. Unfitted statistics change nothing.

    The one-row statistics enter as a scalar subquery: no join and no shuffle of `df`.
    """
    row = F.col("_fit")
    fitted = row["rows_fitted"] >= row["fit_size"]
    return _with_fit(df, stats).withColumns({
        c: F.when(fitted, _scaled(F.col(c), row[c], mode)).otherwise(F.col(c)) for c in _features_of(stats)
    }).drop("_fit")


def _with_fit(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the statistics as a struct `_fit`: planned once, however often it is used."""
    return df.withColumn("_fit", stats.select(F.struct(*stats.columns)).scalar())


def fit_transform(
    df: DataFrame, order: list[str], n: int = 200, mode: str = "minmax", stats: DataFrame | None = None
) -> DataFrame:
    """Rows before the n-th by `order` stay raw (warm-up); the n-th and later ones are scaled.

    `stats` are statistics fitted before over the same first rows.
    """
    stats = fit_scaler(df, order, n) if stats is None else stats
    row = F.col("_fit")
    ready = (row["rows_fitted"] >= row["fit_size"]) & (F.struct(*order) >= row["last"])
    return _with_fit(df, stats).withColumns({
        c: F.when(ready, _scaled(F.col(c), row[c], mode)).otherwise(F.col(c)) for c in MODEL_FEATURES
    }).drop("_fit")


def scaler_stats(stats: DataFrame) -> DataFrame:
    """The statistics as one row per feature, with whether the fit is complete."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(c)[f].alias(f) for f in ("min", "max", "mean", "stddev")])
        for c in _features_of(stats)
    ])
    return stats.withColumn("s", F.explode(rows)).select(
        "s.*", "rows_fitted", (F.col("rows_fitted") >= F.col("fit_size")).alias("is_fitted")
    )
