"""Cleaning expressions for labelled flow data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw label of the public flow dataset -> class.
LABEL_CLASSES = {
    "BENIGN": "Normal",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "Heartbleed": "DoS",
    "DDoS": "DDoS",
    "PortScan": "PortScan",
    "FTP-Patator": "BruteForce",
    "SSH-Patator": "BruteForce",
    "Web Attack  Brute Force": "WebAttack",
    "Web Attack  XSS": "WebAttack",
    "Web Attack  Sql Injection": "WebAttack",
    "Infiltration": "Infiltration",
    "Bot": "Botnet",
}

# Clip bounds of the training columns.
RATE_BOUNDS = (0.0, 1_000_000.0)
SIZE_BOUNDS = (0.0, 1518.0)
SYN_BOUNDS = (0.0, 500.0)
CONN_BOUNDS = (0.0, 100_000.0)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_label(c) -> Column:
    """Trimmed raw label -> class, `Other` when unknown or null."""
    table = F.create_map(*[F.lit(x) for pair in LABEL_CLASSES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(_col(c))), F.lit("Other"))


def bin_port(c) -> Column:
    """Destination port -> rough port-diversity count."""
    c = _col(c)
    return F.when(c < 1024, 1.0).when(c < 10000, 3.0).otherwise(F.floor(c / 10000.0) + 4).cast("double")


def clip(c, bounds: tuple[float, float]) -> Column:
    """The value within its bounds; null and NaN stay what they are."""
    lo, hi = bounds
    c = _col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))
