"""Text rendering shared by reasons, log lines and panels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c, digits: int) -> Column:
    """A non-negative number with a fixed count of decimals.

    Rendered from one scaled integer (half up), so that any engine prints the same digits.
    """
    scaled = F.floor(_col(c) * F.lit(float(10**digits)) + F.lit(0.5)).cast("decimal(18,0)")
    return (scaled * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(24,{digits})").cast("string")


def score_text(c) -> Column:
    """A score as the first six characters of its six-decimal form."""
    return F.substring(fixed(c, 6), 1, 6)


def whole(c) -> Column:
    """Truncate a non-negative number to an integer, as text."""
    return F.floor(_col(c)).cast("bigint").cast("string")


def human_count(c) -> Column:
    """`999`, `1.5K`, `2.25M`."""
    c = _col(c)
    return (
        F.when(c < 1000, c.cast("string"))
        .when(c < 1_000_000, F.concat(fixed(c / F.lit(1000.0), 1), F.lit("K")))
        .otherwise(F.concat(fixed(c / F.lit(1000000.0), 2), F.lit("M")))
    )


def health_band(c, lo: float, hi: float) -> Column:
    """`good` below lo, `fair` below hi, else `high`."""
    c = _col(c)
    return F.when(c < lo, "good").when(c < hi, "fair").otherwise("high")


def attention(c) -> Column:
    """True when a counter that should stay at zero (alerts, drops) does not."""
    return _col(c) > 0


# The text layouts of log and alert lines.
ATTACK_BADGE = "◉ ATTACK"
SUSPICIOUS_BADGE = "◈ SUSPICIOUS"
IP_WIDTH = 15


def log_level(severity="severity") -> Column:
    return F.when(_col(severity) == 2, "ATTACK").otherwise("WARN")


def to_log(df):
    """Alerts -> log entries (ts_us, level, message)."""
    level = log_level()
    message = F.concat(
        F.lit("["), level, F.lit("] "), F.col("attack_type"), F.lit(" from "), F.col("src_ip_str"),
        F.lit(" — "), F.col("reason"),
    )
    return df.filter(F.col("severity") > 0).select("ts_us", level.alias("level"), message.alias("message"))


def to_alert_line(df):
    """Alerts -> one display line each, the address padded to a column."""
    ip = F.col("src_ip_str")
    padded = F.when(F.length(ip) < IP_WIDTH, F.rpad(ip, IP_WIDTH, " ")).otherwise(ip)
    clock = F.date_format(F.timestamp_micros("ts_us"), "HH:mm:ss.SSS")
    badge = F.when(F.col("severity") == 2, ATTACK_BADGE).otherwise(SUSPICIOUS_BADGE)
    line = F.concat(
        F.lit("["), clock, F.lit("]  "), badge, F.lit("  "), padded, F.lit("  |  "),
        F.col("attack_type"), F.lit("  |  "), F.col("reason"),
    )
    return df.filter(F.col("severity") > 0).select("ts_us", "src_ip", line.alias("line"))
