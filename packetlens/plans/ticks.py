"""The per-second system table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.net import PROTOCOLS
from ..operators.monitor import latency_ticks, second
from ..operators.ratecap import DEFAULT_CAP
from ..schemas import ATTACK, FLOW_KEY, SUSPICIOUS

#: What a second adds up.
SUMS = ["packets", "bytes", "wanted", "change", "suspicious", "attack"]


def wanted() -> Column:
    """Packets that pass the protocol filter."""
    return F.count_if(F.col("protocol").isin(*PROTOCOLS))


def _packet_seconds(packets: DataFrame, idle_secs: int) -> DataFrame:
    """Per second: packets, bytes, wanted packets, and by how many the active flows change.

    Packets shrink to one row per flow and second, map-side. A flow adds one where it wakes and takes one away after it
    has been idle.
    """
    per_flow = packets.groupBy(*FLOW_KEY, second().alias("sec")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("packet_size").cast("bigint")).alias("bytes"), wanted().alias("wanted"))
    in_order = W.partitionBy(*FLOW_KEY).orderBy("sec")
    wakes = F.coalesce(F.col("sec") - F.lag("sec").over(in_order) > idle_secs, F.lit(True)).cast("bigint")
    sleeps = F.coalesce(F.lead("sec").over(in_order) - F.col("sec") > idle_secs, F.lit(True)).cast("bigint")
    flagged = per_flow.withColumns({"wakes": wakes, "sleeps": sleeps})
    none = F.lit(0).cast("bigint")
    here = F.struct("sec", "packets", "bytes", "wanted", F.col("wakes").alias("change"), F.lit(True).alias("live"))
    later = F.struct(
        (F.col("sec") + idle_secs).alias("sec"), none.alias("packets"), none.alias("bytes"), none.alias("wanted"),
        (-F.col("sleeps")).alias("change"), F.lit(False).alias("live"),
    )
    marks = flagged.select(F.explode(F.array(here, later)).alias("m")).select("m.*")
    return marks.groupBy("sec").agg(*[F.sum(c).alias(c) for c in SUMS[:4]], F.max("live").alias("live"))


def system_ticks(
    packets: DataFrame, detections: DataFrame, latencies: DataFrame | None = None, cap: int = DEFAULT_CAP, idle_secs: int = 9
) -> DataFrame:
    """Throughput, totals, drops, alerts, active flows and latency of every second from the first packet to the last.

    Drops are a running count, of packets that pass the protocol filter and then exceed `cap` in their second. A second without
    packets has rates of 0 and repeats the counts, totals and latency so far. Packets and detections are read once, each
    reduced to one row per second; those rows are ordered in one task.
    """
    per_second = _packet_seconds(packets, idle_secs)
    alerts = detections.groupBy(second().alias("sec")).agg(
        F.count_if(F.col("severity") == SUSPICIOUS).alias("suspicious"), F.count_if(F.col("severity") == ATTACK).alias("attack"))
    rows = per_second.unionByName(alerts, allowMissingColumns=True)
    late = ["latency_avg_ns", "latency_p99_ns"] if latencies is not None else []
    if late:
        rows = rows.unionByName(latency_ticks(latencies), allowMissingColumns=True)
    joined = rows.groupBy("sec").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.coalesce(F.max("live"), F.lit(False)).alias("live"), *[F.max(c).alias(c) for c in late])
    so_far = W.orderBy("sec").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per second
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    over = F.greatest(F.lit(0).cast("bigint"), F.col("wanted") - cap)
    totals = {
        "total_packets": F.col("packets"), "dropped_packets": over, "alerts_suspicious": F.col("suspicious"),
        "alerts_attack": F.col("attack"), "total_alerts": F.col("suspicious") + F.col("attack"), "active_flows": F.col("change"),
    }
    counted = joined.select(
        "sec", "packets", "bytes", *[F.sum(v).over(so_far).alias(c) for c, v in totals.items()],
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in late],
        F.lead("sec").over(W.orderBy("sec")).alias("next"),
        *[f(F.when(F.col("live"), F.col("sec"))).over(whole).alias(c) for f, c in ((F.min, "first"), (F.max, "last"))],
    ).filter(F.col("sec").between(F.col("first"), F.col("last")))
    until = F.least(F.coalesce("next", F.col("last") + 1), F.col("last") + 1) - 1
    every = counted.withColumn("at", F.explode(F.sequence(F.col("sec"), until)))
    rates = [F.when(F.col("at") == F.col("sec"), F.col(c)).otherwise(0).cast("double").alias(f"{c}_per_sec") for c in ("packets", "bytes")]
    return every.select(F.col("at").alias("sec"), *rates, *totals, *late)
