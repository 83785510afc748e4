"""Monitoring views: throughput, alerts, latency, hosts, logs.

Running totals are taken over per-second tables only, whose size is the length of the capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import ATTACK, FLOW_KEY, NORMAL, SECOND_US, SUSPICIOUS
from .spread import positions, slot, take_first


def second(ts: str = "ts_us") -> Column:
    return slot(ts, SECOND_US)


def _so_far(column: str) -> Column:
    return F.sum(column).over(W.orderBy("sec").rowsBetween(W.unboundedPreceding, W.currentRow))


def throughput(packets: DataFrame, *more: Column) -> DataFrame:
    """Packets and bytes per second, and further aggregates."""
    return packets.groupBy(second().alias("sec")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("packet_size").cast("bigint")).alias("bytes"), *more
    )


def running_totals(ticks: DataFrame) -> DataFrame:
    """Add the packets and bytes seen up to each second."""
    return ticks.withColumns({"total_packets": _so_far("packets"), "total_bytes": _so_far("bytes")})


def alerts(detections: DataFrame) -> DataFrame:
    return detections.filter(F.col("severity") > NORMAL)


def alert_counts(detections: DataFrame) -> DataFrame:
    """Alerts per second and so far."""
    per_second = detections.groupBy(second().alias("sec")).agg(
        F.count_if(F.col("severity") == SUSPICIOUS).alias("suspicious"),
        F.count_if(F.col("severity") == ATTACK).alias("attack"),
    )
    return per_second.withColumns({
        "alerts_suspicious": _so_far("suspicious"), "alerts_attack": _so_far("attack"),
    }).withColumn("total_alerts", F.col("alerts_suspicious") + F.col("alerts_attack"))


def alert_totals(detections: DataFrame) -> DataFrame:
    return detections.agg(
        F.count_if(F.col("severity") == ATTACK).alias("attack"),
        F.count_if(F.col("severity") == SUSPICIOUS).alias("suspicious"),
    )


def search_alerts(detections: DataFrame, text: str) -> DataFrame:
    """Alerts whose address, type or reason contains the text, in any case."""
    where = F.lower(F.concat_ws(" ", "src_ip_str", "attack_type", "reason"))
    return alerts(detections).filter(F.contains(where, F.lit(text.lower())))


def search_hosts(hosts: DataFrame, text: str) -> DataFrame:
    return hosts.filter(F.contains(F.col("src_ip_str"), F.lit(text)))


def search_logs(logs: DataFrame, level: str = "ALL", text: str = "") -> DataFrame:
    """Log entries of a level (or ALL) with the text in message or level, in any case."""
    found = logs if level == "ALL" else logs.filter(F.col("level") == level)
    wanted = F.lit(text.lower())
    return found.filter(F.contains(F.lower("message"), wanted) | F.contains(F.lower("level"), wanted))


def notifications(detections: DataFrame) -> DataFrame:
    """One message per attack."""
    message = F.concat("attack_type", F.lit("  —  "), "src_ip_str")
    return detections.filter(F.col("severity") == ATTACK).select("ts_us", message.alias("message"))


def recent_alerts(detections: DataFrame, n: int = 500, ties: list[str] = ()) -> DataFrame:
    rest = ties or [c for c in detections.columns if c != "ts_us"]
    return alerts(detections).orderBy(F.col("ts_us").desc(), *rest).limit(n)


def recent_logs(logs: DataFrame, n: int = 2000) -> DataFrame:
    return logs.orderBy(F.col("ts_us").desc(), "message", "level").limit(n)


def flagged_hosts(detections: DataFrame) -> DataFrame:
    """Per source with alerts: hits, attack hits, last type and status, highest score.

    First counted per (source, type, severity) with plain map-side combined aggregates, which
    shrinks a flooding source to a few rows, then rolled up per source.
    """
    kinds = alerts(detections).groupBy("src_ip", "src_ip_str", "attack_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("ts_us"), F.max("anomaly_score").alias("score")
    )
    latest = F.struct("ts_us", "severity", "attack_type")
    return kinds.groupBy("src_ip", "src_ip_str").agg(
        F.sum("n").alias("hits"),
        F.sum(F.when(F.col("severity") == ATTACK, F.col("n")).otherwise(0)).alias("attack_hits"),
        F.max_by("attack_type", latest).alias("last_type"),
        F.max("score").alias("max_score"),
        F.max_by("severity", latest).alias("last_severity"),
        F.max("ts_us").alias("last_ts_us"),
    )


def hosts_tracked(detections: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return alerts(detections).agg(count(F.col("src_ip")).alias("hosts"))


def _newest(df: DataFrame, last_n: int, detected: str, key: Column) -> DataFrame:
    """The newest `last_n` rows of each `key` and some more, as (key, at, ts_us, n): equal times are one row with a count.

    Counts by millisecond, combined map-side, tell the millisecond in which a key's newest rows start; older rows
    are dropped before any are shuffled. The cuts are one row for each key with more than `last_n` rows.
    """
    rows = df.select(key.alias("key"), F.col(detected).alias("at"), "ts_us")
    fine = slot("at", 1000).alias("ms")
    counts = rows.groupBy("key", fine).agg(F.count(F.lit(1)).alias("n"))
    newer = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy(F.col("ms").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = counts.withColumn("newer", newer).groupBy("key").agg(F.min(F.when(F.col("newer") < last_n, F.col("ms"))).alias("cut"), F.sum("n").alias("all"))
    cuts = F.broadcast(cuts.filter(F.col("all") > last_n).select(F.col("key").alias("_key"), "cut"))
    near = rows.join(cuts, F.col("key").eqNullSafe(F.col("_key")), "left").filter(F.col("cut").isNull() | (slot("at", 1000) >= F.col("cut")))
    return near.groupBy("key", "at", "ts_us").agg(F.count(F.lit(1)).alias("n"))


def _rank(values: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Mean and nearest-rank quantile of `latency_ns`, each value `n` times, by key."""
    counts = values.groupBy(*keys, "latency_ns").agg(F.sum("n").alias("n"))
    over = W.partitionBy(*keys)
    so_far = F.sum("n").over(over.orderBy("latency_ns").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.withColumns({"so_far": so_far, "all": F.sum("n").over(over)})
    reached = F.when(F.col("so_far") >= F.ceil(F.lit(q) * F.col("all")), F.col("latency_ns"))
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        (F.sum(F.col("n") * F.col("latency_ns")) / F.sum("n")).alias("latency_avg_ns"),
        F.min(reached).cast("double").alias("latency_p99_ns"),
    )


def latency_summary(df: DataFrame, last_n: int = 10_000, q: float = 0.99, detected: str = "detect_us") -> DataFrame:
    """Mean and nearest-rank quantile of detection latency over the newest `last_n` detections, of one time those captured first.

    Counts by second and millisecond cut the input down to a few more rows than that before they meet in one task.
    """
    sized = df.groupBy(slot(detected, SECOND_US).alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    newer = F.coalesce(F.sum("n").over(W.orderBy(F.col("sec").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = sized.withColumn("newer", newer).filter(F.col("newer") < last_n).agg(F.min("sec")).scalar()
    near = _newest(df.filter(slot(detected, SECOND_US) >= first), last_n, detected, F.lit(0))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.col("at").desc(), "ts_us").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = near.withColumn("n", F.least(F.col("n"), last_n - before)).filter("n > 0")
    found = _rank(kept.select(((F.col("at") - F.col("ts_us")) * 1000).alias("latency_ns"), "n"), [], q)
    return found.select(F.coalesce("samples", F.lit(0)).alias("samples"), "latency_avg_ns", "latency_p99_ns")


def latency_ticks(df: DataFrame, last_n: int = 10_000, q: float = 0.99, detected: str = "detect_us") -> DataFrame:
    """Per second: latency over the newest `last_n` detections up to its end, of one time those captured last.

    A second sends on its newest `last_n` rows at most (and those of one millisecond). Their positions count
    back from the number of detections up to the second's end; ticks and detections then meet by equal
    position slots of `last_n` (a tick reaches into two at most), never by an open range.
    """
    totals = df.groupBy(second(detected).alias("sec")).agg(F.count(F.lit(1)).alias("n")).select("sec", _so_far("n").alias("hi"))
    newer = W.partitionBy("key").orderBy(F.col("at").desc(), F.col("ts_us").desc()).rowsBetween(W.unboundedPreceding, -1)
    near = _newest(df, last_n, detected, second(detected)).withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    near = near.withColumn("n", F.least(F.col("n"), last_n - F.col("newer"))).filter("n > 0")
    placed = near.join(totals, F.col("key") == F.col("sec")).withColumn("last", F.col("hi") - F.col("newer")).select(
        ((F.col("at") - F.col("ts_us")) * 1000).alias("latency_ns"), (F.col("last") - F.col("n") + 1).alias("first"), "last")
    ticks = totals.withColumn("lo", F.greatest(F.lit(1), F.col("hi") - (last_n - 1)))

    def parts(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.expr(f"({low} - 1) div {last_n}"), F.expr(f"({high} - 1) div {last_n}"))).alias("part")

    met = ticks.select("*", parts("lo", "hi")).join(placed.select("*", parts("first", "last")), "part")
    # a row that reaches over the border of two slots counts in each with what lies there
    low = F.greatest("first", "lo", F.col("part") * last_n + 1)
    high = F.least("last", "hi", (F.col("part") + 1) * last_n)
    return _rank(met.select("sec", "latency_ns", (high - low + 1).alias("n")).filter("n > 0"), ["sec"], q).drop("samples")


def active_flows(packets: DataFrame, idle_secs: int = 9, changes: bool = False) -> DataFrame:
    """Per second with packets: flows with a packet in the `idle_secs` seconds that end with it.

    With `changes`, also the seconds without packets in which flows fall idle.

    Packets shrink to one row per (flow, second) map-side; a flow adds one when it wakes and takes
    one away after it has been idle, and the running sum over seconds is the count.
    """
    per_flow = packets.groupBy(*FLOW_KEY, second().alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    in_order = W.partitionBy(*FLOW_KEY).orderBy("sec")
    wakes = F.coalesce(F.col("sec") - F.lag("sec").over(in_order) > idle_secs, F.lit(True))
    sleeps = F.coalesce(F.lead("sec").over(in_order) - F.col("sec") > idle_secs, F.lit(True))
    flags = per_flow.select("sec", wakes.cast("int").alias("wakes"), sleeps.cast("int").alias("sleeps"))
    marks = flags.select(F.explode(F.array(
        F.struct("sec", F.col("wakes").alias("change"), F.lit(True).alias("live")),
        F.struct((F.col("sec") + idle_secs).alias("sec"), (-F.col("sleeps")).alias("change"), F.lit(False).alias("live")),
    )).alias("m")).select("m.*")
    steps = marks.groupBy("sec").agg(F.sum("change").alias("change"), F.max("live").alias("live"))
    counted = steps.withColumn("active_flows", _so_far("change"))
    return (counted if changes else counted.filter("live")).select("sec", "active_flows")


def rate_series(packets: DataFrame, seconds: int = 60) -> DataFrame:
    """The last `seconds` of throughput, seconds without packets as 0."""
    ticks = throughput(packets)
    spine = ticks.agg(F.max("sec").alias("last")).select(
        F.explode(F.sequence(F.col("last") - (seconds - 1), F.col("last"))).alias("sec")
    )
    return spine.join(ticks, "sec", "left").select(
        "sec", F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("bytes", F.lit(0)).alias("bytes")
    )


def tick_units(ticks: DataFrame) -> DataFrame:
    """Display units: latency in microseconds, throughput in KB."""
    return ticks.withColumns({
        "latency_avg_us": F.col("latency_avg_ns") / 1000.0,
        "latency_p99_us": F.col("latency_p99_ns") / 1000.0,
        "kb_per_sec": F.col("bytes_per_sec") / 1024.0,
    })
