"""Monitoring views and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.functions.text import attention, health_band, human_count, to_alert_line, to_log
from packetlens.operators import monitor as m
from packetlens.plans.detection import detect
from packetlens.plans.ticks import system_ticks

from .inputs import idle_packets, idle_packets_sql, packets
from .registry import check
from .sql import DETECTION, fixed, query

_COLS = DETECTION.split(", ")


def _det(spark, sf):
    return detect(packets(spark, sf)).select(*_COLS)


@check(query(f"SELECT {DETECTION} FROM det WHERE severity > 0", "det"))
def alert_rows(spark, sf):
    return m.alerts(_det(spark, sf))


@check(query(
    f"SELECT {DETECTION} FROM det WHERE severity > 0 AND contains(lower(src_ip_str || ' ' || attack_type || ' ' || reason), 'syn flood')", "det"
))
def alerts_found(spark, sf):
    return m.search_alerts(_det(spark, sf), "SYN Flood")


@check(query("SELECT * FROM hosts WHERE contains(src_ip_str, '.1')", "hosts"))
def hosts_found(spark, sf):
    return m.search_hosts(m.flagged_hosts(_det(spark, sf)), ".1")


@check(query("SELECT * FROM logs WHERE level = 'ATTACK' AND (contains(lower(message), 'dos') OR contains(lower(level), 'dos'))", "logs"))
def logs_found(spark, sf):
    return m.search_logs(to_log(_det(spark, sf)), "ATTACK", "DoS")


@check(query("SELECT * FROM logs WHERE contains(lower(message), 'warn') OR contains(lower(level), 'warn')", "logs"))
def logs_found_any_level(spark, sf):
    return m.search_logs(to_log(_det(spark, sf)), "ALL", "warn")


@check(query("SELECT ts_us, attack_type || '  —  ' || src_ip_str AS message FROM det WHERE severity = 2", "det"))
def attack_notifications(spark, sf):
    return m.notifications(_det(spark, sf))


@check(query("SELECT * FROM logs", "logs"))
def log_lines(spark, sf):
    return to_log(_det(spark, sf))


@check(query(
    """SELECT ts_us, src_ip, '[' || strftime(make_timestamp(ts_us), '%H:%M:%S.%g') || ']  ' ||
      CASE WHEN severity = 2 THEN '◉ ATTACK' ELSE '◈ SUSPICIOUS' END || '  ' ||
      CASE WHEN length(src_ip_str) < 15 THEN rpad(src_ip_str, 15, ' ') ELSE src_ip_str END || '  |  ' || attack_type || '  |  ' || reason AS line
      FROM det WHERE severity > 0""", "det"
))
def alert_lines(spark, sf):
    return to_alert_line(_det(spark, sf))


@check(query("SELECT * FROM thru", "thru"))
def throughput_per_second(spark, sf):
    return m.throughput(packets(spark, sf))


@check(query(
    "SELECT *, CAST(sum(packets) OVER w AS BIGINT) AS total_packets, CAST(sum(bytes) OVER w AS BIGINT) AS total_bytes FROM thru WINDOW w AS (ORDER BY sec)", "thru"
))
def throughput_totals(spark, sf):
    return m.running_totals(m.throughput(packets(spark, sf)))


_HUMAN = (
    f"CASE WHEN v < 1000 THEN v::VARCHAR WHEN v < 1000000 THEN {fixed('v / 1000.0::DOUBLE', 1)} || 'K' "
    f"ELSE {fixed('v / 1000000.0::DOUBLE', 2)} || 'M' END"
)


@check(query(
    f"SELECT src_ip, dst_port, v, {_HUMAN} AS text FROM t", "packets",
    t="SELECT src_ip, dst_port, CAST(sum(packet_size) AS BIGINT) AS v FROM packets GROUP BY 1, 2",
))
def human_counts(spark, sf):
    rows = packets(spark, sf).groupBy("src_ip", "dst_port").agg(F.sum(F.col("packet_size").cast("bigint")).alias("v"))
    return rows.withColumn("text", human_count("v"))


_COUNTS = """SELECT ts_us // 1000000 AS sec, count(*) FILTER (severity = 1) AS suspicious, count(*) FILTER (severity = 2) AS attack
  FROM det GROUP BY 1"""
_SO_FAR = """SELECT *, CAST(sum(suspicious) OVER w AS BIGINT) AS alerts_suspicious, CAST(sum(attack) OVER w AS BIGINT) AS alerts_attack,
  CAST(sum(suspicious + attack) OVER w AS BIGINT) AS total_alerts FROM c WINDOW w AS (ORDER BY sec)"""


@check(query("SELECT * FROM a", "det", c=_COUNTS, a=_SO_FAR))
def alert_counts_per_second(spark, sf):
    return m.alert_counts(_det(spark, sf))


@check(query("SELECT count(*) FILTER (severity = 2) AS attack, count(*) FILTER (severity = 1) AS suspicious FROM det", "det"))
def alert_total_counts(spark, sf):
    return m.alert_totals(_det(spark, sf))


# The detection time of a packet in these checks: some microseconds after its capture.
_DETECTED = "ts_us + 1 + (packet_size * 7 + src_ip) % 131"
_LAT = f"SELECT {_DETECTED} AS detect_us, ts_us, src_ip, dst_port FROM packets"


def _latencies(spark, sf):
    return packets(spark, sf).selectExpr(f"{_DETECTED} AS detect_us", "ts_us", "src_ip", "dst_port")


@check(query(
    """SELECT count(*) AS samples, avg((detect_us - ts_us) * 1000) AS latency_avg_ns,
      quantile_disc((detect_us - ts_us) * 1000, 0.99)::DOUBLE AS latency_p99_ns FROM newest""",
    "packets", l=_LAT, newest="SELECT * FROM l ORDER BY detect_us DESC, ts_us, src_ip, dst_port LIMIT 10000",
))
def latency_of_newest(spark, sf):
    return m.latency_summary(_latencies(spark, sf))


_LATENCY = {
    "l": _LAT,
    "num": "SELECT detect_us // 1000000 AS sec, (detect_us - ts_us) * 1000 AS v, row_number() OVER (ORDER BY detect_us, ts_us, src_ip, dst_port) AS pos FROM l",
    "ends": "SELECT sec, max(pos) AS hi FROM num GROUP BY 1",
    "lat": """SELECT e.sec, avg(v) AS latency_avg_ns, quantile_disc(v, 0.99)::DOUBLE AS latency_p99_ns
      FROM ends e JOIN num ON num.pos BETWEEN e.hi - 9999 AND e.hi GROUP BY 1""",
}


@check(query("SELECT * FROM lat", "packets", **_LATENCY))
def latency_per_second(spark, sf):
    return m.latency_ticks(_latencies(spark, sf))


_ACTIVE = {
    "fs": "SELECT DISTINCT src_ip, dst_ip, src_port, dst_port, protocol, ts_us // 1000000 AS sec FROM packets",
    "act": """SELECT t.sec, count(DISTINCT (src_ip, dst_ip, src_port, dst_port, protocol)) AS active_flows
      FROM (SELECT DISTINCT sec FROM fs) t JOIN fs ON fs.sec BETWEEN t.sec - 8 AND t.sec GROUP BY 1""",
}


@check(query("SELECT * FROM act", "packets", **_ACTIVE))
def active_flows_per_second(spark, sf):
    return m.active_flows(packets(spark, sf))


_TICKS = """SELECT sec, packets::DOUBLE AS packets_per_sec, bytes::DOUBLE AS bytes_per_sec,
    CAST(sum(packets) OVER (ORDER BY sec) AS BIGINT) AS total_packets, CAST(sum(greatest(0, coalesce(kept, 0) - 1000)) OVER (ORDER BY sec) AS BIGINT) AS dropped_packets,
    coalesce(alerts_suspicious, 0) AS alerts_suspicious, coalesce(alerts_attack, 0) AS alerts_attack,
    coalesce(total_alerts, 0) AS total_alerts, coalesce(active_flows, 0) AS active_flows, latency_avg_ns, latency_p99_ns
  FROM thru LEFT JOIN a USING (sec) LEFT JOIN act USING (sec) LEFT JOIN lat USING (sec)
    LEFT JOIN (SELECT ts_us // 1000000 AS sec, count(*) AS kept FROM packets WHERE protocol IN (1, 6, 17) GROUP BY 1) k USING (sec)"""


def _system(spark, sf):
    p = packets(spark, sf)
    return system_ticks(p, detect(p), _latencies(spark, sf), cap=1000)


@check(query(_TICKS, "thru", "det", c=_COUNTS, a=_SO_FAR, **_ACTIVE, **_LATENCY))
def system_tick_table(spark, sf):
    return _system(spark, sf)


# All seconds from the first packet to the last, also those without any.
_EVERY = """SELECT sec, coalesce(packets, 0)::DOUBLE AS packets_per_sec, coalesce(bytes, 0)::DOUBLE AS bytes_per_sec,
    CAST(sum(coalesce(packets, 0)) OVER w AS BIGINT) AS total_packets, CAST(sum(greatest(0, coalesce(kept, 0) - 1000)) OVER w AS BIGINT) AS dropped_packets,
    CAST(sum(coalesce(suspicious, 0)) OVER w AS BIGINT) AS alerts_suspicious, CAST(sum(coalesce(attack, 0)) OVER w AS BIGINT) AS alerts_attack,
    CAST(sum(coalesce(suspicious, 0) + coalesce(attack, 0)) OVER w AS BIGINT) AS total_alerts, coalesce(active_flows, 0) AS active_flows,
    last_value(latency_avg_ns IGNORE NULLS) OVER w AS latency_avg_ns, last_value(latency_p99_ns IGNORE NULLS) OVER w AS latency_p99_ns
  FROM (SELECT unnest(generate_series(min(sec), max(sec))) AS sec FROM thru) LEFT JOIN thru USING (sec) LEFT JOIN c USING (sec) LEFT JOIN act USING (sec)
    LEFT JOIN lat USING (sec) LEFT JOIN (SELECT ts_us // 1000000 AS sec, count(*) AS kept FROM packets WHERE protocol IN (1, 6, 17) GROUP BY 1) k USING (sec)
  WINDOW w AS (ORDER BY sec ROWS UNBOUNDED PRECEDING)"""
_ACTIVE_IDLE = _ACTIVE | {"act": """SELECT sec, count(*) AS active_flows FROM
      (SELECT DISTINCT src_ip, dst_ip, src_port, dst_port, protocol, sec + unnest(generate_series(0, 8)) AS sec FROM fs) GROUP BY 1"""}


def _idle_latencies(spark, sf):
    return idle_packets(spark, sf).selectExpr(f"{_DETECTED} AS detect_us", "ts_us", "src_ip", "dst_port")


@check(idle_packets_sql(query(_EVERY, "thru", "det", c=_COUNTS, **_ACTIVE_IDLE, **_LATENCY)))
def system_ticks_idle(spark, sf):
    """With idle seconds, and protocols that the filter drops."""
    p = idle_packets(spark, sf)
    return system_ticks(p, detect(p), _idle_latencies(spark, sf), cap=1000)


def _band(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} < {lo} THEN 'good' WHEN {x} < {hi} THEN 'fair' ELSE 'high' END"


@check(query(
    "SELECT sec, latency_avg_ns / 1000.0::DOUBLE AS latency_avg_us, latency_p99_ns / 1000.0::DOUBLE AS latency_p99_us, "
    "bytes_per_sec / 1024.0::DOUBLE AS kb_per_sec FROM sys",
    "thru", "det", c=_COUNTS, a=_SO_FAR, **_ACTIVE, **_LATENCY, sys=_TICKS,
))
def tick_unit_columns(spark, sf):
    return m.tick_units(_system(spark, sf)).select("sec", "latency_avg_us", "latency_p99_us", "kb_per_sec")


@check(query(
    f"SELECT sec, {_band('latency_avg_ns / 1000.0::DOUBLE', 60, 67)} AS latency, {_band('packets_per_sec', 50, 800)} AS load, "
    "total_alerts > 0 AS alarmed, dropped_packets > 0 AS dropping FROM sys",
    "thru", "det", c=_COUNTS, a=_SO_FAR, **_ACTIVE, **_LATENCY, sys=_TICKS,
))
def health_bands(spark, sf):
    return m.tick_units(_system(spark, sf)).select(
        "sec", health_band("latency_avg_us", 60, 67).alias("latency"), health_band("packets_per_sec", 50, 800).alias("load"),
        attention("total_alerts").alias("alarmed"), attention("dropped_packets").alias("dropping"),
    )


@check(query("SELECT * FROM hosts", "hosts"))
def flagged_host_table(spark, sf):
    return m.flagged_hosts(_det(spark, sf))


@check(query("SELECT * FROM hosts ORDER BY hits DESC, src_ip", "hosts"))
def flagged_hosts_sorted(spark, sf):
    return m.flagged_hosts(_det(spark, sf)).orderBy(F.col("hits").desc(), "src_ip")


@check(query("SELECT count(DISTINCT src_ip) AS hosts FROM det WHERE severity > 0", "det"))
def hosts_tracked_count(spark, sf):
    return m.hosts_tracked(_det(spark, sf))


# Every third second is emptied, so the series has gaps to fill.
@check(query(
    """SELECT s.sec, coalesce(t.packets, 0) AS packets, coalesce(t.bytes, 0) AS bytes
      FROM (SELECT unnest(generate_series(hi - 59, hi)) AS sec FROM (SELECT max(sec) AS hi FROM gappy)) s LEFT JOIN gappy t USING (sec)""",
    "thru", gappy="SELECT * FROM thru WHERE sec % 3 <> 0",
))
def rate_series_of_last_minute(spark, sf):
    return m.rate_series(packets(spark, sf).filter("(ts_us div 1000000) % 3 <> 0"))


_ALERT_ORDER = "src_ip, severity, attack_type, reason, anomaly_score"


@check(query(f"SELECT {DETECTION} FROM det WHERE severity > 0 ORDER BY ts_us DESC, {_ALERT_ORDER} LIMIT 500", "det"))
def alerts_most_recent(spark, sf):
    return m.recent_alerts(_det(spark, sf), 500, _ALERT_ORDER.split(", "))


@check(query("SELECT * FROM logs ORDER BY ts_us DESC, message, level LIMIT 2000", "logs"))
def logs_most_recent(spark, sf):
    return m.recent_logs(to_log(_det(spark, sf)))
