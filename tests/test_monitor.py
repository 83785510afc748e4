from helpers import START, packet, packets, table
from pyspark.sql import functions as F

from packetlens.functions.text import fixed, health_band, human_count, to_alert_line, to_log
from packetlens.operators import monitor as m
from packetlens.plans.ticks import system_ticks


def detections(spark):
    rows = [(START, 1, "0.0.0.1", 2, "SYN Flood", "why", 0.9), (START + 1_500_000, 1, "0.0.0.1", 1, "Port Scan", "Because", 0.95),
            (START + 1_600_000, 2, "0.0.0.2", 0, "", "", 0.0), (START + 2_000_000, 3, "100.100.100.100", 2, "DoS", "x", 1.0)]
    return spark.createDataFrame(rows, "ts_us long, src_ip long, src_ip_str string, severity int, attack_type string, reason string, anomaly_score double")


def test_texts(spark):
    numbers = spark.createDataFrame([(999,), (1000,), (1550,), (999_949,), (1_000_000,), (2_250_000,)], "v long")
    assert [r[0] for r in numbers.select(human_count("v")).collect()] == ["999", "1.0K", "1.6K", "999.9K", "1.00M", "2.25M"]
    halves = spark.createDataFrame([(0.0,), (0.125,), (0.05,), (12345678.9,)], "v double")
    assert [r[0] for r in halves.select(fixed("v", 2)).collect()] == ["0.00", "0.13", "0.05", "12345678.90"]
    assert [r[0] for r in halves.select(fixed("v", 6)).collect()][:2] == ["0.000000", "0.125000"]
    bands = spark.createDataFrame([(9.9,), (10.0,), (100.0,)], "v double").select(health_band("v", 10, 100)).collect()
    assert [r[0] for r in bands] == ["good", "fair", "high"]


def test_log_and_alert_lines(spark):
    logs = to_log(detections(spark))
    assert table(logs, "level", "message") == [
        ("ATTACK", "[ATTACK] DoS from 100.100.100.100 — x"), ("ATTACK", "[ATTACK] SYN Flood from 0.0.0.1 — why"),
        ("WARN", "[WARN] Port Scan from 0.0.0.1 — Because"),
    ]
    assert [r[0] for r in table(to_alert_line(detections(spark)), "line")] == [
        "[00:00:00.000]  ◉ ATTACK  0.0.0.1          |  SYN Flood  |  why",
        "[00:00:01.500]  ◈ SUSPICIOUS  0.0.0.1          |  Port Scan  |  Because",
        "[00:00:02.000]  ◉ ATTACK  100.100.100.100  |  DoS  |  x",
    ]
    assert m.search_logs(logs, "WARN", "BECAUSE").count() == 1 and m.search_logs(logs, "ALL", "attack").count() == 2
    assert m.search_logs(logs).count() == 3 and m.recent_logs(logs, 2).count() == 2


def test_alert_views(spark):
    d = detections(spark)
    assert m.search_alerts(d, "because").count() == 1 and m.search_alerts(d, "0.0.0.2").count() == 0
    assert m.alert_totals(d).first().asDict() == {"attack": 2, "suspicious": 1}
    assert table(m.alert_counts(d), "total_alerts") == [(1,), (2,), (3,)]
    host = m.flagged_hosts(d).filter("src_ip = 1").first()
    assert (host.hits, host.attack_hits, host.last_type, host.max_score, host.last_severity) == (2, 1, "Port Scan", 0.95, 1)
    assert m.search_hosts(m.flagged_hosts(d), "100.").count() == 1
    assert m.hosts_tracked(d).first()[0] == 2 and m.hosts_tracked(d, approximate=True).first()[0] == 2
    assert m.recent_alerts(d, 1).first().attack_type == "DoS"
    assert table(m.notifications(d), "message") == [("DoS  —  100.100.100.100",), ("SYN Flood  —  0.0.0.1",)]


def test_latency_nearest_rank(spark):
    df = spark.range(1, 301).select((F.lit(START)).alias("ts_us"), (F.lit(START) + F.col("id")).alias("detect_us"))
    got = m.latency_summary(df, last_n=100).first()  # 201..300 us
    assert (got.samples, got.latency_avg_ns, got.latency_p99_ns) == (100, 250_500.0, 299_000.0)
    ticks = m.latency_ticks(df, last_n=100).first()
    assert (ticks.latency_avg_ns, ticks.latency_p99_ns) == (250_500.0, 299_000.0)


def test_system_ticks_cover_idle_seconds(spark):
    rows = [packet(ts=s * 1_000_000 + i, proto=proto) for s, i, proto in [(0, 0, 6), (0, 1, 6), (0, 2, 47), (3, 0, 6), (3, 1, 6)]]
    p = packets(spark, rows)
    severity = F.when(F.col("ts_us") == START, 2).otherwise(0).alias("severity")
    seen = p.select("ts_us", severity)
    late = p.select("ts_us", (F.col("ts_us") + 5).alias("detect_us"))
    ticks = system_ticks(p, seen, late, cap=1, idle_secs=2)
    start = START // 1_000_000
    assert table(ticks, "sec", "packets_per_sec", "total_packets", "dropped_packets", "total_alerts", "active_flows", "latency_avg_ns") == [
        (start, 3.0, 3, 1, 1, 2, 5000.0), (start + 1, 0.0, 3, 1, 1, 2, 5000.0), (start + 2, 0.0, 3, 1, 1, 0, 5000.0),
        (start + 3, 2.0, 5, 2, 1, 1, 5000.0),
    ]
    assert system_ticks(p.limit(0), seen.limit(0)).count() == 0


def test_active_flows_and_series(spark):
    rows = [packet(ts=s * 1_000_000, dport=p) for p, s in [(1, 0), (2, 1), (1, 9), (3, 20)]]
    active = m.active_flows(packets(spark, rows))
    assert [n for _, n in table(active, "sec", "active_flows")] == [1, 2, 2, 1]
    series = m.rate_series(packets(spark, rows), 21)
    assert [n for _, n in table(series, "sec", "packets")] == [1, 1] + [0] * 7 + [1] + [0] * 10 + [1]
