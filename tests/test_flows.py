import pytest
from helpers import START, packet, packets, random_packets, table, window_stats
from pyspark.sql import functions as F

from packetlens.operators import flowtable as ft
from packetlens.operators.flows import flow_first_seen, flow_sessions, flow_stats, flow_window, source_sessions, source_window
from packetlens.operators.ratecap import capture_counters, rate_cap
from packetlens.operators.spread import positions, take_first

STATS = ["src_total_packets", "syn_count", "src_unique_dst_ports", "packet_count", "byte_count"]
KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_size", "tcp_flags", "ts_us"]


@pytest.mark.parametrize("method,block", [("sweep", 30), ("sweep", 3), ("sweep", 1000), ("range", 30), ("range", 5)])
def test_sliding_statistics_match_brute_force(spark, method, block):
    rows = random_packets(500)
    want = sorted(tuple(r[c] for c in KEY + STATS) for r in window_stats(rows))
    assert table(flow_stats(packets(spark, rows), method=method, block_secs=block), *KEY, *STATS) == want


@pytest.mark.parametrize("method,most,slot,quiet", [("sweep", 0, 100_000, 0), ("sweep", 40, 700_000, 0), ("sweep", 0, 9_000_000, 0), ("range", 100, 100_000, 20), ("range", 30, 300_000, 50)])
def test_hot_sources_in_slots_match_brute_force(spark, method, most, slot, quiet):
    rows = [*random_packets(400), *[packet(ts=i // 3, dport=80 + i % 2, flags=2) for i in range(40)]]
    rows.append((None, None, 5, 80, 6, 100, 2, START + 29_999_999))
    how = {"method": method, "most_rows": most, "slot_us": slot, "quiet_rows": quiet, "block_secs": 10}
    want = sorted((tuple(r[c] for c in KEY + STATS) for r in window_stats(rows)), key=str)
    frame = packets(spark, rows)
    assert sorted((tuple(r) for r in flow_stats(frame, **how).select(*KEY, *STATS).collect()), key=str) == want
    assert sorted((tuple(r) for r in source_window(frame, **how).select(*KEY, *STATS[:3]).collect()), key=str) == [r[:-2] for r in want]
    assert sorted((tuple(r) for r in flow_window(frame, **how).select(*KEY, *STATS[3:]).collect()), key=str) == sorted(((*r[:8], *r[11:]) for r in want), key=str)


def test_a_hot_source_spreads_over_all_tasks(spark):
    rows = [packet(ts=i * 1000, dport=80 + i % 7) for i in range(18_000)] + [packet(src=2 + i, ts=i) for i in range(2_000)]
    found = flow_stats(packets(spark, rows), most_rows=1000, block_secs=30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        of_hot = found.filter("src_ip = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(of_hot) >= int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in of_hot) < 9_000


def test_other_window_length(spark):
    rows = random_packets(300, seed=3)
    want = sorted(tuple(r[c] for c in KEY + STATS) for r in window_stats(rows, 7_000_000))
    assert table(flow_stats(packets(spark, rows), window_secs=7), *KEY, *STATS) == want


def test_window_edge_is_inclusive(spark):
    rows = [packet(ts=0, dport=1), packet(ts=3_000_000, dport=2), packet(ts=6_000_001, dport=3)]
    got = source_window(packets(spark, rows)).orderBy("ts_us").select("src_total_packets", "src_unique_dst_ports").collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 2), (1, 1)]


def test_rate_and_mean_size(spark):
    rows = [packet(ts=i, size=100 * (i + 1)) for i in range(4)]
    last = flow_stats(packets(spark, rows)).orderBy(F.col("ts_us").desc()).first()
    assert (last.packet_rate, last.avg_packet_size, last.connection_attempts) == (4 / 3, 250.0, 4)


def test_one_shuffle_of_the_packets(spark):
    # one exchange for the sources that fit a task; what the others need does not read it
    frame = flow_stats(packets(spark, random_packets(10), 1))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan


def test_idle_edge_of_sessions(spark):
    rows = [packet(ts=0), packet(ts=9_000_000), packet(ts=18_000_001), packet(src=2, ts=5)]
    got = table(flow_sessions(packets(spark, rows)), "src_ip", "session_start", "session_end", "packets", "bytes")
    assert got == [
        (1, START, START + 9_000_000, 2, 200), (1, START + 18_000_001, START + 18_000_001, 1, 100), (2, START + 5, START + 5, 1, 100),
    ]
    seen = table(flow_first_seen(packets(spark, rows)), "src_ip", "ts_us", "first_seen")
    assert [r[2] - START for r in seen] == [0, 0, 18_000_001, 5]


def test_source_sessions_span_flows(spark):
    rows = [packet(ts=0, dport=1), packet(ts=8_000_000, dport=2), packet(ts=16_000_000, dport=1)]
    assert table(source_sessions(packets(spark, rows)), "packets") == [(3,)]
    assert flow_sessions(packets(spark, rows)).count() == 3


def test_positions_and_take_first(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("k"))
    ranked = positions(df, ["k"], F.expr("v div 10"), ["v"], total="n")
    for k in range(3):
        got = [r.position for r in ranked.filter(F.col("k") == k).orderBy("v").collect()]
        assert got == list(range(1, len(got) + 1))
        assert ranked.filter(F.col("k") == k).first().n == len(got)
    assert table(take_first(df, 25, F.expr("v div 10"), ["v"]), "v") == [(i,) for i in range(25)]
    assert take_first(df, 5000, F.expr("v div 10"), ["v"]).count() == 1000
    assert take_first(df.filter("v < 0"), 5, F.expr("v div 10"), ["v"]).count() == 0


def test_rate_cap_is_exact_in_a_flooded_bucket(spark):
    rows = [packet(ts=i * 100, size=i + 1) for i in range(2000)] + [packet(ts=1_000_000 + i, size=i + 1) for i in range(10)]
    kept = rate_cap(packets(spark, rows), cap=50)
    assert table(kept, "ts_us") == [(START + i * 100,) for i in range(50)] + [(START + 1_000_000 + i,) for i in range(10)]
    totals = capture_counters(packets(spark, rows + [packet(proto=47)]), cap=50).first()
    assert tuple(totals) == (2011, 1, 1950, 60)


def test_flow_table(spark):
    rows = [packet(ts=t * 1_000_000, dport=p) for p, t in [(1, 0), (1, 40), (2, 5), (3, 35), (4, 20)]]
    current = ft.current_flows(flow_stats(packets(spark, rows)))
    assert table(current, "dst_port") == [(1,), (2,), (3,), (4,)]
    now = START + 40_000_000
    live = ft.expire_flows(current, now, 20)
    assert table(live, "dst_port") == [(1,), (3,), (4,)]  # 20 s old to the microsecond stays
    assert table(ft.bound_flows(current, 2), "dst_port") == [(1,), (3,)]
    assert ft.flow_churn(current, live).first().asDict() == {"inserted": 0, "evicted": 1, "kept": 3}
    gone = current.filter("dst_port = 3")
    assert table(ft.remove_flows(current, gone), "dst_port") == [(1,), (2,), (4,)]
    assert table(ft.lookup_flows(current, gone), "dst_port") == [(3,)]
    assert table(ft.contains_flows(live, current), "dst_port", "present") == [(1, True), (2, False), (3, True), (4, True)]
    assert ft.active_flow_count(live).first()[0] == 3
    newer = current.filter("dst_port = 2").withColumn("last_seen", F.lit(now)).withColumn("packet_rate", F.lit(99.0))
    assert ft.top_flows(ft.merge_flows(current, newer), 1).first().dst_port == 2


def test_tasks_grow_with_the_packets(spark, monkeypatch):
    monkeypatch.setattr("packetlens.operators.spread.tasks_for.__defaults__", (50,))
    rows = [packet(src=1 + i % 300, ts=i * 1000) for i in range(1200)]
    for stats in (flow_stats, flow_window, source_window):
        found = stats(packets(spark, rows))
        sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in sizes) < 150 and sum(r["count"] for r in sizes) == 1200


def test_taking_the_first_moves_only_the_last_block(spark):
    df = spark.range(0, 1000, 1, 4).select(F.expr("id * 7919 % 1000").alias("v"), F.spark_partition_id().alias("p"))
    got = take_first(df, 505, F.expr("v div 10"), ["v"]).withColumn("q", F.spark_partition_id()).collect()
    assert sorted(r.v for r in got) == list(range(505))
    assert all(r.p == r.q for r in got if r.v < 500)
