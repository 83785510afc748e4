import uuid

import pytest
from helpers import START, packet, packets, random_packets, table, window_stats
from pyspark.sql import functions as F

from packetlens.operators.flows import flow_sessions, flow_stats
from packetlens.operators.flowtable import current_flows, expire_flows
from packetlens.operators.monitor import latency_ticks
from packetlens.operators.scoring import score_heuristic
from packetlens.operators.verdict import DETECTION_COLUMNS
from packetlens.plans.detection import detect, detect_adaptive, limit_normals, packet_features
from packetlens.plans.ticks import system_ticks
from packetlens.schemas import FLOW_KEY
from packetlens.sources.sinks import write_detections
from packetlens.streaming.detect import stream_adaptive, stream_detect, stream_limit_normals
from packetlens.streaming.flows import stream_flow_sessions, stream_flow_stats, stream_source_windows
from packetlens.streaming.flowtable import CurrentFlows
from packetlens.streaming.ticks import stream_alert_ticks, stream_system_ticks, stream_ticks

KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_size", "tcp_flags", "ts_us"]
STATS = ["src_total_packets", "syn_count", "src_unique_dst_ports", "packet_count", "byte_count"]


def batches(spark, tmp_path, *dfs):
    """A stream that brings one DataFrame per micro-batch, in order."""
    path = str(tmp_path / uuid.uuid4().hex)
    for df in dfs:
        with_ts = df.withColumn("ts", F.timestamp_micros("ts_us")) if "ts" not in df.columns else df
        with_ts.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(with_ts.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(spark, tmp_path, stream, mode="append"):
    out, state = (str(tmp_path / uuid.uuid4().hex) for _ in range(2))
    if mode == "append":
        write_detections(stream, out, state, availableNow=True).awaitTermination()
    else:
        stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
            lambda df, _: df.write.mode("overwrite").parquet(out)
        ).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def by_time(spark, rows, parts):
    rows = sorted(rows, key=lambda r: r[7])
    cut = [len(rows) * i // parts for i in range(parts + 1)]
    return [packets(spark, rows[a:b], 1) for a, b in zip(cut, cut[1:])]


def test_stream_equals_brute_force_across_batches(spark, tmp_path):
    # Distinct times: packets of one time that fall into two batches could not see each other.
    rows = list({r[7]: r for r in random_packets(250, seed=11)}.values())
    want = sorted(tuple(r[c] for c in KEY + STATS) for r in window_stats(rows))
    got = finish(spark, tmp_path, stream_flow_stats(batches(spark, tmp_path, *by_time(spark, rows, 4)), block_secs=12))
    assert table(got, *KEY, *STATS) == want


def test_late_packets(spark, tmp_path):
    first = packets(spark, [packet(ts=0), packet(ts=60_000_000)], 1)
    second = packets(spark, [packet(ts=58_000_000, dport=7), packet(ts=60_500_000)], 1)
    third = packets(spark, [packet(ts=1_000_000, dport=8), packet(ts=61_000_000)], 1)  # beyond the watermark
    got = finish(spark, tmp_path, stream_flow_stats(batches(spark, tmp_path, first, second, third)))
    seen = {(r.ts_us - START): r.src_total_packets for r in got.collect()}
    assert seen == {0: 1, 60_000_000: 1, 58_000_000: 1, 60_500_000: 3, 61_000_000: 4}


def test_streamed_detection_equals_batch(spark, tmp_path):
    rows = list({r[7]: r for r in random_packets(200, seed=12)}.values())
    got = finish(spark, tmp_path, stream_detect(batches(spark, tmp_path, *by_time(spark, rows, 3))))
    assert table(got, *DETECTION_COLUMNS) == table(detect(packets(spark, rows)), *DETECTION_COLUMNS)


def test_streamed_folds_carry_state_over_batches(spark, tmp_path):
    rows = list({r[7]: r for r in random_packets(200, seed=13, sources=1)}.values())
    whole = packets(spark, rows)
    scored = score_heuristic(packet_features(whole)).orderBy("ts_us").persist()
    middle = START + 30_000_000
    parts = [scored.filter(F.col("ts_us") < middle), scored.filter(F.col("ts_us") >= middle)]
    got = finish(spark, tmp_path, stream_adaptive(batches(spark, tmp_path, *parts)))
    assert table(got, *DETECTION_COLUMNS) == table(detect_adaptive(whole), *DETECTION_COLUMNS)
    verdicts = detect(whole).select("src_ip", "ts_us", "severity")
    parts = [verdicts.filter(F.col("ts_us") < middle), verdicts.filter(F.col("ts_us") >= middle)]
    got = finish(spark, tmp_path, stream_limit_normals(batches(spark, tmp_path, *parts)))
    assert table(got, "src_ip", "ts_us") == table(limit_normals(verdicts).filter("severity = 0"), "src_ip", "ts_us")


def test_windows_sessions_and_ticks(spark, tmp_path):
    rows = random_packets(200, seed=14)
    whole = packets(spark, rows)
    parts = by_time(spark, rows, 3)
    sessions = finish(spark, tmp_path, stream_flow_sessions(batches(spark, tmp_path, *parts)), "complete")
    cols = ["src_ip", "dst_port", "session_start", "session_end", "packets", "bytes"]
    assert table(sessions, *cols) == table(flow_sessions(whole), *cols)
    ticks = finish(spark, tmp_path, stream_ticks(batches(spark, tmp_path, *parts)), "complete")
    assert ticks.agg(F.sum("packets"), F.sum("bytes")).first() == whole.agg(F.count("*"), F.sum("packet_size")).first()
    windows = finish(spark, tmp_path, stream_source_windows(batches(spark, tmp_path, *parts)), "complete")
    assert windows.agg(F.sum("packets")).first()[0] == 3 * len(rows)
    alerts = finish(spark, tmp_path, stream_alert_ticks(batches(spark, tmp_path, detect(whole).select("ts_us", "severity"))), "complete")
    assert alerts.agg(F.sum("attack")).first()[0] == detect(whole).filter("severity = 2").count()


def rows_of_state(query, operator=0):
    return [p["stateOperators"][operator]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def started(spark, tmp_path, stream):
    """The stream run to its end in memory of its progress, and what it wrote."""
    out, state = (str(tmp_path / uuid.uuid4().hex) for _ in range(2))
    query = write_detections(stream, out, state, availableNow=True)
    query.awaitTermination()
    return query, spark.read.schema(stream.schema).parquet(out)


def test_idle_sources_are_forgotten(spark, tmp_path):
    # source 1 is seen all the time, 2 falls silent and comes back, 30 others are seen once
    often = [packet(src=1, ts=i * 1_000_000) for i in range(100)]
    once = [packet(src=100 + i, ts=i * 100_000) for i in range(30)]
    back = [packet(src=2, ts=t) for t in (0, 200_000, 1_000_000, 90_000_000, 90_400_000)]
    rows = sorted([*often, *once, *back], key=lambda r: r[7])
    verdicts = packets(spark, rows, 1).select("src_ip", "ts_us", F.lit(0).alias("severity"))
    parts = [verdicts.filter(F.expr(f"(ts_us - {START}) div 25000000 = {k}")) for k in range(4)]
    query, got = started(spark, tmp_path, stream_limit_normals(batches(spark, tmp_path, *parts)))
    assert table(got, "src_ip", "ts_us") == table(limit_normals(verdicts), "src_ip", "ts_us")
    assert max(rows_of_state(query)) >= 32 and rows_of_state(query)[-1] <= 3
    scored = score_heuristic(packet_features(packets(spark, rows, 1))).persist()
    parts = [scored.filter(F.expr(f"(ts_us - {START}) div 25000000 = {k}")) for k in range(4)]
    query, got = started(spark, tmp_path, stream_adaptive(batches(spark, tmp_path, *parts), idle_secs=20))
    want = detect_adaptive(packets(spark, rows), idle_secs=20)
    assert table(got, *DETECTION_COLUMNS, "baseline") == table(want, *DETECTION_COLUMNS, "baseline")
    assert {r.baseline for r in got.filter(f"src_ip = 2 and ts_us = {START + 90_000_000}").collect()} == {0.0}
    assert max(rows_of_state(query)) >= 32 and rows_of_state(query)[-1] <= 3


def test_current_flows_over_batches_replays_and_expiry(spark, tmp_path):
    rows = random_packets(200, seed=15)
    stats = flow_stats(packets(spark, rows)).select(*FLOW_KEY, "last_seen", "packet_count").persist()
    want = current_flows(stats)
    for ttl in (None, 30, 5):
        held = CurrentFlows(str(tmp_path / f"flows{ttl}"), ttl)
        for k in range(5):
            part = stats.filter(F.expr(f"(last_seen - {START}) div 14000000 = {k}"))
            held.merge(part, k)
            if k == 3:  # the batch before was written, its end was not noticed
                held.merge(part, k)
            assert held.version(spark) == k
        kept = want if ttl is None else expire_flows(want, want.agg(F.max("last_seen")).first()[0], ttl)
        columns = [*FLOW_KEY, "last_seen", "packet_count"]
        assert table(held.read(spark), *columns) == table(kept, *columns)
    with pytest.raises(ValueError):
        CurrentFlows("x", keep=1)


@pytest.mark.parametrize("last_n", [10_000, 25])
def test_system_ticks_as_a_stream(spark, tmp_path, last_n):
    gap = [packet(ts=t, dport=9, proto=p) for t, p in [(75_000_000, 6), (75_000_001, 47), (95_000_000, 6)]]
    rows = [*random_packets(300, seed=16), *gap]
    whole = packets(spark, rows)
    verdicts = detect(whole).select("ts_us", "severity").persist()
    late = whole.selectExpr("ts_us + 1 + packet_size % 50 AS detect_us", "ts_us").persist()

    def parts(df):
        return [df.filter(F.expr(f"(ts_us - {START}) div 25000000 = {k}")) for k in range(4)]

    stream = stream_system_ticks(
        batches(spark, tmp_path, *parts(whole)), batches(spark, tmp_path, *parts(verdicts)), batches(spark, tmp_path, *parts(late)),
        cap=3, idle_secs=4, last_n=last_n)
    got = finish(spark, tmp_path, stream)
    until = START // 1_000_000 + 85
    ticks = system_ticks(whole, verdicts, None, cap=3, idle_secs=4).join(latency_ticks(late, last_n), "sec", "left")
    columns = ["sec", "packets_per_sec", "bytes_per_sec", "total_packets", "dropped_packets", "alerts_suspicious", "alerts_attack", "total_alerts", "active_flows"]
    assert table(got, *columns) == table(ticks.filter(F.col("sec") < until), *columns)
    assert got.count() == 85 and got.filter("latency_p99_ns is null").count() == 0
    measured = [(r.sec, r.latency_avg_ns, r.latency_p99_ns) for r in ticks.filter(F.col("sec") < until).collect() if r.latency_avg_ns]
    streamed = {r.sec: (r.latency_avg_ns, r.latency_p99_ns) for r in got.collect()}
    assert all(streamed[sec] == pytest.approx((avg, p99)) for sec, avg, p99 in measured) and len(measured) > 50


@pytest.mark.parametrize("batch", [10_000, 3])
def test_active_flows_of_a_stream_are_held_once_a_second(spark, tmp_path, batch):
    # flows that come back before and after they were idle, null keys, a late packet and one behind the watermark
    rows = [packet(src=i % 40, ts=i * 37_000 + (i % 7) * 3_000_000, dport=80 + i % 3) for i in range(1500)]
    rows = [tuple(None if i % 50 == j else v for j, v in enumerate(r)) if i % 50 in (1, 3) else r for i, r in enumerate(rows)]
    whole = packets(spark, rows)
    parts = [whole.filter(F.expr(f"(ts_us - {START}) div 15000000 = {k}")) for k in range(6)]
    late = packets(spark, [packet(src=900, ts=44_000_000), packet(src=901, ts=2_000_000)], 1)
    parts[3] = parts[3].unionByName(late)  # all before 45 s has come; 2 s is beyond the watermark
    none = detect(whole).select("ts_us", "severity").persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        stream = stream_system_ticks(batches(spark, tmp_path, *parts), batches(spark, tmp_path, none), idle_secs=4)
        query, got = started(spark, tmp_path, stream)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = system_ticks(whole.unionByName(late.filter("src_ip = 900")), none, idle_secs=4).select("sec", "active_flows")
    last = got.agg(F.max("sec")).first()[0]
    assert last > START // 1_000_000 + 55
    assert table(got, "sec", "active_flows") == table(want.filter(F.col("sec") <= last), "sec", "active_flows")
    # no state holds a row for each window of a flow: parts of the flows, seconds, and timers of both
    most = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
    flows = whole.select(*FLOW_KEY, F.expr("ts_us div 1000000")).distinct().count()
    assert most < flows / 2


def test_ticks_of_a_stream_with_its_own_watermark(spark, tmp_path):
    rows = random_packets(200, seed=19)
    whole = packets(spark, rows)
    parts = by_time(spark, rows, 3)
    none = detect(whole).select("ts_us", "severity").persist()
    stream = batches(spark, tmp_path, *parts).withWatermark("ts", "5 seconds")
    got = finish(spark, tmp_path, stream_system_ticks(stream, batches(spark, tmp_path, none), idle_secs=4, watermark_secs=5))
    want = system_ticks(whole, none, idle_secs=4)
    last = got.agg(F.max("sec")).first()[0]
    assert last > START // 1_000_000 + 55
    assert table(got, "sec", "active_flows") == table(want.filter(F.col("sec") <= last), "sec", "active_flows")


def test_null_fields_and_many_frames(spark, tmp_path):
    rows = list({r[7]: r for r in random_packets(240, seed=18)}.values())
    rows = [tuple(None if (i + j) % 17 == 0 and j != 7 else v for j, v in enumerate(r)) for i, r in enumerate(rows)]

    def flat(df):  # a sum over nulls alone is null or 0
        return sorted((tuple(r[c] for c in KEY) + tuple(r[c] or 0 for c in STATS) for r in df.collect()), key=str)

    want = flat(flow_stats(packets(spark, rows)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = finish(spark, tmp_path, stream_flow_stats(batches(spark, tmp_path, *by_time(spark, rows, 3)), block_secs=12))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert flat(got) == want


def test_state_holds_what_later_windows_reach(spark, tmp_path):
    rows = [packet(ts=i * 100_000) for i in range(400)]
    query, got = started(spark, tmp_path, stream_flow_stats(batches(spark, tmp_path, *by_time(spark, rows, 10)), block_secs=1000, watermark_secs=2))
    assert got.count() == 400
    # one entry a micro-batch of 4 s; a window of 3 s and lateness of 2 s reach into three of them at most
    assert max(rows_of_state(query)) <= 4


def test_many_short_lived_sources_take_few_states(spark, tmp_path):
    rows = [packet(src=i * 7, ts=i * 1000, dport=80 + i % 3) for i in range(3000)]
    query, got = started(spark, tmp_path, stream_flow_stats(batches(spark, tmp_path, packets(spark, rows, 1)), block_secs=1000))
    assert table(got, "src_total_packets") == [(1,)] * 3000 and max(rows_of_state(query)) <= 1024
    verdicts = packets(spark, rows, 1).select("src_ip", "ts_us", F.lit(0).alias("severity"))
    query, got = started(spark, tmp_path, stream_limit_normals(batches(spark, tmp_path, verdicts), gap_ms=100_000))
    assert got.count() == 3000 and max(rows_of_state(query)) <= 1024


def test_parts_of_a_stream_are_worked_out_once(spark):
    from checks.q_streams import in_parts

    worked = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        worked.add(1)
        return x

    got = in_parts(spark, spark.range(40).select(seen("id").alias("ts_us")))
    assert got.isStreaming and worked.value == 40
