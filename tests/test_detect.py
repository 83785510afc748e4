import math
import statistics

import numpy as np
import pytest
from helpers import START, as_dicts, packet, packets, random_packets, table, window_stats
from pyspark.sql import functions as F

from packetlens.operators.baseline import adaptive_threshold, baseline_ewma, final_baseline, next_baseline
from packetlens.operators.features import apply_scaler, fit_scaler, fit_transform, override_range, scaler_stats
from packetlens.operators.rules import rules
from packetlens.operators.scoring import bucket_reuse, combine_scores, score_bucketed, score_heuristic
from packetlens.operators.verdict import decide, prediction_class
from packetlens.operators.sequential import coarse, keep_spaced, kept_times, long_keys
from packetlens.plans.detection import detect, detect_adaptive, limit_normals, packet_features
from packetlens.schemas import FLOW_KEY

FEATURES = (
    "src_ip long, src_unique_dst_ports long, packet_rate double, syn_ratio double, syn_count double, connection_count double, "
    "bytes_per_sec double, unique_ports double, avg_packet_size double"
)


def feature_rows(spark, *rows, baseline=None):
    full = [(16909060, p, r, sr, sr * r * 3, r * 3, r * 100, float(p), 100.0) for p, r, sr in rows]
    df = spark.createDataFrame(full, FEATURES)
    return df if baseline is None else df.withColumn("baseline", F.lit(float(baseline)))


@pytest.mark.parametrize("ports,rate,ratio,want", [
    (14, 1.0, 0.0, None), (15, 1.0, 0.0, ("Port Scan", 1)), (44, 1.0, 0.0, ("Port Scan", 1)), (45, 1.0, 0.0, ("Port Scan", 2)),
    (1, 50.0, 0.85, ("SYN Flood", 2)), (1, 49.9, 0.85, None), (1, 50.0, 0.8499, None),
    (1, 499.9, 0.0, None), (1, 500.0, 0.0, ("DoS Attack", 2)), (15, 500.0, 1.0, ("Port Scan", 1)), (1, 500.0, 1.0, ("SYN Flood", 2)),
])
def test_rule_boundaries(spark, ports, rate, ratio, want):
    r = rules(feature_rows(spark, (ports, rate, ratio))).first()
    assert (None if r.rule_type is None else (r.rule_type, r.rule_severity)) == want


def test_rule_reasons(spark):
    got = rules(feature_rows(spark, (20, 1.0, 0.0), (1, 60.0, 0.9), (1, 612.25, 0.0))).orderBy("packet_rate").collect()
    assert [r.rule_reason for r in got] == [
        "Port scan: 20 unique ports from 1.2.3.4 in 3s window (threshold: 15)",
        "SYN flood: ratio=0.90 (162 SYNs / 180 pkts) at 60.0 pkt/s",
        "DoS flood: 612.3 pkt/s (61 KB/s) (threshold: 500.0)",
    ]


def test_spike_rule(spark):
    rows = feature_rows(spark, (1, 50.0, 0.0), (1, 49.9, 0.0), baseline=10)
    got = {r.packet_rate: r.rule_reason for r in rules(rows, baseline="baseline").collect()}
    assert got == {50.0: "Traffic spike: 50.0 pkt/s is 5.0x above baseline (10.0 pkt/s)", 49.9: None}
    assert rules(feature_rows(spark, (1, 50.0, 0.0), baseline=0), baseline="baseline").first().rule_type is None


@pytest.mark.parametrize("rule,score,label,want", [
    (None, 0.4999, "Normal", (0, "", "", False)),
    (None, 0.5, "Normal", (1, "Anomaly", "iForest score=0.5000 RF=Normal | pkt_rate=7 | ports=1 | syn=0", True)),
    (None, 0.5, "Other", (1, "Anomaly", "iForest score=0.5000 RF=Other | pkt_rate=7 | ports=1 | syn=0", True)),
    (None, 0.0, "", (0, "", "", False)),
    (None, 0.6, "PortScan", (2, "PortScan", "ML classifier: PortScan | anomaly score=0.6000 | pkt_rate=7 | ports=1 | syn=0", True)),
    (None, 0.7, "Suspicious", (2, "Suspicious", "ML classifier: Suspicious | anomaly score=0.7000 | pkt_rate=7 | ports=1 | syn=0", True)),
    ("Traffic Spike", 1.0, "DoS", (1, "Traffic Spike", "why | ML: DoS (score=1.0000)", True)),
    ("Traffic Spike", 0.1, "Normal", (1, "Traffic Spike", "why", False)),
])
def test_fusion(spark, rule, score, label, want):
    row = feature_rows(spark, (1, 7.9, 0.0)).withColumns({
        "rule_type": F.lit(rule).cast("string"), "rule_reason": F.lit("why" if rule else None).cast("string"),
        "rule_severity": F.lit(1 if rule else None).cast("int"), "ml_score": F.lit(score), "ml_label": F.lit(label),
    })
    got = decide(row).first()
    assert (got.severity, got.attack_type, got.reason, got.ml_triggered) == want
    assert got.rule_triggered == (rule is not None)


def test_prediction_classes(spark):
    kinds = [(0, "SYN Flood", "NORMAL"), (2, "SYN Flood", "SYN_FLOOD"), (2, "SYNFlood", "SYN_FLOOD"), (1, "Port Scan", "PORT_SCAN"),
             (2, "PortScan", "PORT_SCAN"), (2, "DoS", "ATTACK"), (2, "syn", "ATTACK")]
    df = spark.createDataFrame(kinds, "severity int, attack_type string, want string")
    assert df.filter(prediction_class() == F.col("want")).count() == len(kinds)


def test_heuristic_boundaries_and_bad_features(spark):
    rows = [(20.0, 15.0, 100.0, 0.0, "Normal"), (21.0, 99.0, 900.0, 1.0, "PortScan"), (0.0, 41.0, 900.0, 1.0, "SYNFlood"),
            (0.0, 0.0, 401.0, 1.0, "DoS"), (0.0, 16.0, 1.0, 0.7, "Suspicious"), (0.0, 0.0, 101.0, 0.7, "Suspicious"),
            (None, 99.0, 900.0, 0.0, "Normal"), (float("nan"), 99.0, 900.0, 0.0, "Normal")]
    df = spark.createDataFrame(rows, "unique_ports double, syn_count double, packet_rate double, s double, l string")
    df = df.withColumns({"avg_packet_size": F.lit(1.0), "connection_count": F.lit(1.0)})
    bad = score_heuristic(df).filter("NOT (ml_score <=> s AND ml_label <=> l)")
    assert bad.count() == 0


def test_combining_scores(spark):
    rows = [(-0.3, True, "Normal", 0.6), (-0.2, True, None, 0.5), (-0.7, True, "DoS", 1.0), (-0.7, False, "DoS", 0.6), (-0.7, False, "Normal", 0.0)]
    df = spark.createDataFrame(rows, "raw_score double, is_anomaly boolean, class_label string, want double")
    assert combine_scores(df).filter("ml_score = want").count() == len(rows)


def by_hand(rows, gap=500_000):
    """The sequential detector, packet by packet."""
    out, state = [], {}
    order = ["src_ip", "ts_us", "dst_ip", "src_port", "dst_port", "protocol", "packet_size", "tcp_flags"]
    for p in sorted(window_stats(rows), key=lambda r: [r[c] for c in order]):
        rate, ports, syns, n = p["src_total_packets"] / 3.0, p["src_unique_dst_ports"], p["syn_count"], p["src_total_packets"]
        base, last = state.get(p["src_ip"], (0.0, None))
        if ports >= 15:
            kind = "Port Scan"
        elif syns / n >= 0.85 and rate >= 50:
            kind = "SYN Flood"
        elif rate >= 500:
            kind = "DoS Attack"
        elif base > 0 and rate >= 5 * base:
            kind = "Traffic Spike"
        elif ports > 20:
            kind = "PortScan"
        elif syns > 40:
            kind = "SYNFlood"
        elif rate > 400:
            kind = "DoS"
        elif rate > 100 or syns > 15:
            kind = "Suspicious"
        else:
            if last is not None and p["ts_us"] - last < gap:
                continue
            state[p["src_ip"]] = (next_baseline(base, rate), p["ts_us"])
            kind = ""
        out.append((p["src_ip"], p["ts_us"], kind))
    return sorted(out)


def test_adaptive_detector_matches_row_by_row(spark):
    rows = random_packets(300, seed=5, sources=2)
    rows += [packet(1, 30_000_000 + i * 2000, dport=80 + i % 5) for i in range(250)]  # a burst over a quiet baseline
    rows += [packet(2, 50_000_000 + i * 1000, dport=500 + i) for i in range(20)]  # a scan
    got = table(detect_adaptive(packets(spark, rows)), "src_ip", "ts_us", "attack_type")
    want = by_hand(rows)
    assert got == want
    assert {"Traffic Spike", "", "Port Scan"} <= {k for _, _, k in want}
    # the burst alone spans several chunks; one source has a null address
    rows.append((None, *packet(1, 5)[1:]))
    whole = packets(spark, rows)
    columns = ["ts_us", "attack_type", "baseline"]
    split = sorted(map(str, detect_adaptive(whole, chunk_rows=30).select("src_ip", *columns).collect()))
    assert split == sorted(map(str, detect_adaptive(whole).select("src_ip", *columns).collect()))


def test_normals_are_limited_to_one_per_gap(spark):
    times = [0, 499_999, 500_000, 999_999, 1_000_000, 5_000_000]
    rows = [(1, START + t, 0) for t in times] + [(1, START + 10, 2), (2, START + 1, 0)]
    df = spark.createDataFrame(rows, "src_ip long, ts_us long, severity int").repartition(3)
    got = table(limit_normals(df), "src_ip", "ts_us", "severity")
    assert [(s, t - START) for s, t, _ in got] == [(1, 0), (1, 10), (1, 500_000), (1, 1_000_000), (1, 5_000_000), (2, 1)]
    for rows_each in (1, 2):
        assert table(limit_normals(df, chunk_rows=rows_each), "src_ip", "ts_us", "severity") == got
    assert limit_normals(df.filter("false"), chunk_rows=2).count() == 0
    assert table(limit_normals(df, chunk_rows=None), "src_ip", "ts_us", "severity") == got


def test_kept_times_match_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(4000)) for _ in range(600)]
    want = []
    for key in (None, 1, 2, 3):
        last = None
        for t in sorted(t for k, t in rows if k == key):
            if last is None or t - last >= 37:
                last = t
                want.append((key, t))
    df = spark.createDataFrame(rows, "k long, t long").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = [tuple(r) for r in keep_spaced(df, ["k"], ["t"], 37).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert kept_times(np.array([1, 1, 2]), None, 0).tolist() == [0, 1, 2] and kept_times(np.array([5]), 1, 10).tolist() == []


@pytest.mark.parametrize("order", ["i", "t", "s", "d"])
def test_long_keys_are_split_without_being_told_how(spark, order):
    rows = [(k, i, float(i % 7 * (1 + k))) for k, n in [(1, 300), (2, 20)] for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i long, v double").repartition(3).withColumns({
        "t": F.timestamp_seconds(F.col("i") * 3600), "s": F.format_string("%05d", "i"), "d": F.col("i").cast("decimal(10,2)")})
    columns = ["k", "i", "baseline", "baseline_after"]
    want = table(baseline_ewma(df, ["k"], [order], "v", chunk_rows=None), *columns)
    assert table(baseline_ewma(df, ["k"], [order], "v", chunk_rows=50), *columns) == want
    assert long_keys(df, ["k"], 300) is None and [r.k for r in long_keys(df, ["k"], 50).collect()] == [1]
    with pytest.raises(ValueError):
        coarse(df.withColumn("x", F.array("i")), "x")


def test_detect_needs_one_shuffle(spark):
    found = detect(packets(spark, random_packets(10), 1))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan


def ewma_by_hand(values):
    b, out = 0.0, []
    for x in values:
        out.append((b, next_baseline(b, x)))
        b = out[-1][1]
    return out


def test_next_baseline():
    assert next_baseline(0.0, 7.0) == 7.0
    assert next_baseline(10.0, 20.0) == (1 - 0.3) * 10 + 0.3 * 20
    assert next_baseline(10.0, 21.0) == (1 - 0.5) * 10 + 0.5 * 21
    assert next_baseline(10.0, 51.0) == (1 - 0.7) * 10 + 0.7 * 51


def test_baseline_split_equals_sequential(spark):
    import random

    rng = random.Random(1)
    rows = [(k, i, rng.choice([1.0, 4.0, 30.0]) * rng.random()) for k, n in [(1, 2000), (2, 150), (3, 1)] for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i long, v double").repartition(5)
    want = sorted(
        (k, i, *pair) for k in (1, 2, 3)
        for i, pair in enumerate(ewma_by_hand([v for kk, _, v in rows if kk == k]))
    )
    assert table(baseline_ewma(df, ["k"], ["i"], "v"), "k", "i", "baseline", "baseline_after") == want
    split = baseline_ewma(df, ["k"], ["i"], "v", block=F.expr("i div 50"), chunk_rows=120)
    assert table(split, "k", "i", "baseline", "baseline_after") == want
    tiny = baseline_ewma(df.filter("k = 2"), ["k"], ["i"], "v", block=F.expr("i div 50"), chunk_rows=25)
    assert table(tiny, "i", "baseline") == [(i, b) for k, i, b, _ in want if k == 2]
    assert table(final_baseline(df, ["k"], ["i"], "v"), "k", "baseline") == [
        (k, max((i, a) for kk, i, _, a in want if kk == k)[1]) for k in (1, 2, 3)
    ]


@pytest.mark.parametrize("chunk_rows", [100_000, 40])
def test_adaptive_threshold_matches_brute_force(spark, chunk_rows):
    import random

    rng = random.Random(2)
    values = [float(rng.randrange(100)) for _ in range(200)]
    values[120] = 900.0
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i long, v double").repartition(4)
    got = adaptive_threshold(df, ["k"], ["i"], "v", F.expr("i div 16"), window=30, k=3.0, warmup=50, chunk_rows=chunk_rows)
    for r, i in zip(got.orderBy("i").collect(), range(200)):
        past = values[max(0, i - 30):i]
        assert (r.seen, r.samples, r.warmed_up) == (i, len(past), i >= 50)
        assert (r.lifetime_min, r.lifetime_max) == ((min(values[:i]), max(values[:i])) if i else (None, None))
        if len(past) < 2:
            assert r.threshold == 1e18 and not r.is_suspicious
            continue
        mean, sd = statistics.fmean(past), statistics.stdev(past)
        assert math.isclose(r.mean, mean) and math.isclose(r.stddev, sd, abs_tol=1e-9)
        assert r.is_suspicious == (i >= 50 and values[i] > mean + 3 * sd)
        assert r.is_attack == (i >= 50 and values[i] > mean + 6 * sd)
    assert got.filter("is_attack").count() == 1


def scaler_rows(spark, n):
    cols = "i long, packet_rate double, unique_ports double, syn_count double, avg_packet_size double, connection_count double, syn_ratio double"
    return spark.createDataFrame([(i, float(i), 5.0, float(i % 7), 100.0 + i, 1.0 * (i % 3), 0.5) for i in range(n)], cols).repartition(3)


def test_scaler_warm_up_and_modes(spark):
    df = scaler_rows(spark, 300)
    got = {r.i: r for r in fit_transform(df, ["i"], 200).collect()}
    assert got[198].packet_rate == 198.0  # the row before the 200th is raw
    assert got[199].packet_rate == 1.0 and got[250].packet_rate == 1.0  # clamped above the fitted range
    assert got[250].unique_ports == 0.0 and got[250].syn_ratio == 0.5  # flat range; derived feature untouched
    z = {r.i: r for r in apply_scaler(df, fit_scaler(df, ["i"], 200), "zscore").collect()}
    assert math.isclose(z[0].packet_rate, -99.5 / statistics.stdev(range(200))) and z[0].unique_ports == 0.0
    few = apply_scaler(df, fit_scaler(df, ["i"], 301))
    assert few.filter("packet_rate <> i").count() == 0  # not fitted: nothing changes


def test_scaler_override_and_statistics(spark):
    df = scaler_rows(spark, 300)
    stats = override_range(fit_scaler(df, ["i"], 200), "packet_rate", 0, 1000)
    got = {r.feature: r for r in scaler_stats(stats).collect()}
    assert (got["packet_rate"].min, got["packet_rate"].max, got["packet_rate"].is_fitted) == (0.0, 1000.0, True)
    assert apply_scaler(df, stats).filter("i = 250").first().packet_rate == 0.25


def test_bucketed_scores_equal_direct_ones_for_single_rows(spark):
    rows = [packet(s, ts=s, sport=s * 10, size=60 * s) for s in range(1, 20)]
    feats = packet_features(packets(spark, rows))
    both = score_bucketed(feats, score_heuristic, ["ts_us", "src_ip"])
    assert table(both, "src_ip", "ml_score", "ml_label") == table(score_heuristic(feats), "src_ip", "ml_score", "ml_label")
    reuse = bucket_reuse(feats).first()
    assert reuse.rows == 19 and 0 <= reuse.reuse_ratio < 1


def test_brute_force_helper_agrees_on_itself():
    assert as_dicts([packet()])[0]["ts_us"] == START


def test_scores_meet_their_rows_in_tasks_by_counted_rows(spark):
    rows = random_packets(300, seed=23)
    order = ["ts_us", *FLOW_KEY, "packet_size", "tcp_flags"]
    f = packet_features(packets(spark, rows)).persist()
    columns = [*order, "ml_score", "ml_label"]
    whole = score_bucketed(f, score_heuristic, order)
    for rows_each in (1_000_000, 10):
        got = score_bucketed(f, score_heuristic, order, rows_each=rows_each, task_rows=20)
        plan = got._jdf.queryExecution().toString()
        assert plan.count(", 15)") >= 2 and "_salt" in plan  # both sides of the join, 300 rows by 20
        assert table(got, *columns) == table(whole, *columns)
