"""Rows with null keys, labels, rates and features stay, whatever the way of splitting."""

import math

import pytest
from pyspark.sql import functions as F

from packetlens.functions.labels import clip
from packetlens.functions.net import ip_to_long
from packetlens.operators.baseline import adaptive_threshold, baseline_ewma
from packetlens.operators.features import feature_bucket
from packetlens.operators.scoring import score_bucketed, score_heuristic
from packetlens.operators.training import rebalance, stratified_split
from packetlens.operators.spread import positions


@pytest.fixture(scope="module")
def series(spark):
    rows = [(None if i % 2 else 7, i, None if i % 5 == 3 else float(i % 4)) for i in range(40)]
    return spark.createDataFrame(rows, "src_ip long, ts_us long, rate double")


def test_positions_keep_null_keys(series):
    got = positions(series, ["src_ip"], F.expr("ts_us div 10"), ["ts_us"], "n").collect()
    assert sorted((r.src_ip is None, r.n) for r in got) == [(k, n) for k in (False, True) for n in range(1, 21)]


def test_split_and_plain_folds_agree(series):
    block = F.expr("ts_us div 10")
    plain = sorted(map(str, baseline_ewma(series, ["src_ip"], ["ts_us"], "rate").collect()))
    assert len(plain) == 40
    assert sorted(map(str, baseline_ewma(series, ["src_ip"], ["ts_us"], "rate", block, chunk_rows=3).collect())) == plain


def test_one_baseline_for_all_rows(series):
    got = baseline_ewma(series, [], ["ts_us"], "rate", F.expr("ts_us div 10"), chunk_rows=7).orderBy("ts_us").collect()
    one = series.withColumn("all", F.lit(1))
    want = baseline_ewma(one, ["all"], ["ts_us"], "rate").orderBy("ts_us").collect()
    assert [(r.ts_us, r.baseline, r.baseline_after) for r in got] == [(r.ts_us, r.baseline, r.baseline_after) for r in want]
    again = baseline_ewma(series, [], ["ts_us"], "rate", chunk_rows=7).orderBy("ts_us").collect()
    assert [(r.ts_us, r.baseline_after) for r in again] == [(r.ts_us, r.baseline_after) for r in want]


def test_thresholds_keep_null_keys(series):
    assert adaptive_threshold(series, ["src_ip"], ["ts_us"], "rate", F.expr("ts_us div 10"), window=5, chunk_rows=6).count() == 40


def test_rows_without_a_label_stay(spark):
    rows = [(i, [None, "Normal", "DoS", "Normal"][i % 4]) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, label string")
    assert stratified_split(frame, key=["id"]).count() == 40
    assert rebalance(frame, key=["id"]).filter("label is null").count() == 10


def test_clip_and_addresses(spark):
    frame = spark.createDataFrame([(1.0,), (None,), (math.nan,), (9.0,)], "v double")
    got = [r[0] for r in frame.select(clip("v", (2.0, 5.0))).collect()]
    assert got[0] == 2.0 and got[1] is None and math.isnan(got[2]) and got[3] == 5.0
    texts = spark.createDataFrame([("1.2.3.4",), ("1.2.3.999",), ("1.2.3.-4",), ("1.2.3",)], "t string")
    assert [r[0] for r in texts.select(ip_to_long("t")).collect()] == [16909060, None, None, None]


def test_broken_features_share_no_bucket(spark):
    base = {"packet_rate": 1.0, "unique_ports": 1.0, "syn_count": 50.0, "avg_packet_size": 1.0, "connection_count": 1.0,
            "syn_ratio": 0.0, "port_scan_rate": 0.0, "bytes_per_sec": 0.0}
    rows = [(0, *(base | {"packet_rate": None}).values()), (1, *(base | {"packet_rate": 0.0}).values()), (2, *(base | {"packet_rate": math.nan}).values())]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in base))
    assert feature_bucket(frame).select("bucket").distinct().count() == 3
    got = {r.id: (r.ml_score, r.ml_label) for r in score_bucketed(frame, score_heuristic, ["id"]).collect()}
    assert got == {r.id: (r.ml_score, r.ml_label) for r in score_heuristic(frame).collect()}
