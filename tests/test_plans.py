"""What reaches the scan, and what is shuffled."""

from helpers import packets, random_packets
from pyspark.sql import functions as F

from packetlens.functions.net import filter_protocols
from packetlens.operators.flows import flow_sessions, flow_stats
from packetlens.operators.monitor import flagged_hosts, throughput
from packetlens.operators.training import add_class_weights
from packetlens.plans.detection import detect, detect_adaptive


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    path = str(tmp_path / "packets")
    packets(spark, random_packets(200)).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    rows = stored(spark, tmp_path)
    text = plan(throughput(filter_protocols(rows)))
    assert "In(protocol, [1,17,6])" in text or "In(protocol, [1,6,17])" in text
    assert "ReadSchema: struct<protocol:int,packet_size:int,ts_us:bigint>" in text


def test_unused_work_is_pruned(spark, tmp_path):
    df = detect(stored(spark, tmp_path)).groupBy("severity").count()
    assert "Port scan: " not in plan(df)  # no reason is rendered
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    # no source is over the limit, so what is for such has gone from the plan
    assert final.count("Exchange hashpartitioning(src_ip") == 1 and final.count("FileScan") == 1


def test_partial_aggregation_before_the_shuffle(spark, tmp_path):
    rows = stored(spark, tmp_path)
    assert "partial_min(ts_us" in plan(flow_sessions(rows))
    assert "partial_max(ts_us" in plan(flagged_hosts(detect(rows)))


def test_adaptive_detection_shares_its_shuffle(spark, tmp_path):
    df = detect_adaptive(stored(spark, tmp_path))
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_weights_need_no_join(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "label string")
    assert "Join" not in plan(add_class_weights(df))


def test_no_cartesian_products(spark, tmp_path):
    rows = stored(spark, tmp_path)
    for df in (flow_stats(rows), detect(rows), detect_adaptive(rows)):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
