"""Streams: the same rows through Structured Streaming, run to their end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.operators.verdict import DETECTION_COLUMNS
from packetlens.plans.detection import detect, packet_features
from packetlens.operators.scoring import score_heuristic
from packetlens.session import shared_dir
from packetlens.sources.frames import decode_frames, read_frames
from packetlens.streaming.detect import stream_adaptive, stream_detect, stream_limit_normals
from packetlens.streaming.flows import stream_flow_sessions, stream_flow_stats, stream_source_windows
from packetlens.streaming.flowtable import CurrentFlows, write_current_flows
from packetlens.streaming.ticks import stream_alert_ticks, stream_system_ticks, stream_ticks

from . import q_detect, q_flows, q_monitor, q_packets  # noqa: F401  (oracles)
from .inputs import frames, idle_packets, idle_packets_sql, packets, packets_of, stored, table
from .registry import ORACLE, check
from .sql import DETECTION, query

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packet_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "lineitem").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    return packets_of(raw).withColumn("ts", F.timestamp_micros("ts_us"))


def run(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all rows there are; return what it wrote."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    home = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{home}/out")
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{home}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


@check(ORACLE["flow_statistics"])
def streamed_flow_statistics(spark, sf):
    return run(spark, stream_flow_stats(packet_stream(spark, sf))).drop("ts")


_SOURCE_WINDOWS = """SELECT e - 3000000 AS start_us, e AS end_us, src_ip, count(*) AS packets, CAST(sum(packet_size) AS BIGINT) AS bytes,
      CAST(sum(CASE WHEN protocol=6 AND (tcp_flags & 18)=2 THEN 1 ELSE 0 END) AS BIGINT) AS syns
      FROM (SELECT *, (ts_us // 1000000 + unnest([1, 2, 3])) * 1000000 AS e FROM packets) GROUP BY ALL"""


@check(query(_SOURCE_WINDOWS, "packets"))
def streamed_source_windows(spark, sf):
    return run(spark, stream_source_windows(packet_stream(spark, sf)), "complete")


@check(ORACLE["flow_session_table"])
def streamed_flow_sessions(spark, sf):
    return run(spark, stream_flow_sessions(packet_stream(spark, sf)), "complete")


@check(ORACLE["throughput_per_second"])
def streamed_throughput(spark, sf):
    return run(spark, stream_ticks(packet_stream(spark, sf)), "complete")


@check(query(f"SELECT {DETECTION} FROM det", "det"))
def streamed_detections(spark, sf):
    return run(spark, stream_detect(packet_stream(spark, sf))).select(*DETECTION_COLUMNS)


def _stored(spark, df: DataFrame) -> DataFrame:
    """A table written to the shared folder, read back as a stream."""
    return spark.readStream.schema(df.schema).parquet(stored(df))


@check(query("SELECT ts_us // 1000000 AS sec, count(*) FILTER (severity = 1) AS suspicious, count(*) FILTER (severity = 2) AS attack FROM det GROUP BY 1", "det"))
def streamed_alert_counts(spark, sf):
    verdicts = q_detect.detections(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    return run(spark, stream_alert_ticks(_stored(spark, verdicts)), "complete")


@check(query("SELECT src_ip, ts_us, 0 AS severity FROM k WHERE kept", "det", recursive=True, **q_detect._LIMIT))
def streamed_normals_limited(spark, sf):
    verdicts = q_detect.detections(spark, sf).select("src_ip", "ts_us", "severity")
    return run(spark, stream_limit_normals(_stored(spark, verdicts)))


@check(ORACLE["detections_adaptive"])
def streamed_detections_adaptive(spark, sf):
    scored = score_heuristic(packet_features(packets(spark, sf)))
    return run(spark, stream_adaptive(_stored(spark, scored))).select(*DETECTION_COLUMNS, "baseline")


def in_parts(spark: SparkSession, df: DataFrame, parts: int = 4, files: int = 4) -> DataFrame:
    """The rows as a stream of `parts` micro-batches that follow each other in time. They are worked out once, then dealt."""
    home = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df = spark.read.schema(df.schema).parquet(stored(df))
    bounds = df.approxQuantile("ts_us", [i / parts for i in range(1, parts)], 0.01)
    part = sum((F.col("ts_us") > b).cast("int") for b in bounds)
    for i in range(parts):
        df.filter(part == i).repartition(files).write.mode("append").parquet(home)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(home)


def _packet_parts(spark, sf):
    return in_parts(spark, packets(spark, sf).withColumn("ts", F.timestamp_micros("ts_us")))


# Append mode gives a window once the watermark (in whole milliseconds, 10 s behind) reaches its end.
_FINAL = "(SELECT max(ts_us) // 1000 * 1000 - 10000000 FROM packets)"


@check(f"SELECT * FROM ({ORACLE['flow_session_table']}) WHERE session_end + 9000001 <= (SELECT max(session_end) // 1000 * 1000 - 10000000 FROM ({ORACLE['flow_session_table']}))")
def appended_flow_sessions(spark, sf):
    return run(spark, stream_flow_sessions(_packet_parts(spark, sf)))


@check(query(f"SELECT * FROM ({_SOURCE_WINDOWS}) WHERE end_us <= {_FINAL}", "packets"))
def appended_source_windows(spark, sf):
    return run(spark, stream_source_windows(_packet_parts(spark, sf)))


@check(query(f"SELECT * FROM thru WHERE (sec + 1) * 1000000 <= {_FINAL}", "thru", "packets"))
def appended_throughput(spark, sf):
    return run(spark, stream_ticks(_packet_parts(spark, sf)))


@check(query(
    f"""SELECT ts_us // 1000000 AS sec, count(*) FILTER (severity = 1) AS suspicious, count(*) FILTER (severity = 2) AS attack
      FROM det WHERE (ts_us // 1000000 + 1) * 1000000 <= {_FINAL} GROUP BY 1""", "det", "packets"
))
def appended_alert_counts(spark, sf):
    verdicts = q_detect.detections(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    return run(spark, stream_alert_ticks(in_parts(spark, verdicts)))


@check(ORACLE["flow_statistics"])
def streamed_flow_statistics_in_parts(spark, sf):
    return run(spark, stream_flow_stats(_packet_parts(spark, sf))).drop("ts")


@check(ORACLE["streamed_normals_limited"])
def streamed_normals_limited_in_parts(spark, sf):
    verdicts = q_detect.detections(spark, sf).select("src_ip", "ts_us", "severity")
    return run(spark, stream_limit_normals(in_parts(spark, verdicts)))


@check(ORACLE["detections_adaptive"])
def streamed_detections_adaptive_in_parts(spark, sf):
    scored = score_heuristic(packet_features(packets(spark, sf)))
    return run(spark, stream_adaptive(in_parts(spark, scored))).select(*DETECTION_COLUMNS, "baseline")


@check(ORACLE["detections_adaptive_idle"])
def streamed_detections_adaptive_idle(spark, sf):
    """In parts, with sources that the stream forgets in between."""
    scored = score_heuristic(packet_features(idle_packets(spark, sf)))
    return run(spark, stream_adaptive(in_parts(spark, scored), idle_secs=30)).select(*DETECTION_COLUMNS, "baseline")


@check(idle_packets_sql(ORACLE["streamed_normals_limited"]))
def streamed_normals_limited_idle(spark, sf):
    verdicts = detect(idle_packets(spark, sf)).select("src_ip", "ts_us", "severity")
    return run(spark, stream_limit_normals(in_parts(spark, verdicts)))


def _idle_parts(spark, sf):
    return in_parts(spark, idle_packets(spark, sf).withColumn("ts", F.timestamp_micros("ts_us")))


@check(ORACLE["current_flow_table"])
def streamed_current_flows(spark, sf):
    """Four micro-batches merged into the table, each of them twice, as after a failure."""
    home = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    held = CurrentFlows(f"{home}/flows", ttl_secs=None)

    def twice(stats, batch_id):
        arrived = spark.read.parquet(stored(stats))
        held.merge(arrived, batch_id)
        held.merge(arrived, batch_id)

    stats = in_parts(spark, q_flows._stats(spark, sf).withColumn("ts_us", F.col("last_seen"))).drop("ts_us")
    writer = stats.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
    writer.foreachBatch(twice).start().awaitTermination()
    return held.read(spark)


@check(idle_packets_sql(ORACLE["flows_unexpired"]))
def streamed_flows_unexpired(spark, sf):
    """Sliding statistics as a stream, kept as the table of flows of the last 30 s."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    home = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    held = CurrentFlows(f"{home}/flows", ttl_secs=30)
    stats = stream_flow_stats(_idle_parts(spark, sf)).select(*q_flows._CURRENT)
    write_current_flows(stats, held, f"{home}/state", availableNow=True).awaitTermination()
    return held.read(spark)


def _ticks_cut(sql: str) -> str:
    return f"SELECT * FROM ({sql}) WHERE (sec + 1) * 1000000 <= (SELECT max(sec) FROM ({sql})) * 1000000 - 10000000"


def _closed(ticks: DataFrame, p: DataFrame) -> DataFrame:
    """The seconds that both engines count as over: those of ten whole seconds before the last."""
    return ticks.filter(F.col("sec") + 1 <= p.agg(F.max(F.expr("ts_us div 1000000"))).scalar() - 10)


@check(_ticks_cut(ORACLE["system_ticks_idle"]))
def streamed_system_ticks(spark, sf):
    p = idle_packets(spark, sf)
    stamped = F.timestamp_micros("ts_us")
    verdicts = in_parts(spark, detect(p).select("ts_us", "severity").withColumn("ts", stamped))
    late = in_parts(spark, q_monitor._idle_latencies(spark, sf).select("detect_us", "ts_us"))
    return _closed(run(spark, stream_system_ticks(_idle_parts(spark, sf), verdicts, late, cap=1000)), p)


@check(ORACLE["decode_ethernet_frames"])
def streamed_ethernet_frames(spark, sf):
    """Captured frames that arrive as files, decoded as they come."""
    arrived = read_frames(spark, stored(frames(spark, sf)), streaming=True)
    return run(spark, decode_frames(arrived)).drop("ts")
