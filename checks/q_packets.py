"""Sources, packet predicates, rate cap, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.functions.net import (
    TCP_FLAGS, filter_protocols, has_flag, ip_to_long, ip_to_string, is_syn, protocol_name, severity_code, severity_name,
)
from packetlens.operators.ratecap import capture_counters, rate_cap
from packetlens.sources.frames import decode_descriptors, decode_frames, read_frames
from packetlens.sources.sinks import prediction_lines
from packetlens.sources.tables import parse_prediction_lines

from .inputs import descriptors, frames, labelled, packets, stored, table
from .registry import check
from .sql import BASE, ip, query


@check(query(
    f"SELECT {BASE} FROM packets WHERE packet_size % 11 <> 0 AND packet_size % 13 <> 0 AND packet_size % 17 <> 0", "packets"
))
def decode_ethernet_frames(spark, sf):
    return decode_frames(read_frames(spark, stored(frames(spark, sf)))).drop("ts")


@check(query(f"SELECT {BASE} FROM packets", "packets"))
def decode_packet_descriptors(spark, sf):
    return decode_descriptors(spark.read.parquet(stored(descriptors(spark, sf)))).drop("ts")


@check(query("SELECT actual, pred FROM labelled", "labelled"))
def prediction_log_lines(spark, sf):
    return parse_prediction_lines(prediction_lines(labelled(spark, sf)))


# Protocol numbers of many kinds, from the parts' sizes.
_KINDS = "SELECT p_partkey AS id, CAST(p_size % 20 AS INT) AS protocol FROM part"


@check(f"SELECT id, protocol FROM ({_KINDS}) WHERE protocol IN (1, 6, 17)")
def keep_ip_protocols(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "CAST(p_size % 20 AS INT) AS protocol")
    return filter_protocols(rows)


@check(
    f"SELECT id, protocol, CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'UNKNOWN' END AS protocol_name FROM ({_KINDS})"
)
def protocol_names(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "CAST(p_size % 20 AS INT) AS protocol")
    return rows.withColumn("protocol_name", protocol_name("protocol"))


@check(query(f"SELECT {BASE} FROM packets WHERE protocol = 6 AND (tcp_flags & 18) = 2", "packets"))
def syn_packets(spark, sf):
    return packets(spark, sf).filter(is_syn())


_BITS = {n: f"(protocol = 6 AND (f & {b}) <> 0)" for n, b in TCP_FLAGS.items()}


@check(query(
    "SELECT protocol, f, " + ", ".join(f"count(*) FILTER {s} AS {n.lower()}" for n, s in _BITS.items())
    + " FROM (SELECT protocol, (tcp_flags + packet_size) % 256 AS f FROM packets) GROUP BY 1, 2", "packets"
))
def tcp_flag_counts(spark, sf):
    rows = packets(spark, sf).selectExpr("protocol", "(tcp_flags + packet_size) % 256 AS f")
    return rows.groupBy("protocol", "f").agg(*[F.count_if(has_flag(n, "f")).alias(n.lower()) for n in TCP_FLAGS])


@check(query(
    f"SELECT DISTINCT src_ip, {ip('src_ip')} AS text, dst_ip, {ip('dst_ip')} AS dst_text, src_ip AS back FROM packets", "packets"
))
def ip_text(spark, sf):
    rows = packets(spark, sf).select("src_ip", "dst_ip").distinct()
    return rows.withColumns({"text": ip_to_string("src_ip"), "dst_text": ip_to_string("dst_ip")}).withColumn(
        "back", ip_to_long("text")
    )


@check(
    "SELECT doc_id, s AS severity, CASE s WHEN 2 THEN 'ATTACK' WHEN 1 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS name, s AS code "
    "FROM (SELECT doc_id, quality + toxic AS s FROM labels)"
)
def severity_names(spark, sf):
    rows = table(spark, sf, "labels").selectExpr("doc_id", "quality + toxic AS severity")
    return rows.withColumn("name", severity_name("severity")).withColumn("code", severity_code("name"))


_RANKED = f"""SELECT {BASE}, row_number() OVER (PARTITION BY {{keys}}ts_us // 1000000
  ORDER BY ts_us, src_ip, dst_ip, src_port, dst_port, protocol, tcp_flags, packet_size) AS rn FROM packets"""


@check(query(f"SELECT {BASE} FROM r WHERE rn <= 100", "packets", r=_RANKED.format(keys="")))
def rate_capped_packets(spark, sf):
    order = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags", "packet_size"]
    return rate_cap(packets(spark, sf), cap=100, order=order)


@check(query(f"SELECT {BASE} FROM r WHERE rn <= 5", "packets", r=_RANKED.format(keys="src_ip, ")))
def rate_capped_per_source(spark, sf):
    order = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags", "packet_size"]
    return rate_cap(packets(spark, sf), cap=5, keys=["src_ip"], order=order)


@check(query(
    """SELECT CAST(sum(n) AS BIGINT) AS seen, CAST(sum(n - k) AS BIGINT) AS filtered,
      CAST(sum(greatest(0, k - 100)) AS BIGINT) AS dropped, CAST(sum(least(100, k)) AS BIGINT) AS sent
      FROM (SELECT ts_us // 1000000 AS b, count(*) AS n, count(*) FILTER (protocol IN (1, 6, 17)) AS k
            FROM (SELECT ts_us, CASE WHEN dst_port % 7 = 0 THEN 47 ELSE protocol END AS protocol FROM packets) GROUP BY 1)""",
    "packets",
))
def capture_counter_totals(spark, sf):
    rows = packets(spark, sf).withColumn("protocol", F.expr("CASE WHEN dst_port % 7 = 0 THEN 47 ELSE protocol END"))
    return capture_counters(rows, cap=100)
