"""Packet, flow and prediction tables derived from the given tables.

The given data holds no packets, so they are computed from `lineitem` by expressions both engines
accept unchanged: by supplier, some sources flood, some scan, most behave.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.session import shared_dir

ROLE = """
  SELECT l_suppkey, l_partkey, l_quantity, CAST(l_suppkey % 10 AS BIGINT) AS k,
         (l_orderkey*1000003 + l_linenumber*7919 + l_partkey*31337) AS h
  FROM {lineitem}"""

PACKET_COLUMNS = """
  CAST(167772160 + CASE WHEN k<=2 THEN l_suppkey-k ELSE l_suppkey END AS BIGINT) AS src_ip,
  CAST(3232235776 + CASE WHEN k IN (3,4) THEN 1 ELSE l_partkey % 4 END AS BIGINT) AS dst_ip,
  CAST(CASE WHEN k IN (3,4,5) THEN 40000 ELSE 40000 + l_partkey % 5 END AS INT) AS src_port,
  CAST(CASE WHEN k=3 THEN 1 + l_partkey % 200 WHEN k=4 THEN 1 + l_partkey % 30
            WHEN k=5 THEN 80 ELSE 440 + l_partkey % 6 END AS INT) AS dst_port,
  CAST(CASE WHEN k=9 THEN 17 ELSE 6 END AS INT) AS protocol,
  CAST(CASE WHEN k=9 THEN 0 WHEN k IN (3,4,5) THEN 2
            WHEN h % 20 = 0 THEN 2 WHEN h % 20 = 1 THEN 18 ELSE 16 END AS INT) AS tcp_flags,
  CAST(40 + l_quantity*28 AS INT) AS packet_size,
  CAST(1704067200000000 + (h % CASE WHEN k<=2 THEN 3000000 WHEN k=3 THEN 20000000
                                    WHEN k=5 THEN 6000000 ELSE 60000000 END) AS BIGINT) AS ts_us"""

PACKETS_SQL = f"SELECT {PACKET_COLUMNS} FROM ({ROLE.format(lineitem='lineitem')}) b"

# Labelled flow rows as the flow files hold them: raw labels, infinities, values out of bounds.
FLOW_SQL = """
  SELECT l_orderkey AS row_a, l_linenumber AS row_b, l_partkey AS row_c, l_suppkey AS row_d,
    CAST(l_quantity AS BIGINT) AS row_e,
    CASE WHEN l_partkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_partkey % 89 = 0 THEN CAST('NaN' AS DOUBLE)
         ELSE l_extendedprice * 25 - 60000 END AS packet_rate,
    CAST(l_quantity * 12 AS DOUBLE) AS syn_count,
    CASE WHEN l_suppkey % 83 = 0 THEN NULL ELSE l_quantity * 33 END AS avg_packet_size,
    CAST(l_orderkey * 7 AS DOUBLE) AS conn_count,
    CAST(l_partkey * 31 % 65536 AS DOUBLE) AS dst_port,
    CASE l_partkey % 30 WHEN 0 THEN 'DoS Hulk' WHEN 1 THEN 'DoS GoldenEye' WHEN 2 THEN ' DDoS ' WHEN 3 THEN 'PortScan'
      WHEN 4 THEN 'FTP-Patator' WHEN 5 THEN 'Web Attack  XSS' WHEN 6 THEN 'Bot' WHEN 7 THEN 'Infiltration'
      WHEN 8 THEN 'Heartbleed' WHEN 9 THEN 'Unheard of' WHEN 10 THEN 'SSH-Patator' WHEN 11 THEN 'DoS slowloris'
      ELSE 'BENIGN' END AS label
  FROM lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_of(lineitem: DataFrame) -> DataFrame:
    """The packet table of a `lineitem` table or stream."""
    role = lineitem.selectExpr(
        "l_suppkey", "l_partkey", "l_quantity", "CAST(l_suppkey % 10 AS BIGINT) AS k",
        "(l_orderkey*1000003 + l_linenumber*7919 + l_partkey*31337) AS h",
    )
    return role.selectExpr(*_split(PACKET_COLUMNS))


def _split(columns: str) -> list[str]:
    """The top-level comma separated expressions of a SELECT list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(table(spark, sf_dir, "lineitem"))


# Packets in four bursts with silence in between, a ninth of them from many short-lived senders, some of a protocol that
# the filter drops.
_IDLE = {
    "src_ip": "CAST(CASE WHEN packet_size % 9 = 0 THEN src_ip + 65536 * (1 + ts_us % 97) ELSE src_ip END AS BIGINT)",
    "protocol": "CAST(CASE WHEN packet_size % 13 = 5 THEN 47 ELSE protocol END AS INT)",
    "ts_us": "CAST(ts_us + ({ts} - 113594004) % 4 * 100000000 AS BIGINT)",
}


def idle_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = {c: F.expr(e.format(ts="ts_us div 15000000")) for c, e in _IDLE.items()}
    return packets(spark, sf_dir).withColumns(moved)


def idle_packets_sql(sql: str) -> str:
    """An oracle over `packets`, over the idle ones instead."""
    moved = ", ".join(f"{e.format(ts='ts_us // 15000000')} AS {c}" for c, e in _IDLE.items())
    plain = f"packets AS ({PACKETS_SQL})"
    if plain not in sql:
        raise ValueError("no packets in this query")
    return sql.replace(plain, f"packets AS (SELECT * REPLACE ({moved}) FROM ({PACKETS_SQL}))")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLOW_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def source_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and second: packets, bytes, connection attempts, ports."""
    return packets(spark, sf_dir).groupBy("src_ip", F.expr("ts_us div 1000000").alias("sec")).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.col("packet_size").cast("bigint")).alias("bytes"),
        F.sum(F.expr("CASE WHEN protocol=6 AND (tcp_flags & 18)=2 THEN 1 ELSE 0 END")).alias("syns"),
        F.count_distinct("dst_port").alias("ports"),
    )


def _hex(value: str, size: int):
    return F.lpad(F.hex(F.expr(value)), size * 2, "0")


def stored(df: DataFrame) -> str:
    """Write a derived table to the shared folder; return its path."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets as Ethernet frames, with some ARP and IPv6 ones, some cut short."""
    p = packets(spark, sf_dir)
    kind = F.when(F.col("packet_size") % 11 == 0, "0806").when(F.col("packet_size") % 13 == 0, "86DD").otherwise("0800")
    text = F.concat(
        F.lit("00" * 12), kind, F.lit("45" + "00" * 8), _hex("protocol", 1), F.lit("0000"), _hex("src_ip", 4),
        _hex("dst_ip", 4), _hex("src_port", 2), _hex("dst_port", 2), F.lit("00" * 9), _hex("tcp_flags", 1), F.lit("00" * 6),
    )
    short = F.col("packet_size") % 17 == 0
    return p.select(
        F.when(short, F.substring(F.unhex(text), 1, 13)).otherwise(F.unhex(text)).alias("data"),
        (F.col("packet_size") + 14).cast("int").alias("caplen"),
        F.timestamp_micros("ts_us").alias("ts"),
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets as 24-byte little-endian records."""
    sizes = {"src_ip": 4, "dst_ip": 4, "src_port": 2, "dst_port": 2, "protocol": 1, "tcp_flags": 1, "packet_size": 2, "ts_us * 1000 + 7": 8}
    parts = [_reversed(_hex(v, n), n) for v, n in sizes.items()]
    return packets(spark, sf_dir).select(F.unhex(F.concat(*parts)).alias("record"))


def _reversed(text, size: int):
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actual, pred) rows: order status against a guess from the price."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS actual",
        "CASE WHEN l_partkey % 3 = 0 THEN l_returnflag WHEN l_quantity > 25 THEN 'N' WHEN l_quantity > 2 THEN 'A' ELSE 'X' END AS pred",
    )


LABELLED_SQL = """
  SELECT l_returnflag AS actual, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag WHEN l_quantity > 25 THEN 'N'
    WHEN l_quantity > 2 THEN 'A' ELSE 'X' END AS pred FROM lineitem"""
