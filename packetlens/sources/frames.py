"""Captured frames and packet descriptors -> the packet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FRAMES

# Layout of an Ethernet / IPv4 frame (0-based byte offsets).
ETHERNET_HEADER = 14
ETHERTYPE_AT = 12
IPV4_ETHERTYPE = 0x0800
IPV4_HEADER_MIN = 20
PROTOCOL_AT = 23
SRC_AT, DST_AT = 26, 30
TCP_MIN, UDP_MIN = 14, 8  # bytes needed to read ports and flags
TCP_FLAGS_AT = 13

# Layout of a 24-byte little-endian descriptor: column -> (offset, bytes).
DESCRIPTOR_FIELDS = {
    "src_ip": (0, 4), "dst_ip": (4, 4), "src_port": (8, 2), "dst_port": (10, 2), "protocol": (12, 1),
    "tcp_flags": (13, 1), "packet_size": (14, 2), "ts_nsec": (16, 8),
}
DESCRIPTOR_BYTES = 24


def read_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Captured frames (data, caplen, ts) from Parquet, as a table or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FRAMES).parquet(path)


def _big_endian(data: str, at, size: int) -> Column:
    """Unsigned number from `size` bytes at a 0-based offset (a number or a column)."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substr(F.col(data), at + 1, F.lit(size))), 16, 10).cast("bigint")


def decode_frames(df: DataFrame) -> DataFrame:
    """IPv4 TCP, UDP and ICMP frames as packets; every other frame is dropped.

    Built-in expressions only, so decoding stays in the scan stage's generated code.
    """
    have = F.length("data")
    ip_length = F.col("caplen") - ETHERNET_HEADER
    header = _big_endian("data", ETHERNET_HEADER, 1)
    ihl = (header.bitwiseAND(15) * 4).cast("int")
    is_ipv4 = (
        (have >= ETHERNET_HEADER + IPV4_HEADER_MIN)
        & (_big_endian("data", ETHERTYPE_AT, 2) == IPV4_ETHERTYPE)
        & (ip_length >= IPV4_HEADER_MIN)
        & (F.shiftright(header, 4) == 4)
        & (ihl <= ip_length)
    )
    start = F.lit(ETHERNET_HEADER) + F.col("_ihl")
    rest = F.col("caplen") - start
    proto = F.col("protocol")
    readable = (
        F.when(proto == 6, (rest >= TCP_MIN) & (have >= start + TCP_MIN))
        .when(proto == 17, (rest >= UDP_MIN) & (have >= start + 4))
        .otherwise(proto == 1)
    )
    ports = proto != 1
    return (
        df.filter(is_ipv4)
        .withColumns({"_ihl": ihl, "protocol": _big_endian("data", PROTOCOL_AT, 1).cast("int")})
        .filter(proto.isin(1, 6, 17) & readable)
        .select(
            _big_endian("data", SRC_AT, 4).alias("src_ip"),
            _big_endian("data", DST_AT, 4).alias("dst_ip"),
            F.when(ports, _big_endian("data", start, 2)).otherwise(0).cast("int").alias("src_port"),
            F.when(ports, _big_endian("data", start + 2, 2)).otherwise(0).cast("int").alias("dst_port"),
            "protocol",
            ((F.col("caplen") - ETHERNET_HEADER) % 65536).cast("int").alias("packet_size"),
            F.when(proto == 6, _big_endian("data", start + TCP_FLAGS_AT, 1)).otherwise(0).cast("int").alias("tcp_flags"),
            F.unix_micros("ts").alias("ts_us"),
            "ts",
        )
    )


def _little_endian(record: str, at: int, size: int) -> Column:
    octets = [F.hex(F.substr(F.col(record), F.lit(at + i + 1), F.lit(1))) for i in reversed(range(size))]
    return F.conv(F.concat(*octets), 16, 10).cast("bigint")


def decode_descriptors(df: DataFrame, record: str = "record") -> DataFrame:
    """24-byte descriptors as packets; records of another length are dropped."""
    fields = {name: _little_endian(record, at, size) for name, (at, size) in DESCRIPTOR_FIELDS.items()}
    ts_us = F.expr("ts_nsec div 1000")
    wide = ("src_ip", "dst_ip", "ts_nsec")
    return (
        df.filter(F.length(record) == DESCRIPTOR_BYTES)
        .select(*[(c if n in wide else c.cast("int")).alias(n) for n, c in fields.items()])
        .withColumns({"ts_us": ts_us, "ts": F.timestamp_micros(ts_us)})
        .drop("ts_nsec")
    )
