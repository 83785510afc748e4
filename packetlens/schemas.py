"""Table layouts and tunable thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T



FRAMES = T.StructType([
    T.StructField("data", T.BinaryType()),
    T.StructField("caplen", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
])

DESCRIPTORS = T.StructType([T.StructField("record", T.BinaryType())])

PACKETS = T.StructType([
    T.StructField("src_ip", T.LongType()),
    T.StructField("dst_ip", T.LongType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("packet_size", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])

TRAINING = T.StructType([
    T.StructField("packet_rate", T.DoubleType()),
    T.StructField("unique_ports", T.DoubleType()),
    T.StructField("syn_count", T.DoubleType()),
    T.StructField("avg_packet_size", T.DoubleType()),
    T.StructField("conn_count", T.DoubleType()),
    T.StructField("label", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("actual", T.StringType()),
    T.StructField("pred", T.StringType()),
])

# A flow is directional: (a -> b) and (b -> a) are two flows.
FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

# The five numbers the models and the scaler work on, in their fixed order.
MODEL_FEATURES = ["packet_rate", "unique_ports", "syn_count", "avg_packet_size", "connection_count"]
DERIVED_FEATURES = ["syn_ratio", "port_scan_rate", "bytes_per_sec"]
TRAINING_FEATURES = ["packet_rate", "unique_ports", "syn_count", "avg_packet_size", "conn_count"]

# Severity codes.
NORMAL, SUSPICIOUS, ATTACK = 0, 1, 2

SECOND_US = 1_000_000


@dataclass(frozen=True)
class RuleThresholds:
    """Fixed default values of the detection rules."""

    port_scan_ports: int = 15
    syn_flood_ratio: float = 0.85
    syn_flood_rate: float = 50.0
    dos_rate: float = 500.0
    spike_multiplier: float = 5.0
    # A port scan this many times over its threshold is an attack.
    port_scan_attack_factor: int = 3
