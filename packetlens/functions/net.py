"""Packet-level column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IANA protocol numbers.
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}

# TCP flag bits.
TCP_FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}

# Severity names.
SEVERITIES = {0: "NORMAL", 1: "SUSPICIOUS", 2: "ATTACK"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(c, names: dict[int, str], default: str) -> Column:
    c = _col(c)
    out = None
    for code, name in names.items():
        out = F.when(c == code, name) if out is None else out.when(c == code, name)
    return out.otherwise(default)


def ip_to_string(c) -> Column:
    """IPv4 number -> dotted text."""
    c = _col(c)
    return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ip_to_long(c) -> Column:
    """Dotted IPv4 text -> number; null unless the text is four numbers from 0 to 255."""
    parts = F.split(_col(c), r"\.")
    numbers = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    octets = [F.when(n.between(0, 255), n) for n in numbers]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(F.size(parts) == 4, value)


def protocol_name(c) -> Column:
    return _lookup(c, PROTOCOLS, "UNKNOWN")


def severity_name(c) -> Column:
    return _lookup(c, SEVERITIES, "NORMAL")


def severity_code(c) -> Column:
    """Severity name -> code, the inverse of `severity_name`."""
    c = _col(c)
    return F.when(c == "ATTACK", 2).when(c == "SUSPICIOUS", 1).otherwise(0)


def has_flag(name: str, flags="tcp_flags", protocol="protocol") -> Column:
    """True when a TCP packet carries the named flag."""
    return (_col(protocol) == 6) & (_col(flags).bitwiseAND(TCP_FLAGS[name]) != 0)


def is_syn(flags="tcp_flags", protocol="protocol") -> Column:
    """Connection attempt: TCP with SYN set and ACK clear."""
    both = TCP_FLAGS["SYN"] | TCP_FLAGS["ACK"]
    return (_col(protocol) == 6) & (_col(flags).bitwiseAND(both) == TCP_FLAGS["SYN"])


def filter_protocols(df):
    """Keep TCP, UDP and ICMP; a plain IN filter, so it reaches the Parquet scan."""
    return df.filter(F.col("protocol").isin(*PROTOCOLS))
