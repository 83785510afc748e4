"""Ordered detection rules; the first that matches a packet's features names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_to_string
from ..functions.text import fixed, whole
from ..schemas import ATTACK, SUSPICIOUS, RuleThresholds

def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def rules(
    df: DataFrame,
    thresholds: RuleThresholds = RuleThresholds(),
    window_secs: int = 3,
    baseline: str | None = None,
) -> DataFrame:
    """Add rule_type, rule_reason, rule_severity (null where no rule matches).

    Order: port scan, SYN flood, volumetric flood and, when a `baseline` column is named, traffic
    spike over that baseline.
    """
    # The rule names and the wording of their reasons.
    t = thresholds
    ports, rate = F.col("src_unique_dst_ports"), F.col("packet_rate")
    scan = _text(
        "Port scan: ", ports.cast("string"), " unique ports from ", ip_to_string("src_ip"),
        f" in {window_secs}s window (threshold: {t.port_scan_ports})",
    )
    scan_severity = F.when(ports >= t.port_scan_ports * t.port_scan_attack_factor, ATTACK).otherwise(SUSPICIOUS)
    syn = _text(
        "SYN flood: ratio=", fixed("syn_ratio", 2), " (", whole("syn_count"), " SYNs / ",
        whole("connection_count"), " pkts) at ", fixed(rate, 1), " pkt/s",
    )
    flood = _text(
        "DoS flood: ", fixed(rate, 1), " pkt/s (", whole(F.col("bytes_per_sec") / 1000.0),
        f" KB/s) (threshold: {t.dos_rate:.1f})",
    )
    # (condition, name, reason, severity) in order of precedence.
    ordered = [
        (ports >= t.port_scan_ports, "Port Scan", scan, scan_severity),
        ((F.col("syn_ratio") >= t.syn_flood_ratio) & (rate >= t.syn_flood_rate), "SYN Flood", syn, F.lit(ATTACK)),
        (rate >= t.dos_rate, "DoS Attack", flood, F.lit(ATTACK)),
    ]
    if baseline:
        usual = F.col(baseline)
        spike = _text(
            "Traffic spike: ", fixed(rate, 1), " pkt/s is ", fixed(rate / usual, 1), "x above baseline (",
            fixed(usual, 1), " pkt/s)",
        )
        ordered.append((spikes(rate, usual, t), "Traffic Spike", spike, F.lit(SUSPICIOUS)))

    def first_match(value) -> Column:
        # One CASE per column over the same cheap conditions: an unused reason is pruned away.
        out = F
        for condition, *rest in ordered:
            out = out.when(condition, value(*rest))
        return out

    return df.withColumns({
        "rule_type": first_match(lambda name, reason, severity: F.lit(name)),
        "rule_reason": first_match(lambda name, reason, severity: reason),
        "rule_severity": first_match(lambda name, reason, severity: severity.cast("int")),
    })


def spikes(value, baseline, thresholds: RuleThresholds = RuleThresholds()) -> Column:
    """The spike condition alone, for any rate series with a baseline column."""
    value, baseline = (F.col(c) if isinstance(c, str) else c for c in (value, baseline))
    return (baseline > 0) & (value >= baseline * thresholds.spike_multiplier)
