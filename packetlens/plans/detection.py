"""Packets in, verdicts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.baseline import next_baseline
from ..operators.features import features, fit_scaler
from ..operators.flows import flow_stats
from ..operators.rules import rules
from ..operators.scoring import Scorer, score_heuristic
from ..operators.sequential import CHUNK_ROWS, fold, fold_split, keep_spaced, long_keys
from ..operators.spread import join_keys, slot
from ..operators.verdict import DETECTION_COLUMNS, decide, ml_flag
from ..schemas import FLOW_KEY, NORMAL, SECOND_US, RuleThresholds
from ..session import shared_dir

NORMAL_GAP_MS = 500
IDLE_SECS = 3600  # a source without a packet for longer starts with a new baseline
CHUNK_BLOCK_US = 10 * SECOND_US  # coarse time of a split fold


def packet_features(packets: DataFrame, window_secs: int = 3, **how) -> DataFrame:
    """Sliding statistics and the feature columns of every packet."""
    return features(flow_stats(packets, window_secs, **how), window_secs)


def fit_first(
    packets: DataFrame, order: list[str], n: int = 200, since_us: int | None = None, window_secs: int = 3, **how
) -> DataFrame:
    """`fit_scaler` over the features of the first `n` packets (from `since_us` on).

    Windows only look back, so packets after the n-th one's time, or more than a window before
    `since_us`, are left out before any window is computed.
    """
    later = packets if since_us is None else packets.filter(F.col("ts_us") >= since_us)
    last = later.select("ts_us").orderBy("ts_us").limit(n).agg(F.max("ts_us")).scalar()
    near = packets.filter(F.col("ts_us") <= last)
    if since_us is None:
        return fit_scaler(packet_features(near, window_secs, **how), order, n)
    near = near.filter(F.col("ts_us") >= since_us - window_secs * SECOND_US)
    return fit_scaler(packet_features(near, window_secs, **how).filter(F.col("ts_us") >= since_us), order, n)


def detect(
    packets: DataFrame,
    thresholds: RuleThresholds = RuleThresholds(),
    scorer: Scorer = score_heuristic,
    window_secs: int = 3,
    **how,
) -> DataFrame:
    """One verdict per packet from the stateless rules and the scorer: one shuffle of the packets."""
    scored = scorer(packet_features(packets, window_secs, **how))
    return decide(rules(scored, thresholds, window_secs))


_NORMAL_STATE = T.StructType([T.StructField("baseline", T.DoubleType()), T.StructField("kept", T.BooleanType())])
# What rules and verdicts read of a scored packet.
_EVIDENCE = [
    "src_unique_dst_ports", "unique_ports", "packet_rate", "syn_ratio", "syn_count", "connection_count",
    "bytes_per_sec", "ml_score", "ml_label",
]


def detect_adaptive(
    packets: DataFrame,
    thresholds: RuleThresholds = RuleThresholds(),
    scorer: Scorer = score_heuristic,
    window_secs: int = 3,
    gap_ms: int = NORMAL_GAP_MS,
    keep: list[str] = (),
    chunk_rows: int | None = CHUNK_ROWS,
    idle_secs: int = IDLE_SECS,
    **how,
) -> DataFrame:
    """`detect` plus the traffic-spike rule over each source's own baseline: the verdict columns,
    `baseline`, `packet_rate` and the packet columns named in `keep`.

    Row by row per source: a packet spikes against the baseline so far; a packet that stays NORMAL
    is kept if `gap_ms` passed since the source's last kept one, and a kept one moves the baseline.
    NORMAL packets that are not kept are left out of the result. A source none of whose packets came through the
    fold for more than `idle_secs` starts anew, so that streams can forget it.

    Only packets no stateless rule matched go through that fold. The volumetric rule matches
    above `dos_rate`, so a source contributes at most dos_rate packets per second however hard
    it floods. Both halves read the same columns, so they share one shuffle of the packets.

    The packets of each source are counted first. One with more than `chunk_rows` is folded in parallel chunks
    (see `fold_split`); the result is the same. Then more jobs run at once, and the scored packets are written to
    the checkpoint folder and read from there. With None, nothing is counted or split.
    """
    scored = scorer(packet_features(packets, window_secs, **how)).withColumn("_ml", ml_flag())
    ruled = rules(scored, thresholds, window_secs)
    gap_us, idle_us, times = gap_ms * 1000, idle_secs * SECOND_US, thresholds.spike_multiplier

    def step(state, ts, rate, flagged):
        usual, last, seen = state or (0.0, None, None)
        if seen is not None and ts - seen > idle_us:
            usual, last = 0.0, None
        if flagged or (usual > 0 and rate >= usual * times):
            return (usual, last, ts), (usual, True)
        if last is not None and ts - last < gap_us:
            return (usual, last, ts), (usual, False)
        return (next_baseline(usual, rate), ts, ts), (usual, True)

    carry = list(dict.fromkeys(["src_ip", "ts_us", *_EVIDENCE, *keep]))
    # Packets of one flow and time have the same evidence, so their order does not matter.
    order = ["ts_us", *FLOW_KEY[1:]]
    long = long_keys(packets, ["src_ip"], chunk_rows) if chunk_rows else None
    if long is not None:
        shared_dir(packets.sparkSession)
        ruled = ruled.select(*dict.fromkeys([*carry, *order]), "_ml", "rule_type", "rule_reason", "rule_severity").checkpoint()
    plain = ruled.filter(F.col("rule_type").isNull())
    read = ["ts_us", "packet_rate", "_ml"]
    state = T.StructType([T.StructField("usual", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("last", "seen")]])
    folded = fold(
        plain, ["src_ip"], order, read, _NORMAL_STATE, step, state, (0.0, None, None), slot("ts_us", CHUNK_BLOCK_US),
        chunk_rows or CHUNK_ROWS, [*carry, "_ml"], long,
    )
    adaptive = rules(folded.filter("kept"), thresholds, window_secs, baseline="baseline").drop("kept", "_ml")
    sure = ruled.filter(F.col("rule_type").isNotNull()).withColumn("baseline", F.lit(None).cast("double"))
    both = sure.select(*adaptive.columns).unionByName(adaptive)
    return decide(both).select(*dict.fromkeys([*DETECTION_COLUMNS, "baseline", "packet_rate", *keep]))


def limit_normals(
    detections: DataFrame, gap_ms: int = NORMAL_GAP_MS, order: list[str] = ("ts_us",), chunk_rows: int | None = CHUNK_ROWS
) -> DataFrame:
    """Keep a NORMAL row only if `gap_ms` passed since its source's last kept one; keep all others.

    Alerts bypass the fold, and a source's NORMAL rows stay below `dos_rate` per second (above it
    the volumetric rule makes them alerts), so a flood never reaches the fold's task; the rows
    stream through it with one time as state. `order`, which starts with ts_us, settles which of
    several rows of one source and time is kept. The rows of each source are counted first; one with more NORMAL
    rows than `chunk_rows` is folded in parallel chunks (see `fold_split`). With None, nothing is counted or split.
    """
    gap_us = gap_ms * 1000

    def step(state, ts):
        last, = state or (None,)
        if last is not None and ts - last < gap_us:
            return (last,), (False,)
        return (ts,), (True,)

    quiet = detections.filter(F.col("severity") == NORMAL)
    long = long_keys(quiet, ["src_ip"], chunk_rows) if chunk_rows else None
    short = quiet if long is None else join_keys(quiet, long, ["src_ip"], "left_anti")
    kept = keep_spaced(short, ["src_ip"], list(order), gap_us)
    if long is not None:
        state, flag = T.StructType([T.StructField("last", T.LongType())]), T.StructType([T.StructField("kept", T.BooleanType())])
        rest = join_keys(quiet, long, ["src_ip"], "left_semi")
        split = fold_split(rest, ["src_ip"], slot("ts_us", CHUNK_BLOCK_US), list(order), ["ts_us"], flag, step, state, (None,), chunk_rows)
        kept = kept.unionByName(split.filter("kept").drop("kept"))
    return detections.filter(F.col("severity") != NORMAL).unionByName(kept)
