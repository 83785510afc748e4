"""Verdicts and the keyed folds over streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.baseline import next_baseline
from ..operators.features import features
from ..operators.rules import rules
from ..operators.scoring import Scorer, score_heuristic
from ..operators.verdict import decide, ml_flag
from ..operators.sequential import kept_times
from ..plans.detection import IDLE_SECS, NORMAL_GAP_MS
from ..schemas import NORMAL, SECOND_US, RuleThresholds
from .flows import SOURCE_PARTS, no_null_source, null_source, source_part, stream_flow_stats


def stream_detect(
    stream: DataFrame,
    thresholds: RuleThresholds = RuleThresholds(),
    scorer: Scorer = score_heuristic,
    window_secs: int = 3,
    **how,
) -> DataFrame:
    """One verdict per packet: stateful sliding statistics, then the expressions of `detect`."""
    stats = stream_flow_stats(stream, window_secs, **how)
    return decide(rules(scorer(features(stats, window_secs)), thresholds, window_secs))


#: What is kept of a source: the times of its last kept NORMAL row (`_NEVER`: none) and of its last row, and its baseline.
_SOURCE = np.dtype([("src_ip", "<i8"), ("last", "<i8"), ("usual", "<f8"), ("seen", "<i8")])
_NEVER = np.iinfo(np.int64).min


class _Normals(StatefulProcessor):
    """State per part of the sources: a row of `_SOURCE` for each source.

    A part has one timer. It fires when the first of its sources is due, `idle_us` after its row; those that are by then as
    long without a row are forgotten, and the timer is set on to the next source that will be.
    """

    columns = ["ts_us"]

    def __init__(self, gap_us: int, idle_us: int):
        self.gap_us, self.idle_us = gap_us, idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "sources binary")

    def _due_ms(self, seen):
        # a row of the first whole millisecond after the idle time starts anew
        return (seen + self.idle_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True).drop(columns="part")
        batch = batch.sort_values(["src_ip", *self.columns], kind="stable", ignore_index=True)
        known = self.state.exists()
        held = np.frombuffer(self.state.get()[0] if known else b"", _SOURCE)
        sources, starts = np.unique(batch["src_ip"].to_numpy(np.int64), return_index=True)
        now = np.zeros(len(sources), _SOURCE)
        now["src_ip"], now["last"], now["seen"] = sources, _NEVER, _NEVER
        both, here, before = np.intersect1d(sources, held["src_ip"], assume_unique=True, return_indices=True)
        now[here] = held[before]
        fold, kept = self.folder(batch), []
        stops = [*starts[1:].tolist(), len(batch)]
        for i, (start, stop, (_, last, usual, seen)) in enumerate(zip(starts.tolist(), stops, now.tolist(), strict=True)):
            last, usual, seen = fold(start, stop, None if last == _NEVER else last, usual, None if seen == _NEVER else seen, kept)
            now[i] = (sources[i], _NEVER if last is None else last, usual, seen)
        state = np.concatenate([np.delete(held, before), now])
        self.state.update((state[np.argsort(state["src_ip"])].tobytes(),))
        if not known:
            self.handle.registerTimer(int(self._due_ms(state["seen"]).min()))
        yield self.given(batch, np.concatenate(kept) if kept else np.zeros(0, np.int64))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            held = np.frombuffer(self.state.get()[0], _SOURCE)
            held = held[self._due_ms(held["seen"]) > timerValues.getCurrentWatermarkInMs()]
            if len(held):
                self.state.update((held.tobytes(),))
                self.handle.registerTimer(int(self._due_ms(held["seen"]).min()))
            else:
                self.state.clear()
        return iter([])

    def folder(self, batch):
        """A fold of the rows from `start` to `stop`, of one source: adds the places it keeps, returns the source's new state."""
        times = batch["ts_us"].to_numpy()

        def fold(start, stop, last, usual, seen, kept):
            of_source = times[start:stop]
            found = kept_times(of_source, last, self.gap_us)
            kept.append(found + start)
            newest = int(of_source[-1]) if seen is None else max(seen, int(of_source[-1]))
            return (int(of_source[found[-1]]) if len(found) else last), usual, newest

        return fold

    def given(self, batch: pd.DataFrame, kept: np.ndarray) -> pd.DataFrame:
        return batch.iloc[kept]

    def close(self) -> None:
        pass


class _Adaptive(_Normals):
    columns = ["ts_us", "dst_ip", "src_port", "dst_port", "protocol", "packet_size", "tcp_flags"]

    def __init__(self, gap_us: int, idle_us: int, times: float):
        super().__init__(gap_us, idle_us)
        self.times = times

    def folder(self, batch):
        rows = list(zip(*[batch[c].tolist() for c in ("ts_us", "packet_rate", "sure")], strict=True))
        self.baseline = np.zeros(len(rows))

        def fold(start, stop, last, usual, seen, kept):
            keep = []
            for at in range(start, stop):
                ts, rate, sure = rows[at]
                if seen is not None and ts - seen > self.idle_us:
                    last, usual = None, 0.0
                seen = ts if seen is None else max(seen, ts)
                self.baseline[at] = usual
                if sure or (usual > 0 and rate >= usual * self.times):
                    keep.append(at)
                elif last is None or ts - last >= self.gap_us:
                    keep.append(at)
                    last, usual = ts, next_baseline(usual, rate)
            kept.append(np.array(keep, dtype=np.int64))
            return last, usual, seen

        return fold

    def given(self, batch: pd.DataFrame, kept: np.ndarray) -> pd.DataFrame:
        return batch.assign(baseline=self.baseline).iloc[kept]


def timed(stream: DataFrame, watermark_secs: int) -> DataFrame:
    """The stream with a `ts` column under a watermark: the one it has, or one this late."""
    if any("spark.watermarkDelayMs" in f.metadata for f in stream.schema.fields):
        return stream
    stamped = stream if "ts" in stream.columns else stream.withColumn("ts", F.timestamp_micros("ts_us"))
    return stamped.withWatermark("ts", f"{watermark_secs} seconds")


def _per_source(stream: DataFrame, processor: _Normals, extra: str = "") -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + extra
    parted = no_null_source(stream).withColumn("part", source_part(SOURCE_PARTS))
    return null_source(parted.groupBy("part").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    ))


def stream_limit_normals(detections: DataFrame, gap_ms: int = NORMAL_GAP_MS, watermark_secs: int = 10) -> DataFrame:
    """Thin a stream of NORMAL verdicts to one per source and gap. Filter alerts to their own sink:
    they never need to pass through the keyed state.

    A source is forgotten once the watermark has passed its last row by the gap, which changes no result.
    """
    quiet = detections.filter(F.col("severity") == NORMAL)
    held = _per_source(timed(quiet, watermark_secs), _Normals(gap_ms * 1000, gap_ms * 1000))
    return held.select(*detections.columns)


def stream_adaptive(
    scored: DataFrame,
    thresholds: RuleThresholds = RuleThresholds(),
    window_secs: int = 3,
    gap_ms: int = NORMAL_GAP_MS,
    idle_secs: int = IDLE_SECS,
    watermark_secs: int = 10,
) -> DataFrame:
    """The sequential detector over a stream of scored feature rows (a table `stream_flow_stats`
    feeds). Spikes are judged against the source's baseline so far. Packets a stateless rule
    matches, the bulk of any flood, go around the keyed state. A source without a packet in it for more than `idle_secs`
    starts with a new baseline, as in `detect_adaptive`; its state is dropped when the watermark is that far on.
    """
    columns = scored.columns
    ruled = rules(timed(scored, watermark_secs), thresholds, window_secs)
    matched = F.col("rule_type").isNotNull()
    plain = ruled.filter(~matched).drop("rule_type", "rule_reason", "rule_severity").withColumn("sure", ml_flag())
    folded = _per_source(plain, _Adaptive(gap_ms * 1000, idle_secs * SECOND_US, thresholds.spike_multiplier), ", baseline double")
    adaptive = rules(folded, thresholds, window_secs, baseline="baseline").drop("sure")
    certain = ruled.filter(matched).withColumn("baseline", F.lit(None).cast("double"))
    verdicts = decide(certain.unionByName(adaptive))
    return verdicts if "ts" in columns else verdicts.drop("ts")
