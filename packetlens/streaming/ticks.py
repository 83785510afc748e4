"""Per-second throughput, alert counts and the whole system table of streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ratecap import DEFAULT_CAP
from ..plans.ticks import wanted
from ..schemas import ATTACK, FLOW_KEY, SECOND_US, SUSPICIOUS
from .detect import timed
from .flows import SOURCE_PARTS


def _per_second(stream: DataFrame, watermark_secs: int):
    return timed(stream, watermark_secs).groupBy(F.window("ts", "1 second").alias("window"))


def stream_ticks(packets: DataFrame, watermark_secs: int = 10) -> DataFrame:
    """Packets and bytes per second."""
    return _per_second(packets, watermark_secs).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("packet_size").cast("bigint")).alias("bytes")
    ).select(F.unix_seconds("window.start").alias("sec"), "packets", "bytes")


def _alerts(detections: DataFrame, watermark_secs: int) -> DataFrame:
    return _per_second(detections, watermark_secs).agg(
        F.count_if(F.col("severity") == SUSPICIOUS).alias("suspicious"),
        F.count_if(F.col("severity") == ATTACK).alias("attack"),
    )


def stream_alert_ticks(detections: DataFrame, watermark_secs: int = 10) -> DataFrame:
    """Suspicious and attack verdicts per second."""
    return _alerts(detections, watermark_secs).select(F.unix_seconds("window.start").alias("sec"), "suspicious", "attack")


def _newest(pairs: np.ndarray, most: int) -> np.ndarray:
    """The newest `most` of (detection time, capture time) rows, in order."""
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))][max(0, len(pairs) - most) :]


def _pairs(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.int64).reshape(-1, 2)


class _NewestOfSecond(StatefulProcessor):
    """Keeps the newest detections of one second (and one of its parts) until the second is over, then sends them on."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "pairs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([r[["detect_us", "ts_us"]].to_numpy(np.int64) for r in rows])
        known = self.state.exists()
        held = _pairs(self.state.get()[0]) if known else new[:0]
        self.state.update((_newest(np.concatenate([held, new]), self.most).tobytes(),))
        if not known:
            self.handle.registerTimer((int(key[0]) + 1) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sec = int(key[0])
        at = pd.Timestamp(sec * SECOND_US + SECOND_US - 1, unit="us")
        yield pd.DataFrame({"at": [at], "sec": [sec], "newest": [self.state.get()[0]]})
        self.state.clear()

    def close(self) -> None:
        pass


#: A flow and a second in which it sent, as longs; a null of the key is a number that no column holds.
_FLOW_SECOND = [*FLOW_KEY, "sec"]
_NO_VALUE = np.iinfo(np.int64).min


def _sorted_changes(rows: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows by their columns from the first on, and whether each differs from the next one in the first `columns`."""
    rows = rows[np.lexsort(rows.T[::-1])]
    last = np.ones(len(rows), dtype=bool)
    last[:-1] = (rows[1:, :columns] != rows[:-1, :columns]).any(axis=1)
    return rows, last


def _flow_seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest packet of each flow and second of a batch, so that a flow that floods sends few rows on."""
    for batch in batches:
        rows, last = _sorted_changes(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]), len(_FLOW_SECOND))
        rows = rows[last]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=batch.schema.names)


class _ActiveFlows(StatefulProcessor):
    """Counts the flows of a part that are active in each second, once the watermark has passed it.

    Holds a row for each flow and second from which the flow is still active in an open second. A row counts until the flow's
    next one, or until the flow has been idle. The part's one timer is set to the end of the first open second with a flow.
    """

    def __init__(self, idle_secs: int):
        self.idle_secs = idle_secs

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flows", "open long, due long, flows binary")

    def _held(self) -> tuple[int, int | None, np.ndarray]:
        """The first second not given yet, the time of the timer, and the rows."""
        first, due, flows = self.state.get() if self.state.exists() else (_NO_VALUE, None, b"")
        return first, due, np.frombuffer(flows, np.int64).reshape(-1, len(_FLOW_SECOND))

    def _hold(self, first: int, due: int | None, flows: np.ndarray) -> None:
        wake = (max(int(flows[:, -1].min()), first) + 1) * 1000 if len(flows) else None
        if due is not None and due != wake:
            self.handle.deleteTimer(due)
        if wake is not None and due != wake:
            self.handle.registerTimer(wake)
        self.state.update((first, wake, flows.tobytes()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, due, held = self._held()
        new = [frame[_FLOW_SECOND].to_numpy(np.int64) for frame in rows]
        flows, last = _sorted_changes(np.concatenate([held, *new]), len(_FLOW_SECOND))
        flows = flows[last]
        # a late packet counts in the seconds that are still open
        self._hold(first, due, flows[flows[:, -1] + self.idle_secs > first])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        until = now_ms // 1000  # the first second that is still open
        first, _, flows = self._held()
        starts = flows[:, -1]
        ends = starts + self.idle_secs
        same = (flows[1:, :-1] == flows[:-1, :-1]).all(axis=1)
        ends[:-1] = np.where(same, np.minimum(ends[:-1], starts[1:]), ends[:-1])
        low, high = np.maximum(starts, first), np.minimum(ends, until)
        counts = low < high
        if counts.any():
            base = int(low[counts].min())
            change = np.zeros(until - base + 1, np.int64)
            np.add.at(change, low[counts] - base, 1)
            np.add.at(change, high[counts] - base, -1)
            active = np.cumsum(change)
            found = np.flatnonzero(active)
            sec = base + found
            # a second that only late packets reach may lie further back than the rows that the next state takes
            at = np.maximum((sec + 1) * SECOND_US - 1, now_ms * 1000)
            yield pd.DataFrame({"at": at.astype("datetime64[us]"), "sec": sec, "active": active[found]})
        kept = flows[ends > until]
        if len(kept):
            self._hold(max(first, until), None, kept)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def _active_flows(packets: DataFrame, watermark_secs: int, idle_secs: int, parts: int) -> DataFrame:
    """Per part of the flows and second (at, sec): how many flows had a packet in the `idle_secs` that end with it.

    A packet is late when all of these seconds are over, so the event time of this branch is that of the end of them.
    """
    rows = timed(packets, watermark_secs)
    late = next(f.metadata for f in rows.schema.fields if "spark.watermarkDelayMs" in f.metadata)
    keys = [F.coalesce(F.col(c).cast("long"), F.lit(_NO_VALUE)).alias(c) for c in FLOW_KEY]
    rows = rows.select(*keys, F.unix_seconds("ts").alias("sec"), F.unix_micros("ts").alias("us")).filter("us is not null")
    rows = rows.mapInArrow(_flow_seconds, ", ".join(f"{c} long" for c in rows.columns))
    over = F.timestamp_micros(F.col("us") + idle_secs * SECOND_US).alias("over", metadata=late)
    rows = rows.select(*_FLOW_SECOND, over)
    return rows.withColumn("part", F.pmod(F.xxhash64(*FLOW_KEY), F.lit(parts))).groupBy("part").transformWithStateInPandas(
        statefulProcessor=_ActiveFlows(idle_secs), outputStructType="at timestamp, sec long, active long", outputMode="Append",
        timeMode="EventTime", eventTimeColumnName="at")


_RUNNING = ["total_packets", "dropped_packets", "alerts_suspicious", "alerts_attack", "active_flows"]
_TICK = "sec long, packets_per_sec double, bytes_per_sec double, " + ", ".join(f"{c} long" for c in _RUNNING) + ", latency_avg_ns double, latency_p99_ns double"
_COUNTS = ["packets", "bytes", "wanted", "suspicious", "attack", "active"]


class _Seconds(StatefulProcessor):
    """Adds up seconds in order, once the watermark has passed them. Holds the totals, the seconds still open and the newest detections."""

    def __init__(self, cap: int, last_n: int, q: float, latencies: bool):
        self.cap, self.last_n, self.q, self.latencies = cap, last_n, q, latencies

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "sec long", "counts array<long>, newest binary")
        self.total = handle.getValueState("total", "sec long, sums array<long>, newest binary, avg double, p99 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True)
        if self.total.exists():  # seconds already given stay as they are
            batch = batch[batch["sec"] > self.total.get()[0]]
        for sec, part in batch.groupby("sec"):
            held = (int(sec),)
            counts, newest = self.open.getValue(held) if self.open.containsKey(held) else ([0] * len(_COUNTS), b"")
            if not any(counts) and not newest:
                self.handle.registerTimer((int(sec) + 1) * 1000)
            counts = [int(c + part[n].sum()) for c, n in zip(counts, _COUNTS, strict=True)]
            found = np.concatenate([_pairs(newest), *[_pairs(x) for x in part["newest"] if x is not None and not isinstance(x, float)]])
            self.open.updateValue(held, (counts, _newest(found, self.last_n).tobytes()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // 1000  # the first second that is still open
        due = sorted(k[0] for k in self.open.keys() if k[0] < until)
        if not due:
            return
        last, sums, newest, avg, p99 = self.total.get() if self.total.exists() else (None, [0, 0, 0, 0], b"", None, None)
        sums, out = list(sums), []
        first = next((s for s in due if self.open.getValue((s,))[0][0]), None) if last is None else last + 1
        if first is None:
            return  # no packet yet
        for sec in range(min(due[0], first), until):
            counts = [0] * len(_COUNTS)
            if due and due[0] == sec:
                due.pop(0)
                counts, new = self.open.getValue((sec,))
                self.open.removeKey((sec,))
                if new:
                    newest = _newest(np.concatenate([_pairs(newest), _pairs(new)]), self.last_n).tobytes()
                    avg, p99 = self._latency(_pairs(newest))
            sums[0] += counts[0]
            sums[1] += max(0, counts[2] - self.cap)
            sums[2] += counts[3]
            sums[3] += counts[4]
            if sec >= first:
                out.append((sec, float(counts[0]), float(counts[1]), *sums, counts[5], avg, p99))
        self.total.update((until - 1, sums, newest, avg, p99))
        if out:
            names = [c.split()[0] for c in _TICK.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"latency_avg_ns": "float64", "latency_p99_ns": "float64"})

    def _latency(self, pairs: np.ndarray) -> tuple[float, float]:
        found = np.sort((pairs[:, 0] - pairs[:, 1]) * 1000)
        return float(found.sum() / len(found)), float(found[int(np.ceil(self.q * len(found))) - 1])

    def close(self) -> None:
        pass


def stream_system_ticks(
    packets: DataFrame, detections: DataFrame, latencies: DataFrame | None = None, cap: int = DEFAULT_CAP, idle_secs: int = 9,
    last_n: int = 10_000, q: float = 0.99, watermark_secs: int = 10, parts: int = 8, flow_parts: int = SOURCE_PARTS,
) -> DataFrame:
    """The rows of `system_ticks` over streams, each second once the watermark has passed it, idle ones included.

    A chain of keyed states: packets and verdicts become counts per second; flows are held in `flow_parts`, once for a second in
    which they send, and counted in each second in which they are active (their last packet lies within the `idle_secs` that end
    with it); detections of a second shrink, in `parts`, to its newest `last_n`; one state adds the seconds up in order, a row
    for each of these.
    """
    def stamped(rows: DataFrame, *columns: str) -> DataFrame:
        at = F.window_time("window").alias("at")
        return rows.select(at, *columns).withColumn("sec", F.unix_seconds("at")).select("at", "sec", *columns)

    seen = _per_second(packets, watermark_secs).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("packet_size").cast("bigint")).alias("bytes"), wanted().alias("wanted"))
    rows = stamped(seen, "packets", "bytes", "wanted").unionByName(_active_flows(packets, watermark_secs, idle_secs, flow_parts), allowMissingColumns=True)
    rows = rows.unionByName(stamped(_alerts(detections, watermark_secs), "suspicious", "attack"), allowMissingColumns=True)
    if latencies is not None:
        late = latencies.select("detect_us", "ts_us", F.timestamp_micros("detect_us").alias("ts"))
        late = timed(late, watermark_secs).withColumn("sec", F.expr(f"detect_us div {SECOND_US}"))
        late = late.withColumn("part", F.pmod(F.xxhash64("detect_us", "ts_us"), F.lit(parts)))
        newest = late.groupBy("sec", "part").transformWithStateInPandas(
            statefulProcessor=_NewestOfSecond(last_n), outputStructType="at timestamp, sec long, newest binary", outputMode="Append",
            timeMode="EventTime", eventTimeColumnName="at")
        rows = rows.unionByName(newest, allowMissingColumns=True)
    else:
        rows = rows.withColumn("newest", F.lit(None).cast("binary"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in _COUNTS}).withColumn("all", F.lit(0))
    ticks = rows.groupBy("all").transformWithStateInPandas(
        statefulProcessor=_Seconds(cap, last_n, q, latencies is not None), outputStructType=_TICK, outputMode="Append", timeMode="EventTime")
    totals = ["total_packets", "dropped_packets", "alerts_suspicious", "alerts_attack"]
    late = ["latency_avg_ns", "latency_p99_ns"] if latencies is not None else []
    total = (F.col("alerts_suspicious") + F.col("alerts_attack")).alias("total_alerts")
    return ticks.select("sec", "packets_per_sec", "bytes_per_sec", *totals, total, "active_flows", *late)
