"""Sliding statistics, windows and sessions over a packet stream.

Streams carry the packet columns plus `ts` TIMESTAMP. `watermark` is how late a packet may come;
later ones are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.net import is_syn
from ..operators.spread import time_blocks
from ..schemas import FLOW_KEY, SECOND_US

_PACKET = "src_ip long, dst_ip long, src_port int, dst_port int, protocol int, packet_size int, tcp_flags int, ts_us long"
_STATS = _PACKET + (
    ", ts timestamp, src_total_packets long, syn_count long, src_unique_dst_ports long, packet_count long, byte_count long"
)
# The columns of a packet in memory, as longs; later windows need those up to KEPT.
_COLUMNS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_size", "syn", "ts_us", "tcp_flags", "owned"]
_SRC_IP, _DST_IP, _SRC_PORT, _PORT, _PROTOCOL, _SIZE, _SYN, _TS, _FLAGS, _OWNED = range(len(_COLUMNS))
_KEPT = _TS + 1
_NULL = -1  # of addresses, ports, sizes and flags, which are never negative
_PART = 1 << 16  # packets of one entry of the state
#: Parts that sources are dealt to. A call of a processor costs milliseconds, so it works on all sources of a part at once.
SOURCE_PARTS = 1024


def _changes(rows: np.ndarray, columns: list[int]) -> np.ndarray:
    """Whether each row differs from the one before in any of `columns`; the first one does."""
    changed = np.ones(len(rows), dtype=bool)
    changed[1:] = (rows[1:, columns] != rows[:-1, columns]).any(axis=1)
    return changed


def window_sums(rows: np.ndarray, wanted: np.ndarray, window_us: int) -> dict[str, np.ndarray]:
    """Totals over [t - window, t] for the `wanted` rows of the history `rows`, which is sorted by source and time."""
    ts = rows[:, _TS]
    # Sorted axes for all sources and all flows: number of the source or flow, then time since the start of the history.
    base = ts.min()
    span = int(ts.max() - base) + window_us + 2

    def between(times, low, high, values=None):
        first, last = np.searchsorted(times, low, "left"), np.searchsorted(times, high, "right")
        if values is None:
            return last - first
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[last] - sums[first]

    source = np.cumsum(_changes(rows, [_SRC_IP])) - 1
    of_source = source * span + (ts - base)
    at = of_source[wanted]
    since = np.maximum(at - window_us, source[wanted] * span)

    by_port = np.lexsort((ts, rows[:, _PORT], rows[:, _SRC_IP]))
    near = ~_changes(rows[by_port], [_SRC_IP, _PORT])
    near[1:] &= np.diff(ts[by_port]) <= window_us
    opens = np.sort(of_source[by_port[~near]])
    # a source's ports have all left before the axis reaches the next source
    closes = np.sort(of_source[by_port[~np.r_[near[1:], False]]]) + window_us + 1

    flow_columns = [_SRC_IP, _DST_IP, _SRC_PORT, _PORT, _PROTOCOL]
    by_flow = np.lexsort((ts, *[rows[:, c] for c in flow_columns]))
    number = np.cumsum(_changes(rows[by_flow], flow_columns)) - 1
    flow = np.empty(len(rows), np.int64)
    flow[by_flow] = number
    axis = number * span + (ts[by_flow] - base)
    high = flow[wanted] * span + (ts[wanted] - base)
    low = np.maximum(high - window_us, flow[wanted] * span)
    return {
        "src_total_packets": between(of_source, since, at),
        "syn_count": between(of_source, since, at, np.maximum(rows[:, _SYN], 0)),
        "src_unique_dst_ports": np.searchsorted(opens, at, "right") - np.searchsorted(closes, at, "right"),
        "packet_count": between(axis, low, high),
        "byte_count": between(axis, low, high, np.maximum(rows[by_flow, _SIZE], 0)),
    }


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    """The packets of a frame as rows of longs."""
    out = np.empty((len(frame), len(_COLUMNS)), np.int64)
    for i, c in enumerate(_COLUMNS):
        column = frame[c]
        out[:, i] = column.fillna(_NULL) if column.isna().any() else column
    return out


class _Sliding(StatefulProcessor):
    """Keeps the packets later windows of one (part of the sources, block) can still reach.

    Each micro-batch adds its own packets as entries and drops the entries that have become too old, so it writes in
    proportion to what is new. Frames become compact arrays as they come.
    """

    def __init__(self, window_us: int, late_us: int, block_us: int):
        self.window_us, self.late_us, self.block_us = window_us, late_us, block_us

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getMapState("recent", "entry long", "packets binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([_matrix(frame) for frame in rows])
        held = {k[0]: np.frombuffer(v[0], np.int64).reshape(-1, _KEPT) for k, v in self.recent.iterator()}
        history = np.concatenate([*held.values(), new[:, :_KEPT]])
        order = np.lexsort((history[:, _TS], history[:, _SRC_IP]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        history = history[order]
        owned = new[:, _OWNED] == 1
        if owned.any():
            out = new[owned]
            sums = window_sums(history, place[len(history) - len(new) :][owned], self.window_us)
            yield self._rows(out, sums)
        # each source's packets go by its own newest one
        starts = _changes(history, [_SRC_IP])
        newest = history[np.r_[starts[1:], True], _TS][np.cumsum(starts) - 1]
        reached = (history[:, _TS] >= newest - self.window_us - self.late_us)[place]
        seen = 0
        for entry, packets in held.items():
            if not reached[seen : seen + len(packets)].any():
                self.recent.removeKey((entry,))
            seen += len(packets)
        kept = new[reached[seen:], :_KEPT]
        kept = kept[np.argsort(kept[:, _TS], kind="stable")]
        first = max(held, default=-1) + 1
        for i in range(0, len(kept), _PART):
            self.recent.updateValue((first + i // _PART,), (kept[i : i + _PART].tobytes(),))
        # The block needs no state once the watermark has passed its end.
        self.handle.registerTimer((int(key[1]) + 1) * self.block_us // 1000)

    def _rows(self, packets: np.ndarray, sums: dict[str, np.ndarray]) -> pd.DataFrame:
        columns = {}
        for name in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_size", "tcp_flags", "ts_us"):
            columns[name] = packets[:, _COLUMNS.index(name)]
        columns["ts"] = columns["ts_us"].astype("datetime64[us]")
        out = pd.DataFrame(columns | sums, copy=False)
        nulls = [c for c in columns if c not in ("src_ip", "ts_us", "ts") and (columns[c] == _NULL).any()]
        return out.assign(**{c: out[c].astype("Int64").mask(out[c] == _NULL) for c in nulls}) if nulls else out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def no_null_source(stream: DataFrame) -> DataFrame:
    """A null source as a number that is no address: a null key reaches a stateful processor row by row, as unequal keys."""
    return stream.withColumn("src_ip", F.coalesce("src_ip", F.lit(_NULL).cast("bigint")))


def null_source(stream: DataFrame) -> DataFrame:
    """The inverse of `no_null_source`."""
    return stream.withColumn("src_ip", F.nullif("src_ip", F.lit(_NULL).cast("bigint")))


def source_part(parts: int) -> Column:
    """The part of a source without nulls; neighbouring addresses fall into different ones."""
    mixed = F.col("src_ip").bitwiseXOR(F.shiftright("src_ip", 10)).bitwiseXOR(F.shiftright("src_ip", 20))
    return F.pmod(mixed, F.lit(parts))


def stream_flow_stats(
    stream: DataFrame, window_secs: int = 3, watermark_secs: int = 10, block_secs: int = 30, parts: int = SOURCE_PARTS
) -> DataFrame:
    """One row per packet with the exact statistics of `flow_stats`, from keyed state.

    State is keyed by (part of the sources, time block), so a backlog of one busy source is spread
    over tasks and many short-lived sources take few calls. It holds the last window plus the lateness, and is dropped after the block. A late
    packet sees what had arrived by then. Needs the RocksDB state store provider.
    """
    block_us = max(block_secs, window_secs) * SECOND_US
    rows = time_blocks(
        no_null_source(stream.withWatermark("ts", f"{watermark_secs} seconds")).withColumn("syn", is_syn().cast("int")),
        block_us, window_secs * SECOND_US,
    ).withColumnsRenamed({"_block": "block", "_owned": "owned"})
    stats = rows.withColumn("part", source_part(parts)).groupBy("part", "block").transformWithStateInPandas(
        statefulProcessor=_Sliding(window_secs * SECOND_US, watermark_secs * SECOND_US, block_us),
        outputStructType=_STATS,
        outputMode="Append",
        timeMode="EventTime",
    )
    return null_source(stats).withColumns({
        "avg_packet_size": F.col("byte_count") / F.col("packet_count"),
        "unique_dst_ports": F.lit(1).cast("bigint"),
        "connection_attempts": F.col("src_total_packets"),
        "packet_rate": F.col("src_total_packets") / F.lit(float(window_secs)),
        "last_seen": F.col("ts_us"),
    })


def stream_source_windows(
    stream: DataFrame, window: str = "3 seconds", slide: str = "1 second", watermark_secs: int = 10
) -> DataFrame:
    """Hopping windows per source from built-in aggregates alone (map-side combined)."""
    return (
        stream.withWatermark("ts", f"{watermark_secs} seconds")
        .groupBy(F.window("ts", window, slide).alias("window"), "src_ip")
        .agg(
            F.count(F.lit(1)).alias("packets"),
            F.sum(F.col("packet_size").cast("bigint")).alias("bytes"),
            F.sum(is_syn().cast("bigint")).alias("syns"),
        )
        .select(
            F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"),
            "src_ip", "packets", "bytes", "syns",
        )
    )


def stream_flow_sessions(stream: DataFrame, idle_secs: int = 9, watermark_secs: int = 10) -> DataFrame:
    """Active periods of each flow by session windows."""
    # A session window ends one idle time after its last packet; a gap of exactly that is not a break.
    gap = f"{idle_secs * 1000 * 1000 + 1} microseconds"
    return (
        stream.withWatermark("ts", f"{watermark_secs} seconds")
        .groupBy(F.session_window("ts", gap).alias("session"), *FLOW_KEY)
        .agg(
            F.min("ts_us").alias("session_start"), F.max("ts_us").alias("session_end"),
            F.count(F.lit(1)).alias("packets"), F.sum(F.col("packet_size").cast("bigint")).alias("bytes"),
        )
        .drop("session")
    )
