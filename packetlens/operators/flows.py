"""Sliding per-flow and per-source statistics, first-seen times and sessions.

A window of `w` seconds at a packet with time t covers [t - w, t], both ends included; packets
with the same time see each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.net import is_syn
from ..schemas import FLOW_KEY, SECOND_US
from .spread import deal, join_keys, slot, tasks_for, time_blocks

_WINDOW_COLUMNS = ["src_total_packets", "syn_count", "src_unique_dst_ports", "packet_count", "byte_count"]


#: Rows of one source in one block beyond which the block is worked on slot by slot, and the length of a slot.
MOST_ROWS, SLOT_US = 1_000_000, 100_000
#: Rows of one source in one block up to which range frames are used.
QUIET_ROWS = 10_000


def _running(*keys: str):
    return W.partitionBy(*keys).orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)


def _sweep(rows: DataFrame, payload: list[str], window_us: int, block_us: int, source: bool, flow: bool, tasks: int | None) -> DataFrame:
    """Each packet enters its windows at t and leaves them just after t + w; running sums of the
    entries and exits are the sliding totals, in time linear in the packets after the sort.

    A port enters when its source did not use it within the w before, and leaves when it is not
    used within the w after: the running sum of those is the distinct count.
    """
    if source:
        # One exchange on (src_ip, block) serves every window below: their keys all contain it.
        rows = deal(rows, tasks, "src_ip", "_block")
        use = W.partitionBy("src_ip", "_block", "dst_port").orderBy("ts_us")
        before, after = F.lag("ts_us").over(use), F.lead("ts_us").over(use)
        rows = rows.withColumns({
            "_opens": F.coalesce(before < F.col("ts_us") - window_us, F.lit(True)).cast("int"),
            "_closes": F.coalesce(after > F.col("ts_us") + window_us, F.lit(True)).cast("int"),
        })
    else:
        rows = deal(rows, tasks, *FLOW_KEY, "_block").withColumns({"_opens": F.lit(0), "_closes": F.lit(0)})

    def event(at, sign, ports, owned):
        return F.struct(at.alias("_at"), F.lit(sign).alias("_sign"), ports.alias("_ports"), owned.alias("_keep"))

    leaves = F.col("ts_us") + (window_us + 1)
    enter = event(F.col("ts_us"), 1, F.col("_opens"), F.col("_owned"))
    leave = event(leaves, -1, -F.col("_closes"), F.lit(False))
    in_block = leaves < (F.col("_block") + 1) * block_us
    both = F.when(in_block, F.array(enter, leave)).otherwise(F.array(enter))
    events = rows.withColumn("_e", F.explode(both)).select(
        *payload, "_block", "_syn", "_e.*"
    )
    sums = {}
    if source:
        over = _running("src_ip", "_block")
        sums["src_total_packets"] = F.sum("_sign").over(over)
        sums["syn_count"] = F.sum(F.col("_sign") * F.col("_syn")).over(over)
        sums["src_unique_dst_ports"] = F.sum("_ports").over(over)
    if flow:
        over = _running(*FLOW_KEY, "_block")
        sums["packet_count"] = F.sum("_sign").over(over)
        sums["byte_count"] = F.sum((F.col("_sign") * F.col("packet_size")).cast("bigint")).over(over)
    return events.withColumns(sums).filter("_keep").select(*payload, *sums)


_DELTAS = ["_n", "_syns", "_ports", "_flow_n", "_flow_bytes"]


def _sweep_slots(rows: DataFrame, payload: list[str], window_us: int, block_us: int, slot_us: int, tasks: int | None) -> DataFrame:
    """`_sweep` in two levels, for sources that send too much for one task to sort a block.

    Entries and exits are summed by slot; a running sum over a block's few slots says what is in the window as
    each slot starts. That enters the slot as one more event, and only the events of one slot are sorted
    together. Ports enter and leave by their first and last use in a slot, as uses within one are never
    further apart than the window.
    """
    slot_us = min(slot_us, window_us)
    none = F.lit(0).cast("bigint")

    def event(at, sign, keep):
        size = (F.lit(sign) * F.col("packet_size")).cast("bigint")
        deltas = [F.lit(sign).cast("bigint"), (F.lit(sign) * F.col("_syn")).cast("bigint"), none, F.lit(sign).cast("bigint"), size]
        return F.struct(at.alias("_at"), keep.alias("_keep"), *[v.alias(n) for n, v in zip(_DELTAS, deltas, strict=True)])

    leaves = F.col("ts_us") + (window_us + 1)
    ends = (F.col("_block") + 1) * block_us
    both = F.when(leaves < ends, F.array(event(F.col("ts_us"), 1, F.col("_owned")), event(leaves, -1, F.lit(False))))
    both = both.otherwise(F.array(event(F.col("ts_us"), 1, F.col("_owned"))))
    moves = rows.withColumn("_e", F.explode(both)).select(*payload, "_block", "_e.*").withColumn("_slot", slot("_at", slot_us))

    uses = rows.groupBy("src_ip", "_block", "dst_port", slot("ts_us", slot_us).alias("_use")).agg(
        F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    by_port = W.partitionBy("src_ip", "_block", "dst_port").orderBy("_use")
    opens = F.coalesce(F.lag("last").over(by_port) < F.col("first") - window_us, F.lit(True))
    closes = F.coalesce(F.lead("first").over(by_port) > F.col("last") + window_us, F.lit(True))
    marks = F.array(
        F.struct(F.col("first").alias("_at"), opens.cast("bigint").alias("_ports")),
        F.struct((F.col("last") + (window_us + 1)).alias("_at"), (-closes.cast("bigint")).alias("_ports")),
    )
    ports = uses.select("src_ip", "_block", marks.alias("m")).select("src_ip", "_block", F.explode("m").alias("m")).select("src_ip", "_block", "m.*")
    ports = ports.filter((F.col("_ports") != 0) & (F.col("_at") < (F.col("_block") + 1) * block_us)).withColumn("_slot", slot("_at", slot_us))

    flow_nets = moves.groupBy(*FLOW_KEY, "_block", "_slot").agg(*[F.sum(c).alias(c) for c in _DELTAS if c != "_ports"])
    by_source = ["src_ip", "_block", "_slot"]
    nets = flow_nets.select(*by_source, "_n", "_syns", none.alias("_ports")).union(ports.select(*by_source, none, none, "_ports"))
    nets = nets.groupBy(*by_source).agg(*[F.sum(c).alias(c) for c in ("_n", "_syns", "_ports")])

    def starts(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        """What the earlier slots of the block leave, as an event at the start of each slot."""
        earlier = W.partitionBy(*keys, "_block").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(c).over(earlier), none).alias(c) for c in columns]
        return table.select(*keys, "_block", "_slot", (F.col("_slot") * slot_us).alias("_at"), *sums)

    extra = starts(flow_nets, FLOW_KEY, ["_flow_n", "_flow_bytes"]).unionByName(
        starts(nets, ["src_ip"], ["_n", "_syns", "_ports"]), allowMissingColumns=True).unionByName(ports, allowMissingColumns=True)
    events = deal(moves.unionByName(extra, allowMissingColumns=True), tasks, *by_source)
    source, flow = _running(*by_source), _running(*FLOW_KEY, "_block", "_slot")
    sums = dict(zip(_WINDOW_COLUMNS, [F.sum(c).over(source if c in _DELTAS[:3] else flow) for c in _DELTAS], strict=True))
    return events.withColumns(sums).filter("_keep").select(*payload, *sums)


def _frames(rows: DataFrame, payload: list[str], window_us: int, source: bool, flow: bool, tasks: int | None) -> DataFrame:
    """The same totals by sliding range frames; re-reads each window, so only for quiet sources."""
    sums = {}
    rows = deal(rows, tasks, *(["src_ip"] if source else FLOW_KEY), "_block")
    if source:
        over = W.partitionBy("src_ip", "_block").orderBy("ts_us").rangeBetween(-window_us, 0)
        sums["src_total_packets"] = F.count(F.lit(1)).over(over)
        sums["syn_count"] = F.sum("_syn").over(over)
        sums["src_unique_dst_ports"] = F.size(F.collect_set("dst_port").over(over)).cast("bigint")
    if flow:
        over = W.partitionBy(*FLOW_KEY, "_block").orderBy("ts_us").rangeBetween(-window_us, 0)
        sums["packet_count"] = F.count(F.lit(1)).over(over)
        sums["byte_count"] = F.sum(F.col("packet_size").cast("bigint")).over(over)
    return rows.withColumns(sums).filter("_owned").select(*payload, *sums)


def _windowed(df, window_secs, method, block_secs, source, flow, most_rows, slot_us, quiet_rows) -> DataFrame:
    """Each (source, block) by the way that fits its counted rows: range frames if asked for and quiet, one sweep, or slots."""
    if method not in ("sweep", "range"):
        raise ValueError("method is sweep or range")
    window_us, block_us = window_secs * SECOND_US, max(block_secs, window_secs) * SECOND_US
    rows = time_blocks(df.withColumn("_syn", is_syn().cast("int")), block_us, window_us)
    key, payload = ["src_ip", "_block"], df.columns
    # a task sorts about as many rows at any size of the table
    tasks = tasks_for(df)
    # a block's own rows; the copies of its history are a window's worth more
    counted = df.groupBy("src_ip", slot("ts_us", block_us).alias("_block")).agg(F.count(F.lit(1)).alias("_rows"))

    def over(limit: int) -> DataFrame:
        # at most one row for each `limit` rows of packets
        return F.broadcast(counted.filter(F.col("_rows") > limit).select(*key))

    columns = [*payload, *(_WINDOW_COLUMNS[:3] if source else []), *(_WINDOW_COLUMNS[3:] if flow else [])]
    heavy = _sweep_slots(join_keys(rows, over(most_rows), key, "left_semi"), payload, window_us, block_us, slot_us, tasks)
    fit = join_keys(rows, over(most_rows), key, "left_anti")
    if method == "sweep":
        light = _sweep(fit, payload, window_us, block_us, source, flow, tasks)
    else:
        busy = over(min(quiet_rows, most_rows))
        light = _sweep(join_keys(fit, busy, key, "left_semi"), payload, window_us, block_us, source, flow, tasks).select(*columns)
        quiet = _frames(join_keys(rows, busy, key, "left_anti"), payload, window_us, source, flow, tasks)
        light = light.union(quiet.select(*columns))
    return light.select(*columns).union(heavy.select(*columns))


def source_window(
    df: DataFrame, window_secs: int = 3, method: str = "sweep", block_secs: int = 30,
    most_rows: int = MOST_ROWS, slot_us: int = SLOT_US, quiet_rows: int = QUIET_ROWS,
) -> DataFrame:
    """Per packet: packets, connection attempts and distinct ports of its source in the window."""
    return _windowed(df, window_secs, method, block_secs, True, False, most_rows, slot_us, quiet_rows)


def flow_window(
    df: DataFrame, window_secs: int = 3, method: str = "sweep", block_secs: int = 30,
    most_rows: int = MOST_ROWS, slot_us: int = SLOT_US, quiet_rows: int = QUIET_ROWS,
) -> DataFrame:
    """Per packet: packets, bytes, mean size and distinct ports of its flow in the window."""
    return _flow_columns(_windowed(df, window_secs, method, block_secs, False, True, most_rows, slot_us, quiet_rows))


def _flow_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "avg_packet_size": F.col("byte_count") / F.col("packet_count"),
        # A flow has one destination port by definition of its key.
        "unique_dst_ports": F.lit(1).cast("bigint"),
    })


def flow_stats(
    df: DataFrame, window_secs: int = 3, method: str = "sweep", block_secs: int = 30,
    most_rows: int = MOST_ROWS, slot_us: int = SLOT_US, quiet_rows: int = QUIET_ROWS,
) -> DataFrame:
    """Per packet: the flow's and its source's statistics in the trailing window.

    Two limits bound the work of one task. A source that sends without pause is split into blocks of `block_secs`
    (plus `window_secs` of copied history each). One with more than `most_rows` packets in a block has
    that block cut into slots of `slot_us`, of which each is a task's work. The packets' sources and times are
    counted first to tell which ones; all are counted for the number of tasks, which runs a job. `method="range"` reads
    frames for sources of up to `quiet_rows` packets a block.
    """
    both = _windowed(df, window_secs, method, block_secs, True, True, most_rows, slot_us, quiet_rows)
    return _flow_columns(both).withColumns({
        "connection_attempts": F.col("src_total_packets"),
        "packet_rate": F.col("src_total_packets") / F.lit(float(window_secs)),
        "last_seen": F.col("ts_us"),
    })


def _activity(df: DataFrame, keys: list[str], idle_us: int) -> DataFrame:
    """Rows per (key, slot of idle length) with the start of the session the slot belongs to.

    Two packets of one slot are less than the idle time apart, so a session can only break
    between slots: a map-side combined count per slot is all that has to be ordered per key.
    """
    slots = df.groupBy(*keys, slot("ts_us", idle_us).alias("_slot")).agg(
        F.min("ts_us").alias("first"),
        F.max("ts_us").alias("last"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.col("packet_size").cast("bigint")).alias("bytes"),
    )
    ordered = W.partitionBy(*keys).orderBy("_slot")
    gap = F.col("first") - F.lag("last").over(ordered)
    opened = F.when(F.coalesce(gap > idle_us, F.lit(True)), F.col("first"))
    return slots.withColumn("opened", opened).withColumn(
        "session_start", F.max("opened").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    )


def _sessions(df: DataFrame, keys: list[str], idle_secs: int) -> DataFrame:
    active = _activity(df, keys, idle_secs * SECOND_US)
    return active.groupBy(*keys, "session_start").agg(
        F.max("last").alias("session_end"),
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
    )


def flow_sessions(df: DataFrame, idle_secs: int = 9) -> DataFrame:
    """Active periods of each flow; a flow idle longer than `idle_secs` starts a new one."""
    return _sessions(df, FLOW_KEY, idle_secs)


def source_sessions(df: DataFrame, idle_secs: int = 9) -> DataFrame:
    """Active periods of each source."""
    return _sessions(df, ["src_ip"], idle_secs)


def flow_first_seen(df: DataFrame, idle_secs: int = 9) -> DataFrame:
    """Add `first_seen`: the start of the flow's current active period."""
    idle_us = idle_secs * SECOND_US
    starts = _activity(df, FLOW_KEY, idle_us).select(*FLOW_KEY, "_slot", F.col("session_start").alias("first_seen"))
    return join_keys(df.withColumn("_slot", slot("ts_us", idle_us)), starts, [*FLOW_KEY, "_slot"]).drop("_slot")
