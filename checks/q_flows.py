"""Sliding windows, sessions, the current-flow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators import flowtable as ft
from packetlens.operators.flows import (
    flow_first_seen, flow_sessions, flow_stats, flow_window, source_sessions, source_window,
)
from packetlens.schemas import FLOW_KEY

from .inputs import packets
from .registry import check
from .sql import BASE, FLOW, query

_SOURCE = f"SELECT {BASE}, src_total_packets, syn_count, src_unique_dst_ports FROM stats"
_FLOW = f"SELECT {BASE}, packet_count, byte_count, avg_packet_size, unique_dst_ports FROM stats"


@check(query(f"SELECT {FLOW}, count(*) AS packets FROM packets GROUP BY {FLOW}", "packets"))
def flow_keys(spark, sf):
    return packets(spark, sf).groupBy(*FLOW_KEY).agg(F.count(F.lit(1)).alias("packets"))


@check(query(_FLOW, "stats"))
def flow_windows(spark, sf):
    return flow_window(packets(spark, sf))


@check(query(_SOURCE, "stats"))
def source_windows(spark, sf):
    return source_window(packets(spark, sf))


@check(query(_SOURCE, "stats"))
def source_windows_range(spark, sf):
    return source_window(packets(spark, sf), method="range")


@check(query("SELECT * FROM stats", "stats"))
def flow_statistics(spark, sf):
    return flow_stats(packets(spark, sf))


@check(query("SELECT * FROM stats", "stats"))
def flow_statistics_range(spark, sf):
    return flow_stats(packets(spark, sf), method="range")


@check(query("SELECT * FROM stats", "stats"))
def flow_statistics_slots(spark, sf):
    """Sources with over 1,000 packets in a block are worked on in slots of 100 ms."""
    return flow_stats(packets(spark, sf), most_rows=1000)


def _islands(keys: str, idle: int = 9) -> dict[str, str]:
    return {
        "gaps": f"SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {keys} ORDER BY ts_us) <= {idle * 1000000} THEN 0 ELSE 1 END AS fresh FROM packets",
        "islands": f"SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS island FROM gaps",
    }


def _session_sql(keys: str) -> str:
    return query(
        f"""SELECT {keys}, min(ts_us) AS session_start, max(ts_us) AS session_end, count(*) AS packets,
        CAST(sum(packet_size) AS BIGINT) AS bytes FROM islands GROUP BY {keys}, island""",
        "packets", **_islands(keys),
    )


@check(query(
    f"SELECT {BASE}, min(ts_us) OVER (PARTITION BY {FLOW}, island) AS first_seen FROM islands", "packets", **_islands(FLOW)
))
def flow_first_seen_times(spark, sf):
    return flow_first_seen(packets(spark, sf))


@check(_session_sql(FLOW))
def flow_session_table(spark, sf):
    return flow_sessions(packets(spark, sf))


@check(_session_sql("src_ip"))
def source_session_table(spark, sf):
    return source_sessions(packets(spark, sf))


_CURRENT = [*FLOW_KEY, "last_seen", "src_total_packets", "packet_count", "byte_count", "packet_rate"]


def _stats(spark, sf):
    return flow_stats(packets(spark, sf)).select(*_CURRENT)


def _current(spark, sf):
    return ft.current_flows(_stats(spark, sf))


@check(query("SELECT * FROM current", "current"))
def current_flow_table(spark, sf):
    return _current(spark, sf)


@check(query("SELECT * FROM current", "current"))
def merged_flow_table(spark, sf):
    stats = _stats(spark, sf)
    middle = 1704067200000000 + 30_000_000
    old = ft.current_flows(stats.filter(F.col("last_seen") < middle))
    return ft.merge_flows(old, stats.filter(F.col("last_seen") >= middle))


@check(query(f"SELECT * FROM current c WHERE NOT EXISTS (SELECT 1 FROM packets p WHERE p.tcp_flags = 18 AND {' AND '.join(f'p.{k} = c.{k}' for k in FLOW_KEY)})", "current"))
def flows_removed(spark, sf):
    answered = packets(spark, sf).filter("tcp_flags = 18").select(*FLOW_KEY).distinct()
    return ft.remove_flows(_current(spark, sf), answered)


@check(query("SELECT * FROM current WHERE last_seen >= (SELECT max(last_seen) FROM current) - 30000000", "current"))
def flows_unexpired(spark, sf):
    now = packets(spark, sf).agg(F.max("ts_us")).scalar()
    return ft.expire_flows(_current(spark, sf), now)


@check(query(f"SELECT * FROM current ORDER BY last_seen DESC, {FLOW} LIMIT 1000", "current"))
def flows_bounded(spark, sf):
    return ft.bound_flows(_current(spark, sf), 1000)


@check(query(f"SELECT c.* FROM current c SEMI JOIN (SELECT {FLOW} FROM packets WHERE tcp_flags = 18) p USING ({FLOW})", "current"))
def flows_looked_up(spark, sf):
    return ft.lookup_flows(_current(spark, sf), packets(spark, sf).filter("tcp_flags = 18"))


_LATE = "last_seen >= (SELECT max(last_seen) FROM current) - 30000000"


@check(query(
    f"SELECT {FLOW}, bool_or(late) AS present FROM (SELECT {FLOW}, {_LATE} AS late FROM current) GROUP BY {FLOW}", "current"
))
def flows_contained(spark, sf):
    current = _current(spark, sf)
    now = packets(spark, sf).agg(F.max("ts_us")).scalar()
    return ft.contains_flows(ft.expire_flows(current, now), packets(spark, sf))


@check(query(f"SELECT count(*) AS active_flows FROM current WHERE {_LATE}", "current"))
def flows_active(spark, sf):
    now = packets(spark, sf).agg(F.max("ts_us")).scalar()
    return ft.active_flow_count(ft.expire_flows(_current(spark, sf), now))


@check(query("SELECT * FROM current WHERE byte_count > 2000 AND protocol = 6", "current"))
def flows_filtered(spark, sf):
    return ft.filter_flows(_current(spark, sf), (F.col("byte_count") > 2000) & (F.col("protocol") == 6))


@check(query(f"SELECT * FROM current ORDER BY packet_rate DESC, {FLOW} LIMIT 20", "current"))
def flows_top(spark, sf):
    return ft.top_flows(_current(spark, sf), 20)


@check(query(
    f"""SELECT count(*) FILTER (o.x IS NULL) AS inserted, count(*) FILTER (n.x IS NULL) AS evicted,
    count(*) FILTER (o.x IS NOT NULL AND n.x IS NOT NULL) AS kept
    FROM (SELECT DISTINCT {FLOW}, 1 AS x FROM packets WHERE ts_us < 1704067230000000) o
    FULL JOIN (SELECT {FLOW}, 1 AS x FROM current WHERE {_LATE}) n USING ({FLOW})""", "current"
))
def flow_table_churn(spark, sf):
    before = packets(spark, sf).filter(F.col("ts_us") < 1704067230000000).select(*FLOW_KEY).distinct()
    now = packets(spark, sf).agg(F.max("ts_us")).scalar()
    return ft.flow_churn(before, ft.expire_flows(_current(spark, sf), now))
