"""The table of current flows: newest statistics per flow key, and operations on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FLOW_KEY, SECOND_US
from .spread import slot, take_first


def current_flows(stats: DataFrame) -> DataFrame:
    """Newest row per flow. Ties in time are settled by the remaining columns."""
    rest = [c for c in stats.columns if c not in FLOW_KEY and c != "last_seen"]
    newest = F.max(F.struct("last_seen", *rest)).alias("newest")
    return stats.groupBy(*FLOW_KEY).agg(newest).select(*FLOW_KEY, "newest.*")


def merge_flows(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Upsert newer statistics into a current-flow table."""
    return current_flows(current.unionByName(delta))


def remove_flows(current: DataFrame, keys: DataFrame) -> DataFrame:
    return current.join(keys, FLOW_KEY, "left_anti")


def expire_flows(current: DataFrame, now_us, ttl_secs: int = 30) -> DataFrame:
    """Drop flows not seen for `ttl_secs` before `now_us` (a number or a scalar column)."""
    return current.filter(F.col("last_seen") >= now_us - ttl_secs * SECOND_US)


def bound_flows(current: DataFrame, max_flows: int = 65_536) -> DataFrame:
    """Keep the `max_flows` flows seen last."""
    newest_first = [F.col("last_seen").desc(), *FLOW_KEY]
    return take_first(current, max_flows, -slot("last_seen", SECOND_US), newest_first)


def lookup_flows(current: DataFrame, keys: DataFrame) -> DataFrame:
    return current.join(keys.select(*FLOW_KEY).distinct(), FLOW_KEY)


def contains_flows(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key with `present`: whether the table holds it."""
    held = current.select(*FLOW_KEY, F.lit(True).alias("_held"))
    return keys.select(*FLOW_KEY).distinct().join(held, FLOW_KEY, "left").select(
        *FLOW_KEY, F.col("_held").isNotNull().alias("present")
    )


def active_flow_count(current: DataFrame) -> DataFrame:
    return current.agg(F.count(F.lit(1)).alias("active_flows"))


def filter_flows(current: DataFrame, predicate) -> DataFrame:
    """Flows matching any user predicate over the table's columns."""
    return current.filter(predicate)


def top_flows(current: DataFrame, n: int) -> DataFrame:
    """The `n` flows with the highest packet rate."""
    return current.orderBy(F.col("packet_rate").desc(), *FLOW_KEY).limit(n)


def flow_churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """Inserted, evicted and kept flow counts between two states of the table."""
    old = before.select(*FLOW_KEY, F.lit(True).alias("_old"))
    new = after.select(*FLOW_KEY, F.lit(True).alias("_new"))
    return old.join(new, FLOW_KEY, "full_outer").agg(
        F.count_if(F.col("_old").isNull()).alias("inserted"),
        F.count_if(F.col("_new").isNull()).alias("evicted"),
        F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("kept"),
    )
