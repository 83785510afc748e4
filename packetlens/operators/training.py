"""Preparing labelled flow data for the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import CONN_BOUNDS, RATE_BOUNDS, SIZE_BOUNDS, SYN_BOUNDS, bin_port, clip, normalise_label
from .spread import COPIES, content_key, fold_copies, join_keys, key_block, take_first, unfold_copies

# Columns of the labelled flow files, most with a leading space in their header.
FLOW_COLUMNS = {
    "packet_rate": " Flow Packets/s",
    "syn_count": " SYN Flag Count",
    "avg_packet_size": " Average Packet Size",
    "conn_count": " Total Fwd Packets",
    "dst_port": " Destination Port",
    "label": " Label",
}
NUMERIC = [c for c in FLOW_COLUMNS if c != "label"]
NORMAL_CAP = 500_000


def clean_flow_rows(df: DataFrame) -> DataFrame:
    """Infinite numbers become null; rows with a null or NaN number are dropped."""
    for name in NUMERIC:
        c = F.col(name)
        df = df.withColumn(name, F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c))
    return df.dropna(subset=NUMERIC)


def prepare_training(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Labelled flow rows (plain names, see `FLOW_COLUMNS`) -> five features and a class label.

    `keep` names extra columns to carry along, such as a row key for reproducible sampling.
    """
    return clean_flow_rows(df).select(
        *keep,
        clip("packet_rate", RATE_BOUNDS).alias("packet_rate"),
        bin_port("dst_port").alias("unique_ports"),
        clip("syn_count", SYN_BOUNDS).alias("syn_count"),
        clip("avg_packet_size", SIZE_BOUNDS).alias("avg_packet_size"),
        clip("conn_count", CONN_BOUNDS).alias("conn_count"),
        normalise_label("label").alias("label"),
    )


def label_counts(df: DataFrame, by_file: bool = False) -> DataFrame:
    keys = [F.input_file_name().alias("file")] if by_file else []
    return df.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def _keyed(df: DataFrame, key: list[str] | None, seed: int) -> tuple[DataFrame, list[str], str | None]:
    """Rows with a `_key`. Without columns that identify a row its whole content is the key, and
    equal rows travel as one with a count: a mass of copies never lands in one task.
    """
    if key:
        return df.withColumn("_key", content_key(key, seed)), key, None
    return fold_copies(df).withColumn("_key", content_key(df.columns, seed)), df.columns, COPIES


def cap_rows(df: DataFrame, n=NORMAL_CAP, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """A reproducible sample of at most `n` rows: those with the lowest content keys."""
    keyed, order, copies = _keyed(df, key, seed)
    first = take_first(keyed, n, key_block(F.col("_key")), ["_key", *order], copies).drop("_key")
    return unfold_copies(first) if copies else first


def rebalance(df: DataFrame, ratio: int = 3, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """All attack rows, and normal rows up to `ratio` times as many. Rows without a label are not normal and stay."""
    attacks = df.filter(~F.col("label").eqNullSafe("Normal"))
    room = attacks.agg((F.count(F.lit(1)) * ratio).alias("n")).scalar()
    normals = cap_rows(df.filter(F.col("label") == "Normal"), room, key, seed)
    return normals.unionByName(attacks)


def stratified_split(
    df: DataFrame, label: str = "label", test: float = 0.2, key: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """Add `is_test`: the first ceil(test * n) rows of every label in content-key order.

    Counts per (label, key prefix) tell the prefix in which a label's test rows end. Rows of other prefixes are on one side
    as they are; only those of that prefix are shuffled and ranked. The labels are few.
    """
    keyed, order, copies = _keyed(df, key, seed)
    weight = F.col(copies) if copies else F.lit(1).cast("bigint")
    placed = keyed.withColumn("_block", key_block(F.col("_key")))
    sized = placed.groupBy(label, "_block").agg(F.sum(weight).alias("_n"))
    running = W.partitionBy(label).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sized.withColumns({
        "_before": F.coalesce(F.sum("_n").over(running), F.lit(0)), "_tested": F.ceil(F.sum("_n").over(W.partitionBy(label)) * test),
    })
    edges = starts.filter(F.col("_before") < F.col("_tested")).groupBy(label).agg(
        F.max(F.struct("_block", "_before", "_tested")).alias("_edge"))
    sides = join_keys(placed, F.broadcast(edges), [label], "left")
    at_edge = F.col("_block").eqNullSafe(F.col("_edge._block"))
    count = F.col(copies) if copies else F.lit(1).cast("bigint")
    clear = sides.filter(~at_edge).withColumn("_within", F.when(F.col("_block") < F.col("_edge._block"), count).otherwise(0))
    before = F.coalesce(F.sum(weight).over(W.partitionBy(label).orderBy("_key", *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.col("_edge._tested") - F.col("_edge._before") - before
    ranked = sides.filter(at_edge).withColumn("_within", F.greatest(F.lit(0), F.least(count, room)))
    split = clear.unionByName(ranked)
    if not copies:
        return split.select(*df.columns, (F.col("_within") > 0).alias("is_test"))
    parts = F.array(
        F.struct(F.lit(True).alias("is_test"), F.col("_within").alias("n")),
        F.struct(F.lit(False).alias("is_test"), (F.col(COPIES) - F.col("_within")).alias("n")),
    )
    split = split.withColumn("_side", F.explode(parts)).filter("_side.n > 0")
    return unfold_copies(split.select(*df.columns, "_side.is_test", F.col("_side.n").alias(COPIES)))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class). One read; the window holds a row per class.

    The totals are no scalar subquery: Catalyst cannot canonicalise one with a join below an alias inside another subquery.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()
    rows, classes = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    return sizes.select(label, "n", (rows / (classes * F.col("n"))).alias("weight"))


def add_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight` to every row. The few classes come in as one map, so no row is shuffled."""
    entries = F.collect_list(F.struct(label, "weight"))
    table = class_weights(df, label).agg(F.map_from_entries(entries)).scalar()
    return df.withColumn("weight", F.element_at(table, F.col(label)))
