"""Connected components of a link table by alternating stars, in joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import stored


def _smallest(links: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself. A hub's neighbours are folded map-side, never gathered."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of the links (u, v).

    Each round joins every node's larger neighbours, then its smaller ones, to the least of them.
    A round reads the table that the last one wrote. Links with a null end are left out.
    """
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = _smallest(large)
        small = large.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        counts = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if counts == edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first():
            break
        edges = after
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
