"""Boilerplate lines: those that many sites share.

A line's spread is the number of distinct sites it stands on. Each line hash gathers a HyperLogLog sketch of its
sites; sketches merge by aggregation, before and after the shuffle, so that a line on every page is no
hot key. An estimate far from the threshold decides; lines near it get an exact distinct count. The lines
that reach the threshold are then taken out of every text.

Lines are compared without outer white space; a line without a word is kept as it is. Defined cases: null
and empty texts stay as they are; a null site is none; null ids and equal rows are each returned;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import stored

WHITE = " \t\n\x0b\x0c\r"
LOG_REGISTERS = 12  # standard error 1.6 %


def _hashes(value: Column) -> list[Column]:
    """128 bits in two longs."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def boilerplate(lines: DataFrame, sites: int, margin: float = 0.2) -> DataFrame:
    """(h1, h2) of the line hashes among (h1, h2, site) that stand on `sites` sites or more.

    `margin` is the share of the threshold on either side within which sites are counted exactly;
    it must exceed several standard errors of the sketch.
    """
    merged = stored(lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch")).select(
        "h1", "h2", F.hll_sketch_estimate("sketch").alias("spread"),
    ).filter(F.col("spread") >= sites * (1 - margin)))
    sure = merged.filter(F.col("spread") > sites * (1 + margin)).select("h1", "h2")
    near = merged.filter(F.col("spread") <= sites * (1 + margin)).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    counted = lines.join(near, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left_semi").distinct()
    exact = counted.groupBy("h1", "h2").agg(F.count("site").alias("n")).filter(F.col("n") >= sites).select("h1", "h2")
    return sure.union(exact)


def drop_boilerplate(docs: DataFrame, sites: int = 8, site: str = "source", margin: float = 0.2) -> DataFrame:
    """(doc_id, n_lines, n_removed, text), one row per row of `docs`: the text without lines that `sites` sites share."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(site).cast("string").alias("site"))
    # equal rows have one key and one answer
    keyed = texts.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "doc_id", "text"))
    each = keyed.select("k1", "k2", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = each.withColumn("line", F.btrim("line", F.lit(WHITE))).filter("line <> ''").select("k1", "k2", "site", "place", *_hashes(F.col("line")))
    shared = stored(boilerplate(lines.select("h1", "h2", "site"), sites, margin)).select(F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    hits = lines.join(shared, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left_semi")
    # bounded by the lines of one text
    cut = hits.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.sort_array(F.collect_set("place")).alias("places"))
    joined = keyed.drop("site").join(cut, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    # the kept lines lie between one removed place and the next
    split = joined.select("doc_id", "text", "places", F.split("text", "\n").alias("lines"))
    between = F.expr("""array_join(flatten(transform(concat(places, array(size(lines))),
        (p, j) -> slice(lines, coalesce(get(places, j - 1), -1) + 2, p - coalesce(get(places, j - 1), -1) - 1))), '\n')""")
    return split.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("bigint").alias("n_removed"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(between).alias("text"),
    )
