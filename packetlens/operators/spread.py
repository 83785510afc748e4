"""Ways to keep ordered work parallel when one key holds a large share of the rows.

Two devices are used throughout:

* `time_blocks`: a key's timeline is cut into blocks. Rows that a later block still needs are
  copied into it, so each (key, block) can be worked on alone and the result stays exact.
* `positions`: exact ranks without sorting a whole group in one task. Rows are counted per
  (key, block) with map-side combine, the small count table gives each block its offset,
  and only the rows of one block are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slot(column: str, width: int) -> Column:
    """Integer slot of a long column."""
    return F.expr(f"{column} div {int(width)}")


#: Rows of one task where a step sorts rows in memory.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame, rows_each: int = TASK_ROWS) -> int | None:
    """How many tasks the rows of `df` ask for, so that one task's share does not grow with the table; at least one a core.
    None if one task can take them all: then the session decides. Counts the rows: runs a job.
    """
    rows = df.count()
    return None if rows <= rows_each else max(-(-rows // rows_each), df.sparkSession.sparkContext.defaultParallelism)


def deal(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to as many tasks as `tasks_for` found."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def time_blocks(df: DataFrame, block_us: int, halo_us: int, ts: str = "ts_us") -> DataFrame:
    """Add `_block` and `_owned`; rows in the last `halo_us` of a block also go to the next one.

    Only rows with `_owned` belong to the block's result; the copies are its history.
    """
    if block_us < halo_us:
        raise ValueError("a block must be at least as long as the halo")
    home = slot(ts, block_us)
    late = F.col(ts) - home * block_us >= block_us - halo_us
    homes = F.when(late, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_block", F.explode(homes)).withColumn("_owned", F.col("_block") == home)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys`, null equal to null; the keys are those of `left`. `right` has no other column of `left`."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def positions(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list,
    name: str = "position",
    total: str | None = None,
    upto=None,
    copies: str | None = None,
) -> DataFrame:
    """Exact 1-based rank of each row within `keys`, ordered by `order`.

    `block` must rise with `order` (a coarse prefix of it). With `upto`, blocks that start beyond
    that rank are dropped before the sort. `total` adds the row count of the key. A row that
    stands for `copies` equal rows takes as many ranks and gets the first of them. A null key is a
    key like any other.
    """
    weight = F.col(copies) if copies else F.lit(1).cast("bigint")
    sized = df.groupBy(*keys, block.alias("_block")).agg(F.sum(weight).alias("_n"))
    running = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sized.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(W.partitionBy(*keys)))
    if upto is not None:
        offsets = offsets.filter(F.col("_before") < upto)
    inner = W.partitionBy(*keys, "_block").orderBy(*order)
    if copies:
        rank = F.coalesce(F.sum(copies).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    else:
        rank = F.row_number().over(inner)
    placed = join_keys(df.withColumn("_block", block), offsets.drop("_n"), [*keys, "_block"])
    return placed.withColumn(name, F.col("_before") + rank).drop("_block", "_before")


def take_first(df: DataFrame, n, block: Column, order: list, copies: str | None = None) -> DataFrame:
    """Exactly the first `n` rows by `order`, without one task merging every partition's top n.

    `n` may be a number or a scalar column. The counts per block give the last block that holds a row of the result.
    Rows of earlier blocks are in it as they are; only those of that block are shuffled and sorted.
    With `copies`, a row that reaches beyond rank n keeps only the copies up to it.
    """
    weight = F.col(copies) if copies else F.lit(1).cast("bigint")
    sized = df.groupBy(block.alias("_block")).agg(F.sum(weight).alias("_n"))
    running = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sized.withColumns({
        "_before": F.coalesce(F.sum("_n").over(running), F.lit(0)),
        # rows without a block are in no result
        "_ahead": F.coalesce(F.sum(F.when(F.col("_block").isNotNull(), F.col("_n"))).over(running), F.lit(0)),
    })
    edge = starts.filter(F.col("_before") < n).agg(F.max(F.struct("_block", "_ahead"))).scalar()
    last = df.withColumn("_edge", block).filter(F.col("_edge") == edge["_block"])
    over = W.partitionBy("_edge").orderBy(*order)
    room = n - edge["_ahead"]
    if copies:
        rank = F.coalesce(F.sum(copies).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    else:
        rank = F.row_number().over(over)
    last = last.withColumn("_rank", rank).filter(F.col("_rank") <= room)
    if copies:
        last = last.withColumn(copies, F.least(F.col(copies), room - F.col("_rank") + 1))
    return df.filter(block < edge["_block"]).unionByName(last.drop("_edge", "_rank"))


COPIES = "_copies"


def fold_copies(df: DataFrame) -> DataFrame:
    """Equal rows as one row with a count (combined map-side), so that no group of copies has to be
    ordered row by row.
    """
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def unfold_copies(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The inverse of `fold_copies`; large counts are cut into parts that are spread over tasks."""
    rest = [c for c in df.columns if c != COPIES]
    parts = F.sequence(F.lit(0).cast("bigint"), F.expr(f"({COPIES} - 1) div {most}"))
    cut = df.withColumn("_part", F.explode(parts)).repartition("_part", *rest)
    size = F.least(F.lit(most), F.col(COPIES) - F.col("_part") * most).cast("int")
    return cut.withColumn("_one", F.explode(F.array_repeat(F.lit(True), size))).select(*rest)


def content_key(columns: list[str], seed: int) -> Column:
    """A reproducible pseudo-random order key of a row: md5 over its text and a seed."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary"))


def key_block(key: Column) -> Column:
    """Coarse prefix of a `content_key`: at most 16^4 evenly filled blocks."""
    return F.substring(key, 1, 4)
