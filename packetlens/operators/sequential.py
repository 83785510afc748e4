"""Folds whose next state depends on the last one, run key by key in order.

Rows are shuffled by key and sorted by Spark (which spills); the task then streams
Arrow batches and holds one state, never a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .spread import join_keys, positions


def kept_times(times: np.ndarray, last: int | None, gap: int) -> np.ndarray:
    """Places in the sorted `times` of those kept if each kept one is at least `gap` after the one before (`last` before the first).

    One search per kept time, not a step per row.
    """
    kept = []
    at = 0 if last is None else int(np.searchsorted(times, last + gap, "left"))
    while at < len(times):
        kept.append(at)
        at = max(at + 1, int(np.searchsorted(times, times[at] + gap, "left"))) if gap > 0 else at + 1
    return np.array(kept, dtype=np.int64)


def fold_in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    inputs: list[str],
    outputs: T.StructType,
    step,
    carry: list[str] | None = None,
) -> DataFrame:
    """Append `outputs` to every row of `df` (of its columns `carry`, if given).

    `step(state, *inputs) -> (state, outputs)` is called for each row of a key in order; the state
    is None before the first row of a key.
    """
    # Columns that only settle the order stay behind: they need not travel to Python.
    if not keys:
        raise ValueError("a fold over all rows would be one task; split it with fold_split")
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*(carry or df.columns))
    schema = T.StructType([*ordered.schema.fields, *outputs.fields])
    arrow_types = [_ARROW[type(f.dataType)] for f in outputs.fields]
    names = [f.name for f in outputs.fields]

    def run(batches):
        current, state = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in keys]
            values = [batch.column(c).to_pylist() for c in inputs]
            results = [[] for _ in names]
            for key, row in zip(zip(*columns), zip(*values)):
                if key != current:
                    current, state = key, None
                state, produced = step(state, *row)
                for out, item in zip(results, produced):
                    out.append(item)
            added = [pa.array(out, kind) for out, kind in zip(results, arrow_types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return ordered.mapInArrow(run, schema)


_ARROW = {T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.LongType: pa.int64()}


def fold_split(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[str],
    inputs: list[str],
    outputs: T.StructType,
    step,
    state: T.StructType,
    initial: tuple,
    chunk_rows: int = 100_000,
    carry: list[str] | None = None,
) -> DataFrame:
    """`fold_in_order` with long keys split into chunks folded in parallel. Runs jobs.

    `step` gets and returns its state as a tuple of the fields of `state`; a key starts at `initial`.
    Rows get exact positions (`block` is a coarse prefix of `order`) and chunks of `chunk_rows`
    positions; a key with fewer rows is one chunk. Every chunk is folded from `initial`.
    Where the end of the chunk before differs from that start, the chunk is folded again from the
    true one, until no start changes: by induction from a key's first chunk the result is then the
    sequential one, bit for bit. A fold that forgets its start within a chunk (as an exponential
    mean does after some hundred rows) settles after a pass or two. Only chunks that another one
    follows are folded for their end.
    """
    shared_dir(df.sparkSession)
    part = [*keys, "_chunk"]
    starts = [f"_start{i}" for i in range(len(initial))]
    ends = [f"_end{i}" for i in range(len(initial))]
    kinds = [f.dataType for f in state.fields]
    first = [F.lit(v).cast(k) for v, k in zip(initial, kinds)]
    kept = carry or df.columns
    placed = positions(df, keys, block, order, "_pos").withColumn(
        "_chunk", F.floor((F.col("_pos") - 1) / chunk_rows).cast("bigint")
    ).select(*dict.fromkeys([*keys, *inputs, *kept]), "_pos", "_chunk").checkpoint()  # every pass reads it

    def begun(now, *row):
        return step(row[: len(initial)] if now is None else now, *row[len(initial) :])

    def from_starts(known: DataFrame) -> DataFrame:
        return join_keys(placed, known.select(*part, *starts), part)

    def ends_of(known: DataFrame) -> DataFrame:
        return _last_states(from_starts(known), part, ["_pos"], [*starts, *inputs], ends, kinds, begun)

    in_key = W.partitionBy(*keys).orderBy("_chunk")
    known = placed.select(*part).distinct().withColumns(
        {"_more": F.lead(F.lit(1)).over(in_key).isNotNull(), **dict(zip(starts, first))}
    )
    done = join_keys(known, ends_of(known.filter("_more")), part, "left").checkpoint()
    while True:
        leads = F.lag(F.lit(1)).over(in_key).isNull()
        due = {s: F.when(leads, v).otherwise(F.lag(e).over(in_key)) for s, v, e in zip(starts, first, ends)}
        linked = done.withColumns({"_due" + s: c for s, c in due.items()})
        differs = F.lit(False)
        for s in starts:
            differs = differs | ~F.col("_due" + s).eqNullSafe(F.col(s))
        changed = linked.filter(differs).select(*part, "_more", *[F.col("_due" + s).alias(s) for s in starts])
        if changed.isEmpty():
            break
        again = join_keys(changed.drop("_more"), ends_of(changed.filter("_more")), part, "left")
        new = again.withColumnsRenamed({c: "_new" + c for c in [*starts, *ends]}).withColumn("_again", F.lit(True))
        done = join_keys(done, new, part, "left").select(
            *part, "_more", *[F.when(F.col("_again"), F.col("_new" + c)).otherwise(F.col(c)).alias(c) for c in [*starts, *ends]]
        ).checkpoint()
    folded = fold_in_order(from_starts(done), part, ["_pos"], [*starts, *inputs], outputs, begun)
    return folded.select(*kept, *[f.name for f in outputs.fields])


#: Rows of a key beyond which it is folded in chunks.
CHUNK_ROWS = 1_000_000


def coarse(df: DataFrame, column: str, blocks: int = 4096) -> Column:
    """A coarse prefix of the order by `column`, which is a number, a time or a text. Reads its range."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.substring(column, 1, 4)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    elif isinstance(kind, T.NumericType):
        value = F.col(column).cast("double")
    else:
        raise ValueError(f"name a block for the order by {column}")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or high == low:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    return F.floor((value - low) / (high - low) * blocks).cast("bigint")


def long_keys(df: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame | None:
    """The keys with more than `chunk_rows` rows, at most one for each so many; None if there are none. Runs a job."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk_rows).select(*keys)
    found = counted.collect()
    return F.broadcast(df.sparkSession.createDataFrame(found, counted.schema)) if found else None


def fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    inputs: list[str],
    outputs: T.StructType,
    step,
    state: T.StructType,
    initial: tuple,
    block: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
    carry: list[str] | None = None,
    long: DataFrame | None = None,
) -> DataFrame:
    """`fold_split` for the keys in `long` (see `long_keys`), `fold_in_order` for all others."""
    how = (order, inputs, outputs, step)
    if not keys:
        return fold_split(df, keys, block if block is not None else coarse(df, order[0]), *how, state, initial, chunk_rows, carry)
    if long is None:
        return fold_in_order(df, keys, *how, carry)
    short = fold_in_order(join_keys(df, long, keys, "left_anti"), keys, *how, carry)
    rest = join_keys(df, long, keys, "left_semi")
    split = fold_split(rest, keys, block if block is not None else coarse(rest, order[0]), *how, state, initial, chunk_rows, carry)
    return short.unionByName(split)


def keep_spaced(df: DataFrame, keys: list[str], order: list[str], gap: int) -> DataFrame:
    """The rows that are kept if each kept one is at least `gap` (in the first column of `order`, a long) after its key's last.

    One search per kept row; a task holds one time.
    """
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        current, last = None, None
        for batch in batches:
            times = batch.column(order[0]).to_numpy(zero_copy_only=False)
            columns = [batch.column(k) for k in keys]
            if not len(times):
                continue
            changed = np.zeros(len(times), dtype=bool)
            for c in columns:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                changed[1:] |= codes[1:] != codes[:-1]
            starts = np.r_[0, np.flatnonzero(changed), len(times)]
            kept = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                key = tuple(c[a].as_py() for c in columns)
                if key != current:
                    current, last = key, None
                found = kept_times(times[a:b], last, gap)
                if len(found):
                    last = int(times[a + found[-1]])
                    kept.append(found + a)
            yield batch.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))

    return ordered.mapInArrow(run, df.schema)


def _last_states(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], names: list[str], kinds: list, step) -> DataFrame:
    """One row per key: the state after its last row, in columns `names`."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*dict.fromkeys([*keys, *inputs]))
    schema = T.StructType([*[ordered.schema[k] for k in keys], *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches):
        current, state, types = None, None, []

        def record(found):
            columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

        for batch in batches:
            types = [*[batch.schema.field(k).type for k in keys], *[_ARROW[type(k)] for k in kinds]]
            columns = [batch.column(c).to_pylist() for c in keys]
            values = [batch.column(c).to_pylist() for c in inputs]
            found = []
            for key, row in zip(zip(*columns), zip(*values)):
                if key != current:
                    if current is not None:
                        found.append((*current, *state))
                    current, state = key, None
                state, _ = step(state, *row)
            if found:
                yield record(found)
        if current is not None:
            yield record([(*current, *state)])

    return ordered.mapInArrow(run, schema)
