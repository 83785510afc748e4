"""Exact duplicates, found in a minimal perfect hash over the digests already known.

Texts are equal if their SHA-256 without white space is. Distinct historical digests are dealt by
prefix into shards of bounded size. Each shard is a minimal perfect hash: a cascade of bit arrays
in which each digest has its own bit, whose rank is its slot. A slot holds the full digest and the
locator of its winner. A later digest is looked up: only if the slot's 32 bytes are its own is it
a repeat; any other goes to groups among the later rows alone.

Defined cases: null text counts as empty; null ids lose ties; of rows equal in id and text one is
kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import encoded, fold_of, record, slices, stored, unfolded

WHITE = b" \t\n\x0b\x0c\r"
LEVELS = 40
NO_ID = np.iinfo(np.int64).max


def _digest_batches(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("digest", pa.binary())])
    for batch in slices(batches):
        texts = encoded(batch)
        chars = [len(t) if t.isascii() else len(t.decode()) for t in texts]
        found = [hashlib.sha256(t.translate(None, WHITE)).digest() for t in texts]
        own = record(schema, [batch.column("doc_id"), chars, found])
        yield pa.RecordBatch.from_arrays([*own.columns, *[batch.column(c) for c in carry]], names=[*schema.names, *carry])


def digests(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(doc_id, n_chars, digest) of each row, and its columns named in `carry`."""
    names = list(carry)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *names)
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return texts.mapInArrow(lambda batches: _digest_batches(batches, names), f"doc_id long, n_chars long, digest binary{more}")


def _places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below `size` for each digest, another one at each level."""
    x = first + np.uint64(level) * (second | np.uint64(1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def _halves(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digest).view(np.uint64).reshape(-1, 4)
    return words[:, 1], words[:, 2]


def build_hash(digest: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one per level, in which every row of `digest` (n x 32 bytes, distinct) owns one bit."""
    levels, left = [], np.arange(len(digest))
    first, second = _halves(digest)
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("digests collide on every level: they are not distinct")
        size = max(2, 2 * len(left))
        at = _places(first[left], second[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slots_of(levels: list[np.ndarray], digest: np.ndarray) -> np.ndarray:
    """The slot of each row of `digest`; -1 if no level has its bit. A digest that is not in the hash may get any slot."""
    out = np.full(len(digest), -1)
    if not len(digest):
        return out
    first, second = _halves(digest)
    left, before = np.arange(len(digest)), 0
    for level, bits in enumerate(levels):
        at = _places(first[left], second[left], level, len(bits))
        hit = bits[at]
        out[left[hit]] = before + np.cumsum(bits)[at[hit]] - 1
        left, before = left[~hit], before + int(bits.sum())
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


INDEX = "shard int, levels array<binary>, sizes array<int>, digests binary, keep_ids array<long>, keep_chars array<long>, counts array<long>"
GROUPS = "digest binary, keep_id long, keep_chars long, group_size long, historical boolean"


def _build_shard(table: pa.Table) -> pa.Table:
    digest = _matrix(table["digest"])
    levels = build_hash(digest)
    order = np.argsort(slots_of(levels, digest))
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
        "levels": pa.array([[np.packbits(b).tobytes() for b in levels]], pa.list_(pa.binary())),
        "sizes": pa.array([[len(b) for b in levels]], pa.list_(pa.int32())),
        "digests": pa.array([digest[order].tobytes()], pa.binary()),
        **{name: pa.array([table[name].take(order).to_pylist()], pa.list_(pa.int64())) for name in ("keep_ids", "keep_chars", "counts")},
    })


def _resolve(index: pa.Table, probes: pa.Table) -> pa.Table:
    """The groups of one shard: slots, with the probes that they hold, and the other probes."""
    digest = _matrix(probes["digest"])
    ids, chars, counts = (probes[n].to_pylist() for n in ("keep_ids", "keep_chars", "counts"))
    out: list[list] = [[], [], [], [], []]
    member = np.zeros(len(digest), bool)
    if index.num_rows:
        row = {n: index[n][0].as_py() for n in index.column_names}
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(row["levels"], row["sizes"], strict=True)]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        slots = slots_of(levels, digest)
        member = (slots >= 0) & (held[slots] == digest).all(axis=1)
        keep, size, n = row["keep_ids"], row["keep_chars"], row["counts"]
        for i in np.flatnonzero(member):
            s = slots[i]
            n[s] += counts[i]
            if (-chars[i], NO_ID if ids[i] is None else ids[i]) < (-size[s], NO_ID if keep[s] is None else keep[s]):
                keep[s], size[s] = ids[i], chars[i]
        out = [[held[i].tobytes() for i in range(len(held))], keep, size, n, [True] * len(held)]
    for i in np.flatnonzero(~member):
        for column, value in zip(out, (digest[i].tobytes(), ids[i], chars[i], counts[i], False), strict=True):
            column.append(value)
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ("digest", "keep_id", "keep_chars", "group_size", "historical")
    return pa.table({n: pa.array(v, k) for n, v, k in zip(names, out, kinds, strict=True)})


def _winners(folded: DataFrame, shards: int) -> DataFrame:
    """One row per digest; of a digest's rows, the longest, then the smallest id."""
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("w")
    return folded.groupBy("digest").agg(first, F.sum("copies").alias("counts")).select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest",
        F.col("w.id").alias("keep_ids"), (-F.col("w.n")).alias("keep_chars"), "counts",
    )


def build_index(folded: DataFrame, shards: int) -> DataFrame:
    """The shards of the minimal perfect hash over the distinct digests of `folded`, one row each."""
    return _winners(folded, shards).groupBy("shard").applyInArrow(_build_shard, INDEX)


def resolve(index: DataFrame, folded: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of the index and of `folded`, with the row that stays."""
    return index.groupBy("shard").cogroup(_winners(folded, shards).groupBy("shard")).applyInArrow(_resolve, GROUPS)


def exact_duplicates(docs: DataFrame, historical: Column | None = None, rows_per_shard: int = 8192, carry: list[str] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row per row of `docs`.

    `historical` says on `doc_id` which rows build the hash (by default half of them, by crc32);
    the others are looked up in it. The result does not depend on that choice.
    Columns of `docs` named in `carry` are added. Rows that differ in them are told apart, so that several of an id,
    length and digest may be `kept`.
    """
    old = fold_of(F.col("doc_id"), 2) == 0 if historical is None else historical
    folded = stored(digests(docs, carry).groupBy("doc_id", "n_chars", "digest", *carry).agg(F.count(F.lit(1)).alias("copies")))
    shards = max(1, -(-folded.count() // rows_per_shard))
    index = stored(build_index(folded.filter(old), shards))
    groups = resolve(index, folded.filter(~F.coalesce(old, F.lit(False))), shards)
    own = folded.select("doc_id", "n_chars", F.col("digest").alias("_own"), "copies", *carry)
    joined = own.join(groups, F.col("_own") == F.col("digest"))
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    each = joined.select("doc_id", "keep_id", "group_size", wins.alias("_wins"), "digest", "copies", F.lit(1).cast("bigint").alias("_one"), *carry)
    return unfolded(each, "_one", "copies", "_copy").select(
        "doc_id", "keep_id", "group_size", (F.col("_wins") & (F.col("_copy") == 1)).alias("kept"), "digest", *carry,
    )
