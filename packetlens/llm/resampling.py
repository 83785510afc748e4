"""Importance resampling towards a target set of texts, over hashed word features.

Features are the runs of 1 to `longest` consecutive words, joined by one space, repeats counted; a feature's bucket is its
CRC-32 modulo `buckets`. Checksums are made a length at a time: the distinct features of a block that have equal length form a
matrix of bytes, all rows of which advance by one column at once; the results go back to where the features stand. A feature
longer than `LONG` bytes is itself cut into a matrix of rows, whose registers are then joined (the register is
linear over GF(2)).

Bucket counts over all rows of both tables (at most `buckets` numbers each) give every bucket's gain; a document's weight is the mean
gain of its features. Gumbel noise hashed from the id makes the highest scores a draw without replacement. Scores are whole
numbers of a range that the formula bounds, so their histogram gives each score its first rank; only the rows of drawn scores
are sorted, score by score, equal rows as one with a count.

Defined cases: null and empty texts have no words and weight 0. A null id is hashed as the empty text and comes last among
ties; rows that agree in score and id are ranked by their features, and repeated rows take one rank each. Without target or
source texts the formula still holds. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlens.llm.common import encoded, record, slices, stored, unfolded, word_slices

POLYNOMIAL = 0xEDB88320
#: Longer features are cut into rows of so many bytes.
LONG = 1024
#: Words of a block.
WORDS = 1 << 17


def _table() -> np.ndarray:
    """The register after each byte."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return value


TABLE = _table()
START = np.uint32(0xFFFFFFFF)


def advanced(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The registers of all rows after the bytes of `columns`, one column at a time."""
    for column in columns:
        state = TABLE[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


#: The register's 32 bits, each after LONG zero bytes.
ZEROS = advanced(np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros((LONG, 1), np.uint8))


def _long_crc(data: np.ndarray) -> int:
    whole = len(data) // LONG
    state = np.zeros(whole, np.uint32)
    state[0] = START
    register = 0
    for row in advanced(state, np.ascontiguousarray(data[: whole * LONG].reshape(whole, LONG).T)).tolist():
        moved = np.bitwise_xor.reduce(ZEROS[np.flatnonzero(register >> np.arange(32) & 1)], initial=np.uint32(0))
        register = int(moved) ^ row
    rest = advanced(np.array([register], np.uint32), data[whole * LONG :, None])
    return int(rest[0] ^ START)


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice of `data`, by buckets of equal length."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        size = int(lengths[rows[0]]) if len(rows) else 0
        if size >= LONG:
            for i in rows.tolist():
                out[i] = _long_crc(data[starts[i] : starts[i] + size])
        elif len(rows):
            matrix = data[starts[rows] + np.arange(size)[:, None]]
            out[rows] = advanced(np.full(len(rows), START, np.uint32), matrix) ^ START
    return out


#: Digits, letters and all bytes of characters beyond ASCII.
IN_WORD = np.isin(np.arange(256), np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return word_slices(texts, IN_WORD, b"\0")


def _runs(data, starts, lengths, owner, k: int) -> Iterator[tuple[np.ndarray, pa.DictionaryArray]]:
    """(place of the text, bytes) of all runs of k words, in blocks."""
    for at in range(0, len(starts) - k + 1, WORDS):
        first = np.arange(at, min(at + WORDS, len(starts) - k + 1))
        first = first[owner[first] == owner[first + k - 1]]
        if not len(first):
            continue
        # the words of the block, each with a space behind it
        low, high = first[0], first[-1] + k
        size, begun = lengths[low:high], starts[low:high]
        place = np.cumsum(size + 1) - (size + 1)
        spaced = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        source = np.arange(int(size.sum())) + np.repeat(begun - (np.cumsum(size) - size), size)
        spaced[source + np.repeat(place - begun, size)] = data[source]
        begin = place[first - low]
        length = place[first + k - 1 - low] + lengths[first + k - 1] - begin
        offsets = np.r_[0, np.cumsum(length)]
        held = spaced[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], length)]
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)])
        yield owner[first], runs.dictionary_encode()


def features(texts: list[bytes], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of its text, bucket) of every feature, in blocks."""
    yield from _features(words(texts), longest, buckets)


def _features(split, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(1, longest + 1):
        for owner, runs in _runs(*split, k):
            held = runs.dictionary
            offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
            found = crcs(np.frombuffer(held.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)) % np.uint32(buckets)
            yield owner, found[runs.indices.to_numpy()].astype(np.int64)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, found in features(encoded(batch), longest, buckets):
                counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    buckets = len(source)
    ratio = (target + 1.0) * (float(source.sum()) + buckets) / ((source + 1.0) * (float(target.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size = batch.num_rows
            n, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
            split = words(encoded(batch))
            for owner, found in _features(split, longest, len(gain)):
                n += np.bincount(owner, minlength=size)
                # whole numbers far below 2^53
                total += np.bincount(owner, gain[found], minlength=size).astype(np.int64)
            yield record(schema, [batch.column("doc_id"), np.bincount(split[3], minlength=size), n, total // np.maximum(n, 1)])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable hashed from an id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, share: tuple[int, int] = (10, 100)
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of `docs`; rank is null for those not drawn."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = stored(weights(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    held = rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the range of scores
    take = sum(r["n"] for r in held) * share[0] // share[1]
    first, before = [], 0
    for r in sorted(held, key=lambda r: -r["score"]):
        if before < take:
            first.append((r["score"], before))
            before += r["n"]
    none = F.lit(None).cast("bigint").alias("rank")
    if not first:
        return rows.withColumn("rank", none)
    drawn = able & (F.col("score") >= first[-1][0])
    starts = F.broadcast(docs.sparkSession.createDataFrame(first, "_score long, _before long"))
    columns = rows.columns
    folded = rows.filter(drawn).groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).join(starts, F.col("score") == F.col("_score"))
    order = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features", "weight")
    place = F.col("_before") + F.coalesce(F.sum("_copies").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    ranked = unfolded(folded.withColumn("_first", place), "_first", "_copies", "rank")
    ranked = ranked.select(*columns, F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    return ranked.union(rows.filter(~drawn).select(*columns, none))
