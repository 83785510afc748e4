"""What the corpus operators share: batches of texts, row keys, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.session import shared_dir

#: Characters that separate words, as a regular expression class.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just (doc_id long, text), whatever other columns there are."""
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def sampled(key: Column, most: int, of: int, seed: int = 42) -> Column:
    """True for about `most` of `of` distinct keys, chosen by hash. The hash is wide, so that the share may be tiny."""
    wide = 1 << 60
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(wide)) < int(min(1.0, most / max(1, of)) * wide)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size; a longer text is a batch of its own."""
    for batch in batches:
        sizes = np.frombuffer(_lengths(batch.column(text)), dtype=np.int64)
        start = used = 0
        for i, n in enumerate(sizes):
            if i > start and (used + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        if batch.num_rows > start:
            yield batch.slice(start)


def _lengths(column: pa.Array) -> bytes:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()


def strings(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(text).to_pylist()]


def encoded(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 texts of a batch; null is the empty text."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def unfolded(df: DataFrame, first: str, copies: str, name: str, most: int = 10_000) -> DataFrame:
    """Each row `copies` times, `name` counting up from `first`. Large counts are cut into parts that are spread over tasks."""
    parts = F.sequence(F.lit(0).cast("bigint"), F.expr(f"({copies} - 1) div {most}"))
    cut = df.withColumn("_part", F.explode(parts))
    large = cut.filter(F.col(copies) > most).repartition(F.col("_part"), F.col(first))
    low = F.col(first) + F.col("_part") * most
    high = F.least(low + most, F.col(first) + F.col(copies)) - 1
    return cut.filter(F.col(copies) <= most).union(large).withColumn(name, F.explode(F.sequence(low, high))).drop("_part")


_BYTES = np.arange(256)
#: Each byte, A to Z as a to z.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def word_slices(texts: list[bytes], inside: np.ndarray, separator: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, start and length of each word in them, place of its text); `inside` tells the bytes of words."""
    raw = np.frombuffer(separator.join(texts) + separator, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[False, inside[raw], False]))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return LOWER[raw], starts, lengths, np.searchsorted(ends, starts, side="right")


class Recent(dict):
    """Computed values by key. At `keep` keys the table becomes the old one, from which keys in use come back.

    Values of keys longer than `longest` are computed each time, so that the table is bounded in bytes.
    """

    def __init__(self, compute, keep: int, longest: int = 64):
        self.compute, self.keep, self.longest, self.old = compute, keep, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.keep:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value
