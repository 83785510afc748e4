"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept and returns the same columns for those that it
keeps; the last returns one row per packed piece. Null texts count as empty; an empty table stays empty.
Each row takes its own verdict, also where rows share a doc_id or have none; of rows equal in id and text the duplicate
stages keep one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm import exact, packing, secrets, simhash, toxicity
from packetlens.llm.common import documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


KEY = ["_a", "_b"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with 128 hashed bits of id and text, by which a verdict finds its row."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_b"))


def _one_of_each(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of each group of `found`: (KEY, group, place), one row per row of `keyed`."""
    found = stored(found)
    first = found.groupBy("group").agg(F.min(F.struct("place", *KEY)).alias("w")).select("w._a", "w._b")
    copies = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
    twice = stored(copies.filter("copies > 1").join(first, KEY, "left_semi").select(*KEY))
    gone = copies.join(first, KEY, "left_anti").select(*KEY).union(twice)
    again = keyed.join(twice, KEY, "left_semi").groupBy(*KEY).agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return keyed.join(gone, KEY, "left_anti").select(COLUMNS).union(again)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    found = toxicity.toxicity(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS[1:])
    return found.filter("not rejected").select("doc_id", *[F.col(f"_{c}").alias(c) for c in COLUMNS[1:]])


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document, then the smallest id, of each group of texts equal but for white space."""
    keyed = _keyed(docs)
    found = exact.exact_duplicates(keyed, carry=KEY)
    return _one_of_each(keyed, found.select(*KEY, F.col("digest").alias("group"), (~F.col("kept")).alias("place")))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of SimHash fingerprints: three-word shingles, links at 3 differing bits or fewer."""
    keyed = _keyed(docs)
    found = simhash.simhash_components(keyed, carry=KEY)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    return _one_of_each(keyed, found.select(*KEY, F.col("root").alias("group"), place.alias("place")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    found = secrets.scan_secrets(docs.select(COLUMNS), carry=["text", "lang", "source", "n_chars"])
    text = secrets.redact(F.col("_text"), F.col("spans"))
    length = F.when(F.size("spans") > 0, F.length(text).cast("bigint")).otherwise(F.col("_n_chars"))
    return found.select("doc_id", text.alias("text"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), length.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and hash codes are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
