"""Language of texts by Bayesian fusion of what the text and its address say.

Evidence of a row: the likelihood of its byte trigrams in each language; the language its markup
declares; the suffix of its address; and the prior of its host. The trigram model counts every labelled text
outside the held-out fold. How often each language is declared, and under which suffixes it stands, are counted over
all rows by the languages that the text alone points to. A host's prior is smoothed towards its
domain's, that towards all rows'. The log terms add up; the posterior decides.

Defined cases: null and empty texts have no trigrams, the rest of the evidence decides; a missing declaration, suffix or host
says nothing; without any labelled text the language is null; null ids and equal rows are each returned; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import encoded, fold_of, record, slices, stored

BUCKETS = 1 << 14
#: Languages with a table of their own; the rarest beyond them count as one, OTHER.
MOST_LANGUAGES, OTHER = 256, "other"
SCRIPT = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
TAG = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def visible(markup: str) -> str:
    """The text of a page, without tags, scripts, styles and comments."""
    return html.unescape(TAG.sub(" ", SCRIPT.sub(" ", markup)))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host) of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("declared", pa.string()), ("url", pa.string())])
        for batch in slices(batches, "html"):
            markup = [x or "" for x in batch.column("html").to_pylist()]
            said = [DECLARED.search(m) for m in markup]
            yield record(schema, [batch.column("page_id"), [visible(m) for m in markup], [m and m[1].lower() for m in said], batch.column("url")])

    read = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"), F.col("url").cast("string").alias("url"))
    found = read.mapInArrow(run, "page_id long, text string, declared string, url string")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return found.select("page_id", "text", "declared", F.when(host != "", host).alias("host"))


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the joined texts, and the range of places within each text."""
    data = np.frombuffer(b"".join(texts) + b"\0\0", np.uint8).astype(np.uint32)
    mixed = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    return mixed >> np.uint32(18), starts, np.maximum(ends - 2, starts)


def _normal(text: bytes) -> bytes:
    return b" %b " % b" ".join(text.lower().split()) if text else b""


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (text, lang) with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            bucket, starts, stops = _trigrams([_normal(t) for t in encoded(batch)])
            for lang, a, b in zip(batch.column("lang").to_pylist(), starts, stops, strict=True):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += np.bincount(bucket[a:b], minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield record(pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]), [[lang] * len(at), at.astype(np.int32), n[at]])

    labelled = texts.filter("lang is not null").select("text", "lang")
    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (language, bucket); at most (MOST_LANGUAGES + 1) x BUCKETS numbers."""
    sizes = texts.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    most = [r.lang for r in sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    named = F.when(F.col("lang").isin(most), F.col("lang")).when(F.col("lang").isNotNull(), OTHER)
    rows = trigram_counts(texts.select("text", named.alias("lang"))).collect()
    names = sorted({r.lang for r in rows})
    n = np.full((len(names), BUCKETS), 0.5)
    for r in rows:
        n[names.index(r.lang), r.bucket] += r.n
    return names, np.log(n / n.sum(axis=1, keepdims=True))


def likelihoods(rows: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep` and `loglik`, an array by language. A byte is in three trigrams, so a third of their sum counts."""
    table = rows.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bucket, starts, stops = _trigrams([_normal(t) for t in encoded(batch)])
            sums = []
            for own in table.value:
                upto = np.concatenate([[0.0], np.cumsum(own[bucket], dtype=np.float64)])
                sums.append((upto[stops] - upto[starts]) / 3)
            columns = [batch.column(c) for c in keep] + [pa.array(list(np.array(sums).T), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "loglik"])

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(run, f"{kinds}, loglik array<double>")


def _one_hot(place: Column, size: int) -> list[Column]:
    return [F.count(F.when(place == i, 1)).cast("double").alias(f"n{i}") for i in range(size)]


def _array(size: int) -> Column:
    return F.array(*[F.col(f"n{i}") for i in range(size)])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _likely(values: DataFrame, key: str, place: Column, size: int, total: Column) -> DataFrame:
    """Per value of `key`: log of the share of each language's rows that have it, one count added to each value."""
    n = values.filter(F.col(key).isNotNull()).groupBy(key).agg(*_one_hot(place, size))
    spread = F.zip_with(_array(size), F.col("total"), lambda a, t: F.log((a + 0.5) / (t + 1)))
    return n.withColumn("total", total).select(F.col(key).alias(f"_{key}"), spread.alias(f"log_{key}"))


def fuse(evidence: DataFrame, names: list[str], strength: float = 20.0) -> DataFrame:
    """Add text_lang, predicted and posterior to rows with loglik, declared, suffix, host and domain.

    `strength` is the number of rows that a domain's prior counts for at a host, and that all rows' count for at a domain.
    """
    size = len(names)
    first = evidence.withColumn("place", F.array_position("loglik", F.array_max("loglik")).cast("int") - 1)
    said = first.withColumn("place", F.when(F.col("text_size") > 0, F.col("place")))
    place = F.col("place")
    total = said.agg(*_one_hot(place, size)).select(_array(size)).scalar()
    declared = _likely(said, "declared", place, size, total)
    suffix = _likely(said, "suffix", place, size, total)
    even = F.transform("total", lambda t: (t + 1) / (_sum(F.col("total")) + size))
    domains = said.filter("domain is not null").groupBy("domain").agg(*_one_hot(place, size)).withColumn("total", total)
    n = _array(size)
    domains = domains.select(F.col("domain").alias("_domain"), F.zip_with(n, even, lambda a, p: (a + strength * p) / (_sum(n) + strength)).alias("domain_prior"))
    hosts = said.filter("host is not null").groupBy("host", "domain").agg(*_one_hot(place, size))
    hosts = hosts.join(domains, F.col("domain") == F.col("_domain"))
    hosts = hosts.select(F.col("host").alias("_host"), F.zip_with(n, F.col("domain_prior"), lambda a, p: F.log((a + strength * p) / (_sum(n) + strength))).alias("log_host"))
    joined = first.withColumn("total", total)
    joined = joined.join(declared, F.col("declared") == F.col("_declared"), "left").join(suffix, F.col("suffix") == F.col("_suffix"), "left")
    joined = joined.join(hosts, F.col("host") == F.col("_host"), "left")
    nothing = F.array(*[F.lit(0.0)] * size)
    prior = F.coalesce("log_host", F.transform(even, lambda p: F.log(p)))
    terms = [F.col("loglik"), prior, F.coalesce("log_declared", nothing), F.coalesce("log_suffix", nothing)]
    fused = terms[0]
    for t in terms[1:]:
        fused = F.zip_with(fused, t, lambda a, b: a + b)
    scored = joined.withColumn("fused", fused).withColumn("best", F.array_max("fused"))
    weight = F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    langs = F.array(*[F.lit(x) for x in names])
    return scored.select(
        *evidence.columns, F.when(F.col("text_size") > 0, langs[F.col("place")]).alias("text_lang"),
        F.element_at(langs, F.array_position("fused", F.col("best")).cast("int")).alias("predicted"), (1 / weight).alias("posterior"),
    )


def identify(rows: DataFrame, labelled: DataFrame, ids: list[str], folds: int = 4, held_out: int = 2, strength: float = 20.0) -> DataFrame:
    """`ids`, host, declared, suffix, text_lang, predicted and posterior of rows (`ids`, text, declared, host).

    `labelled` has (doc_id, text, lang); its fold `held_out` by crc32 of the id is not learned from.
    """
    texts = labelled.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    names, model = train(texts.filter(fold_of(F.col("doc_id"), folds) != held_out))
    if not names:
        none = F.lit(None).cast("string")
        return rows.select(*ids, "host", "declared", none.alias("suffix"), none.alias("text_lang"), none.alias("predicted"), F.lit(None).cast("double").alias("posterior"))
    known = F.when(F.col("declared").isNotNull(), F.when(F.col("declared").isin(names), F.col("declared")).otherwise("other"))
    labels = F.split("host", r"\.")
    dotted = F.size(labels) > 1
    parts = rows.select(
        *ids, F.coalesce("text", F.lit("")).alias("text"), known.alias("declared"), "host", F.when(dotted, F.element_at(labels, -1)).alias("suffix"),
        F.when(dotted, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.col("host")).alias("domain"),
        F.length(F.btrim(F.coalesce("text", F.lit("")))).alias("text_size"),
    )
    evidence = stored(likelihoods(parts, model, [*ids, "declared", "host", "suffix", "domain", "text_size"]))
    return fuse(evidence, names, strength).select(*ids, "host", "declared", "suffix", "text_lang", "predicted", "posterior")
