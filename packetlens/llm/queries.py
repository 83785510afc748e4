"""The registered queries of the corpus operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm import bpe, exact, jaccard, language, lines, lm, packing, quality, resampling, secrets, simhash, toxicity, whitening
from packetlens.llm.common import documents

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(quality.ORACLE)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(documents(spark, sf_dir))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*base, F.round("quality", 4).alias("quality"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "rejected")


def kind_count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")


@query()
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *[kind_count(k) for k in ("assign", "access", "hex")], "base_sha256", secrets.span_text(F.col("spans")).alias("spans"))


@query()
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query(r"""
  WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
  e AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
  t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
  s AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 8),
  k AS (
    SELECT doc_id, count(*) AS n_removed FROM t WHERE bare IN (SELECT bare FROM s) GROUP BY doc_id
  ), j AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM t WHERE bare NOT IN (SELECT bare FROM s) GROUP BY doc_id
  )
  SELECT d.doc_id, coalesce(len(d.lines), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text
  FROM d LEFT JOIN k USING (doc_id) LEFT JOIN j USING (doc_id)""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(documents(spark, sf_dir))


@query()
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents together; a document's source is its host, and its own label is no evidence."""
    docs = documents(spark, sf_dir)
    pages = language.page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    none = F.lit(None).cast("string").alias("declared")
    rows = docs.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", none, F.col("source").alias("host"))
    rows = rows.union(pages.select(F.lit(None).cast("bigint"), "page_id", "text", "declared", "host"))
    found = language.identify(rows, docs, ["doc_id", "page_id"])
    return found.select("*", (F.col("posterior") >= 0.5).alias("kept"))


@query(r"""
  WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
  ), r AS (
    SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS size
    FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
  )
  SELECT doc_id, keep_id, size AS group_size, place = 1 AS kept, h AS text_sha256 FROM r""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query(r"""
  WITH crc AS (
    SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
    FROM (SELECT range AS i FROM range(256))
  ), texts AS (
    SELECT doc_id, true AS own, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT item_id, false, coalesce(text, '') FROM benchmark
  ), lists AS (
    SELECT doc_id, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
  ), w AS (SELECT doc_id, own, unnest(ws) AS word FROM lists),
  d AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
  b AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, CAST(2 * k + 1 AS INT), 2))::BIGINT)),
      lambda c, y: xor(c // 256, t[1 + xor(c & 255, y)])), 4294967295) % 10000 AS bucket
    FROM d, crc
  ), n AS (
    SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM w JOIN b USING (word) GROUP BY bucket
  ), g AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n
  ), m AS (
    SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE own GROUP BY doc_id
  ), e AS (
    SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM lists LEFT JOIN m USING (doc_id) WHERE own
  ), r AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS take FROM e
  )
  SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= take THEN place END AS rank FROM r""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query(r"""
  WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  ), s AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(ws) - 3) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) AS shingle FROM w WHERE len(ws) > 0
  ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (
    SELECT u, v FROM common JOIN n AS p ON p.doc_id = u JOIN n AS q ON q.doc_id = v WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)
  ), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT reach.doc_id, v FROM reach JOIN links ON other = u
  ), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)""")
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
