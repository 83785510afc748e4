"""Quality by weak supervision, in SQL expressions only.

Eight rules each call a document good (1) or bad (-1) or abstain (0). No rule decides alone: expectation-maximisation
over the table of vote patterns (at most 3^8 rows, however large the corpus) estimates how often each
rule that votes is right, and the posterior probability of being good replaces a filter that all
must pass. Only documents that fail a hard limit (fewer than 50 words, or over half of the words in repeated
three-word windows) are refused outright.

Repeated windows are found by sorting one array per text of their XXH64 (all 64 bits) and places; windows with equal hashes
stand side by side. Two different ones of a text of a million words do so with a probability of 3e-8.

Defined cases: null and empty texts have no words and fail the limit; null ids and equal rows are each returned; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import WORD, keyed_texts, stored

#: Name, when it votes bad, when it votes good; over the counts below, in integers.
RULES = (
    ("length", "n_words < 50", "n_words >= 100"),
    ("repetition", "100 * n_repeat_words > 50 * n_words", "false"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("letters", "10 * (word_chars - n_letters) > word_chars", "n_words > 0 AND 25 * (word_chars - n_letters) <= word_chars"),
    ("capitals", "10 * n_caps > 3 * word_chars", "false"),
    ("marks", "10 * n_marks > n_words", "false"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words", "false"),
)
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

#: Expectation-maximisation: rounds, first guesses, pseudo-counts (right, wrong) of each accuracy and (good, bad) of the prior, bounds.
ROUNDS = 25
PRIOR, ACCURACY = 0.8, 0.8
RIGHT, WRONG = 40.0, 10.0
GOOD, BAD = 8.0, 2.0
LOW, HIGH = 0.55, 0.98


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules use, one row per row of `docs`."""
    texts = keyed_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = texts.select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    ).withColumn("n", F.size("words"))
    keys = split.withColumn("keys", F.expr(
        "CASE WHEN n >= 3 THEN transform(sequence(0, n - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, CAST(i AS BIGINT) AS i)) END"
    )).withColumn("sorted", F.sort_array("keys"))
    hits = keys.withColumn("hits", F.expr(
        "sort_array(transform(filter(sorted, (x, j) -> x.h = get(sorted, j - 1).h OR x.h = get(sorted, j + 1).h), x -> x.i))"
    ))
    covered = "aggregate(transform(hits, (p, j) -> least(3L, p - coalesce(get(hits, j - 1), -3L))), 0L, (s, k) -> s + k)"
    return hits.select(
        "doc_id", F.col("n").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("bigint").alias("n_letters"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_caps"), F.regexp_count("text", F.lit(r"[!?|]")).cast("bigint").alias("n_marks"),
    )


def votes() -> Column:
    """The votes as an array, by the order of RULES."""
    return F.array(*[F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for _, bad, good in RULES])


def _odds(votes_sql: str, model: str) -> str:
    """Log odds of good, of votes under a model: the prior's and each vote's, weighed by its rule's accuracy."""
    term = f"{votes_sql}[j] * ln({model}.right[j] / (1 - {model}.right[j]))"
    return f"aggregate(sequence(0, {len(RULES) - 1}), ln({model}.prior / (1 - {model}.prior)), (s, j) -> s + {term})"


def _fit() -> str:
    """The model after all rounds, as one fold over the array `patterns` of (v, n)."""
    weight = f"transform(patterns, p -> struct(p.v AS v, p.n AS n, p.n / (1 + exp(-({_odds('p.v', 'm')}))) AS g))"

    def total(what: str) -> str:
        return f"aggregate(w, 0D, (s, x) -> s + {what})"

    agreed = total("CASE x.v[j] WHEN 1 THEN x.g WHEN -1 THEN x.n - x.g ELSE 0D END")
    cast = total("CASE WHEN x.v[j] <> 0 THEN x.n ELSE 0D END")
    right = f"transform(sequence(0, {len(RULES) - 1}), j -> greatest({LOW}D, least({HIGH}D, ({agreed} + {RIGHT}D) / ({cast} + {RIGHT + WRONG}D))))"
    step = f"transform(array({weight}), w -> struct(({total('x.g')} + {GOOD}D) / ({total('x.n')} + {GOOD + BAD}D) AS prior, {right} AS right))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), struct({PRIOR}D AS prior, array_repeat({ACCURACY}D, {len(RULES)}) AS right), (m, i) -> {step})"


def accuracies(voted: DataFrame) -> DataFrame:
    """One row (prior, right): the share of good documents, and how often each rule's votes are right."""
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    every = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("patterns"))
    return every.select(F.expr(_fit()).alias("m")).select("m.*")


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, votes, quality (posterior of good) and kept, one row per row of `docs`."""
    voted = stored(counts(docs).withColumn("votes", votes()))
    model = accuracies(voted).select(F.struct("prior", "right")).scalar()
    judged = voted.withColumn("m", model).withColumn("quality", F.expr(f"1 / (1 + exp(-({_odds('votes', 'm')})))"))
    judged = judged.drop("m").withColumn("base_failed", F.expr(FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def _number(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _oracle() -> str:
    k = range(1, len(RULES) + 1)
    cases = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in RULES)
    odds = "ln(m.prior / (1 - m.prior))" + "".join(f" + v[{j}] * ln(m.accuracy[{j}] / (1 - m.accuracy[{j}]))" for j in k)
    one = "greatest({low}, least({high}, (sum(CASE v[{j}] WHEN 1 THEN g WHEN -1 THEN n - g ELSE 0 END) + {right}) / (sum(CASE WHEN v[{j}] <> 0 THEN n ELSE 0 END) + {every})))"
    numbers = {"low": _number(LOW), "high": _number(HIGH), "right": _number(RIGHT), "every": _number(RIGHT + WRONG)}
    accuracy = "[" + ", ".join(one.format(j=j, **numbers) for j in k) + "]"
    first = "[" + ", ".join([_number(ACCURACY)] * len(RULES)) + "]"
    return rf"""
  WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
  ), w AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d
  ), windows AS (
    SELECT doc_id, place, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY place)
  ), twice AS (
    SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL
  ), covered AS (
    SELECT doc_id, count(DISTINCT place + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE twice.n > 1 GROUP BY doc_id
  ), c AS (
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
      length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_caps, length(t) - length(regexp_replace(t, '[!?|]', '', 'g')) AS n_marks
    FROM d LEFT JOIN covered USING (doc_id)
  ), voted AS (SELECT *, [{cases}] AS v FROM c), pats AS (
    SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY v
  ), em(i, prior, accuracy) AS (
    SELECT 0, {_number(PRIOR)}, {first}
    UNION ALL
    SELECT i + 1, (sum(g) + {_number(GOOD)}) / (sum(n) + {_number(GOOD + BAD)}), {accuracy}
    FROM (SELECT m.i, v, n, n / (1 + exp(-({odds}))) AS g FROM em m, pats WHERE m.i < {ROUNDS}) GROUP BY i
  ), judged AS (
    SELECT voted.*, 1 / (1 + exp(-({odds}))) AS q, {FAILED} AS base_failed FROM voted, (SELECT * FROM em WHERE i = {ROUNDS}) m
  )
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept,
    round(q, 4) AS quality FROM judged"""


ORACLE = _oracle()
