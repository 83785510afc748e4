import math
import re
from collections import Counter

from packetlens.llm import quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_and_limit(docs, odd, empty):
    for frame in (docs[0], odd):
        found = quality.quality(frame).collect()
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
        want = []
        for r in frame.collect():
            c = counts_by_hand(r.text or "")
            want.append((str(r.doc_id), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        assert got == sorted(want)
        assert not any(r.kept and r.base_failed for r in found) and all(0 <= r.quality <= 1 for r in found)
    assert quality.quality(empty).collect() == []


def test_expectation_maximisation(spark, docs):
    voted = quality.counts(docs[0]).withColumn("votes", quality.votes())
    rows = [r.votes for r in voted.collect()]
    size = len(quality.RULES)
    prior, right = quality.PRIOR, [quality.ACCURACY] * size
    for _ in range(quality.ROUNDS):
        good = [1 / (1 + math.exp(-sum(v * math.log(a / (1 - a)) for v, a in zip(r, right, strict=True)) - math.log(prior / (1 - prior)))) for r in rows]
        for j in range(size):
            agreed = sum(g if r[j] == 1 else 1 - g for r, g in zip(rows, good, strict=True) if r[j])
            cast = sum(r[j] != 0 for r in rows)
            right[j] = min(quality.HIGH, max(quality.LOW, (agreed + quality.RIGHT) / (cast + quality.RIGHT + quality.WRONG)))
        prior = (sum(good) + quality.GOOD) / (len(rows) + quality.GOOD + quality.BAD)
    found = quality.accuracies(voted).first()
    assert abs(found.prior - prior) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(found.right, right, strict=True))


def test_agrees_with_labels(spark):
    found = {r.doc_id: r for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    labels = [(found[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in found]
    junk = [r for r, good in labels if not good]
    clean = [r for r, good in labels if good and not r.base_failed]
    assert sum(not r.kept for r in junk) > 0.95 * len(junk)
    assert sum(r.kept for r in clean) > 0.99 * len(clean)


def test_main_path_is_native(docs):
    plan = quality.quality(docs[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_a_text_of_a_million_words(spark):
    """All words differ but for three that come again at the end."""
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "), F.lit(" w5 w6 w7"))
    got = quality.counts(spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))).first()
    assert (got.n_words, got.n_repeat_words) == (1_000_003, 6)
