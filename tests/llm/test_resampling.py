import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from packetlens.llm import queries, resampling
from packetlens.llm.common import unfolded

from .conftest import SF

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features_of(text, longest):
    words = WORD.findall((text or "").encode().lower())
    runs = [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r) % 10_000 for r in runs]


def by_hand(rows, target, longest=1, share=10):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    found = [(i, *features_of(t, longest)) for i, t in rows]
    source, aim = Counter(b for _, _, f in found for b in f), Counter(b for t in target for b in features_of(t, longest)[1])
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((n + 1) * (t_all + 10_000)))) for b, n in source.items()}
    out = []
    for i, n_words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5], r[1], r[2]))
    for place, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_registered_query_against_brute_force_and_sql(spark, docs):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = rows_of(queries.QUERIES["op11_importance_resampling"](spark, SF))
    assert found == by_hand([(r.doc_id, r.text) for r in docs[1]], target)
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(db.execute(queries.ORACLE["op11_importance_resampling"]).fetchall(), key=str) == found


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows_ties_and_copies(spark, odd, empty, longest):
    many = [(8, "an idiot word " * 10), (None, "some more words here " * 8), *[(9, "one text that occurs very often " * 4)] * 40, (9, "another text with this id " * 5)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + many
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS rank", "2 AS weight", "3 AS _copies").repartition(3)
    target = spark.createDataFrame([(None,), ("",), ("idiot words",)], "text string")
    for share in (10, 50, 100):
        got = resampling.resample(frame, target, longest=longest, share=(share, 100))
        assert rows_of(got) == by_hand(rows, [None, "", "idiot words"], longest, share)
    assert resampling.resample(empty, target).collect() == []
    assert rows_of(resampling.resample(frame, target.filter("false"))) == by_hand(rows, [])


@pytest.mark.parametrize("block", [4, 1 << 17])
def test_checksums_of_all_lengths(monkeypatch, block):
    monkeypatch.setattr(resampling, "WORDS", block)
    noise = random.Random(1).randbytes(3000).decode("latin1").encode()
    texts = [b"", b"One two THREE", "Zwölf Boxkämpfer 漢字 a_b".encode(), b"x" * 5000 + b" " + b"y" * 1024 + b" " + b"z" * 1023, noise, b"q" * (1 << 20), noise]
    for longest in (1, 2, 3):
        want = [(i, b) for i, t in enumerate(texts) for b in features_of(t.decode(), longest)[1]]
        got = [(int(o), int(b)) for owner, found in resampling.features(texts, longest, 10_000) for o, b in zip(owner, found, strict=True)]
        assert sorted(got) == sorted(want)
    assert resampling.gains(np.zeros(4, np.int64), np.zeros(4, np.int64)).tolist() == [0] * 4


def test_unfolding_in_parts(spark):
    frame = spark.createDataFrame([("a", 5, 1), ("b", 1, 25), ("c", 100, 7)], "k string, at long, n long")
    got = sorted((r.k, r.place) for r in unfolded(frame, "at", "n", "place", most=10).collect())
    assert got == sorted([("a", 5), *[("b", i) for i in range(1, 26)], *[("c", i) for i in range(100, 107)]])
