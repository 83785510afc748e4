import zlib

import numpy as np
from pyspark.sql import functions as F

from packetlens.llm import language

SF = "/root/testdata/sf0.01"
IDS = ["doc_id"]


def rows_of(frame):
    return frame.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language.identify(rows_of(docs), docs, IDS).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(found) == len(truth) and len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 < r.posterior <= 1 + 1e-9 for r in found)


def test_pages_and_parts_of_an_address(spark):
    pages = spark.createDataFrame([
        (1, "https://u@m.site.example.co:8080/fr/1?x=2#y", "<!DOCTYPE html><HTML class=a lang='FR-ca'><script>var t='</p>'</script><b>Bon &amp; jour</b><!-- x --></html>"),
        (2, None, None), (3, "not a url", "<html><p>x"),
    ], "page_id long, url string, html string")
    found = {r.page_id: (" ".join(r.text.split()), r.declared, r.host) for r in language.page_texts(pages).collect()}
    assert found == {1: ("Bon & jour", "fr", "m.site.example.co"), 2: ("", None, None), 3: ("x", None, None)}


def test_evidence_decides_where_the_text_does_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    de = [r.text for r in docs.filter("lang = 'de'").limit(40).collect()]
    en = [r.text for r in docs.filter("lang = 'en'").limit(40).collect()]
    rows = [(i, t, "de", f"h{i % 3}.a.de") for i, t in enumerate(de)] + [(100 + i, t, "en", f"h{i % 3}.b.com") for i, t in enumerate(en)]
    rows += [(200, "", "de", None), (201, None, None, "h1.b.com"), (202, "", None, "new.a.de"), (203, "", "xx", "h0.a.de"), (204, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string")
    found = {r.doc_id: r for r in language.identify(frame, docs, IDS).collect()}
    assert [found[i].predicted for i in (200, 201, 202, 203)] == ["de", "en", "de", "de"]
    assert all(found[i].text_lang is None for i in range(200, 205)) and len(found) == len(rows)
    assert found[203].declared == "other" and found[204].posterior <= 1


def test_trigram_counts_against_brute_force(spark, docs):
    texts = docs[0].select("doc_id", "text", "lang")
    names, model = language.train(texts)
    want = {name: np.full(language.BUCKETS, 0.5) for name in names}
    for r in docs[1]:
        data = b" " + b" ".join(r.text.encode().lower().split()) + b" "
        for i in range(len(data) - 2):
            mixed = int.from_bytes(data[i : i + 3], "big") * 2654435761 % 2**32 >> 18
            want[r.lang][mixed] += 1
    for name, own in zip(names, model, strict=True):
        assert np.allclose(own, np.log(want[name] / want[name].sum()))


def test_odd_rows(spark, odd, empty, docs):
    found = language.identify(rows_of(odd), docs[0], IDS).collect()
    assert len(found) == odd.count()
    assert language.identify(rows_of(empty), docs[0], IDS).collect() == []
    none = language.identify(rows_of(odd), docs[0].withColumn("lang", F.lit(None).cast("string")), IDS).collect()
    assert len(none) == odd.count() and not any(r.predicted for r in none)


def test_more_languages_than_tables(spark, monkeypatch):
    rows = [(f"l{i:02d}", f"word{i} " * (5 + i)) for i in range(70) for _ in range(2 if i < 60 else 1)]
    texts = spark.createDataFrame(rows, "lang string, text string")
    names, model = language.train(texts)
    assert len(names) == 70 and model.shape == (70, language.BUCKETS)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 60)
    names, model = language.train(texts)
    assert names == [*[f"l{i:02d}" for i in range(60)], "other"]
