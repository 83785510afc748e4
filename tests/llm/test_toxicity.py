import zlib

from packetlens.llm import toxicity

SF = "/root/testdata/sf0.1"


def fold(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 4


def test_held_out_accuracy_and_odd_rows(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (fold(r.doc_id) == 2) and 0 <= r.score <= 1 for r in found)
    judged = [(r.score >= 0.3, r.rejected, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    for which in (0, 1):
        hit = sum(x[which] and x[2] for x in judged)
        assert 2 * hit / (sum(x[which] for x in judged) + sum(x[2] for x in judged)) > 0.9
    model, cuts = toxicity.train(docs, labels)
    assert None in cuts and all(0 < c < 1 for c in cuts.values())
    # a score depends on the text alone: pieces of a batch score as each text by itself
    texts = [(r.text or "").encode() for r in odd.collect()]
    assert abs(model.score(texts) - [model.score([t])[0] for t in texts]).max() < 1e-5
    assert toxicity.Model(model.settings).load(model.dump()).dump() == model.dump()


def test_without_labels(odd, empty, spark):
    labels = spark.createDataFrame([(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == odd.count() and not any(r.rejected for r in found)
    assert toxicity.toxicity(empty, labels).collect() == []


def test_thresholds_cover_all_labelled_rows(spark):
    """A small sample for the weights leaves no language's toxic rows out of its threshold."""
    rows = [(i, "you idiot fool" if i % 3 == 0 else "a fine day", "en" if i % 40 else "is") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(2400)], "doc_id long, toxic int")
    settings = toxicity.Settings(buckets=256, sample=30, steps=200)
    assert set(toxicity.train(docs, labels, settings)[1]) == {None, "en", "is"}


def test_threshold_from_bins_is_the_best_cut():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        label = rng.integers(0, 2, 60)
        bins = np.floor(np.clip(rng.normal(0.35 + 0.2 * label, 0.15), 0, 0.999) * toxicity.BINS).astype(int)
        cut = toxicity._threshold(bins, label, np.ones(60))

        def f1(c, bins=bins, label=label):
            over = bins / toxicity.BINS >= c
            return 2 * (over & (label == 1)).sum() / (over.sum() + label.sum())

        assert f1(cut) >= max(f1(c) for c in np.unique(bins) / toxicity.BINS if 0.05 <= c <= 0.95) - 1e-12
