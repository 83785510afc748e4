import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetlens.llm import lm

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = lm.Settings(steps=60, head=300)


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0d]+", lower), ""]


def base_by_hand(rows):
    counts = Counter()
    for r in rows:
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 != 2:
            counts.update(tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        own = tokens(r.text)
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        out.append((str(r.doc_id), len(own), sum(counts[w] > 0 for w in own), total, round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("head", [0, 300, 1 << 17])
def test_base_against_brute_force(docs, odd, head):
    for frame in (docs[0], odd):
        found = lm.score_texts(frame, PATH, lm.Settings(steps=5, head=head)).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == base_by_hand(frame.collect())
        assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_empty_and_untrained(empty, odd):
    assert lm.score_texts(empty, PATH, SMALL).collect() == []
    none = odd.filter("false").union(odd.limit(1).withColumn("doc_id", F.lit(9).cast("long")))  # fold 2 of 7 or not, one empty text
    assert len(lm.score_texts(none, PATH, SMALL).collect()) == 1


def model_of(docs):
    texts = [lm.words_of(r.text.encode()) for r in docs[1]]
    ids = lm.subwords(texts, PATH)
    model = lm.Model(lm.Settings(steps=300), lm._vocabulary(PATH))
    model.cluster(ids[:150])
    model.train(ids[:150])
    seen, n = np.unique(np.concatenate(ids[:150]), return_counts=True)
    model.count(seen, n)
    return model, ids


def test_probabilities_windows_and_gain(docs):
    model, ids = model_of(docs)
    # classes and ids within them are distributions
    mass = np.bincount(model.kind, np.exp(model.within), minlength=model.settings.classes + 2)
    assert np.allclose(mass[np.unique(model.kind)], 1)
    # each id is scored once: by hand, from the window that first reaches it
    held = ids[150:]
    got = model.score(held)
    for text, score in zip(held[:20], got, strict=False):
        seq = np.r_[model.end, text, model.end]
        total, place = 0.0, 0
        while place < len(seq) - 1:
            start = 0 if place < lm.WINDOW else (place - lm.WINDOW) // lm.STRIDE * lm.STRIDE + lm.STRIDE
            part = seq[start : place + 1]
            rows = model.row[np.r_[part, np.full(lm.WINDOW - len(part), part[-1])]][None]
            logs = model.log_classes(model.forward(rows)[0][len(part) - 1 : len(part)])[0]
            total += logs[model.kind[seq[place + 1]]] + model.within[seq[place + 1]]
            place += 1
        assert abs(total / lm.LN10 - score) < 1e-3 * abs(score)
    # a batch does not change a score
    assert np.allclose(got, [model.score([t])[0] for t in held], rtol=1e-4)
    # better than counts of ids alone
    flat = np.concatenate(ids[:150])
    unigram = np.log10((np.bincount(flat, minlength=model.end + 1) + 1) / (len(flat) + model.end + 1))
    assert got.sum() > 0.9 * sum(unigram[t].sum() for t in held)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    model = lm.Model(lm.Settings(own=8, classes=4, size=4, hidden=6), 10)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows, target, weight = rng.integers(0, 8, (3, lm.WINDOW)), rng.integers(0, 6, (3, lm.WINDOW)), rng.integers(0, 2, (3, lm.WINDOW)).astype(float)
    _, found = model.gradients(rows, target, weight)
    for name, value in model.p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in value.shape)
            value[at] += 1e-5
            more = model.gradients(rows, target, weight)[0]
            value[at] -= 2e-5
            less = model.gradients(rows, target, weight)[0]
            value[at] += 1e-5
            assert abs((more - less) / 2e-5 - found[name][at]) < 1e-6


def test_causal(docs):
    model, ids = model_of(docs)
    rows = model.row[np.resize(ids[0], lm.WINDOW)][None].copy()
    before = model.forward(rows)[0]
    rows[0, 20:] = 3
    assert np.allclose(before[:20], model.forward(rows)[0][:20], atol=1e-5)


def test_dump(docs):
    model, ids = model_of(docs)
    again = lm.Model(model.settings, model.end).load(model.dump())
    assert np.array_equal(again.score(ids[:5]), model.score(ids[:5]))


def test_scoring_pass_is_the_training_pass():
    """Scores by look-up tables equal those of `forward`, also for weights whose exponentials overflow."""
    settings = lm.Settings(own=64, classes=8)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 100, n) for n in (0, 1, 31, 32, 33, 200)]
    for factor in (1, 40):
        model = lm.Model(settings, 100)
        model.cluster(texts)
        model.p["qkv"], model.p["read"] = model.p["qkv"] * factor, model.p["read"] * factor
        read, starts, stops = model.windows(texts)
        want, seen = np.zeros(len(texts)), np.full(len(texts), -1)
        ends = np.unique(stops).tolist()
        for a, b in zip(starts, stops, strict=True):
            ids, target, inside = model.cut(read, np.array([a]), np.array([b]))
            logs = model.log_classes(model.forward(model.row[ids])[0])
            text = ends.index(b)
            for k in range(lm.WINDOW):
                if inside[0, k] and a + k > seen[text]:
                    want[text] += logs[k, model.kind[target[0, k]]] + model.within[target[0, k]]
                    seen[text] = a + k
        assert np.allclose(model.score(texts), want / lm.LN10, rtol=1e-4)


def test_windows_come_from_anywhere_and_grow_with_the_corpus(spark):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    frame = spark.createDataFrame([(1, long), (2, "a few words"), (None, None)], "doc_id long, text string").repartition(2)
    ids = lm.subwords([lm.words_of(long.encode())], PATH)[0]
    settings = lm.Settings(shard_ids=20_000, shard_windows=100)
    found, shards = lm.sampled_windows(frame, PATH, settings, len(ids), 3)
    rows = found.collect()
    assert shards == round(len(ids) / 20_000) and {r.shard for r in rows} == set(range(shards))
    assert 60 * shards < len(rows) < 140 * shards and max(len(r.ids) for r in rows) == lm.WINDOW + 1
    assert sorted(map(str, rows)) == sorted(map(str, lm.sampled_windows(frame.repartition(5), PATH, settings, len(ids), 3)[0].collect()))
    # windows of the last tenth of a text are as likely as any
    text = np.r_[ids, lm._vocabulary(PATH)].tobytes()
    late = sum(text.find(np.array(r.ids, ids.dtype).tobytes()) > 0 for r in rows)
    assert late >= 0.9 * len(rows) - 3
    every, one = lm.sampled_windows(frame, PATH, lm.Settings(), len(ids), 3)
    model = lm.Model(settings, lm._vocabulary(PATH))
    texts = [ids, lm.subwords([[b"a", b"few", b"words"]], PATH)[0], ids[:0]]
    assert one == 1 and every.count() == len(model.windows(texts)[1])


def test_weights_are_the_mean_of_the_shards(spark, docs):
    """With several shards the model learns as well; the order of rows does not matter."""
    ids = [x for x in lm.subwords([lm.words_of(r.text.encode()) for r in docs[1]], PATH)]
    seen, n = np.unique(np.concatenate(ids), return_counts=True)
    settings = lm.Settings(shard_ids=int(n.sum()) // 3, shard_windows=2000, steps=200)
    model = lm.train(docs[0], PATH, seen, n, len(ids), settings)
    again = lm.train(docs[0].repartition(3), PATH, seen, n, len(ids), settings)
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-6) for k in model.p)
    plain = lm.Model(settings, lm._vocabulary(PATH))
    plain.kind, plain.row, plain.within = model.kind, model.row, model.within
    assert model.score(ids).sum() > plain.score(ids).sum() and np.isfinite(model.score(ids)).all()


def test_every_id_is_learned_from_in_one_round(spark, docs):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, long), (2, "a few words"), (3, ""), (None, None), (5, long), (5, long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    texts = lm.subwords([lm.words_of((t or "").encode()) for _, t in rows], PATH)
    end = lm._vocabulary(PATH)
    settings, want, got, shards = lm.Settings(), Counter(), Counter(), set()
    for text in texts:
        want.update([*text.tolist(), end])
    for turn in range(settings.rounds):
        found = lm.pieces(frame, PATH, settings, 7, turn).collect()
        read, starts, stops = lm._piece_windows([bytes(r.ids) for r in found], lm._narrow(end))
        ids, target, inside = lm.Model(settings, end).cut(read, starts, stops)
        got.update(target[inside].tolist())
        shards |= {r.shard for r in found}
        assert all(len(r.ids) // 2 <= lm.PIECE + 1 for r in found)
    assert got == want and shards == set(range(7))
    # neighbours are counted over all texts
    top = np.array([x for x, _ in Counter(texts[0].tolist()).most_common(40)])
    place, context = lm._places(top, end)
    table = np.zeros((len(top), 2 * lm.CONTEXTS))
    for text in texts:
        read = [end, *text.tolist(), end]
        for before, at, after in zip(read, read[1:], read[2:], strict=False):
            if place[at] >= 0:
                table[place[at], context[before]] += 1
                table[place[at], lm.CONTEXTS + context[after]] += 1
    assert np.array_equal(lm.context_counts(frame, PATH, top, end), table)


def test_no_setting_leaves_windows_out(docs):
    ids = lm.subwords([lm.words_of(r.text.encode()) for r in docs[1]], PATH)
    seen, n = np.unique(np.concatenate(ids), return_counts=True)
    one, all_ = (lm.train(docs[0], PATH, seen, n, len(ids), lm.Settings(shard_ids=20_000, shard_windows=k, steps=20)) for k in (1, 10**6))
    assert all(np.array_equal(one.p[k], all_.p[k]) for k in one.p)


def test_words_are_read_as_one_at_a_time():
    odd = ["", None, "  A\u00a0b\t\x1cC d's  'S it's\x0b", "x" * 500 + " 12 345 \u2028 \u3000\u0085 end\n", "\x00 \u00c4\u00d6 \U0001f600\U0001f600", "a b a B\rc"]
    every = [*odd, *[" ".join(f"w{i % 90}.,{i}" for i in range(n)) for n in (1, 30, 3000)]]
    words = [lm.words_of((t or "").encode()) for t in every]
    found, many = lm.parted(pa.array(every, pa.string()))
    assert found.cast(pa.binary()).to_pylist() == sum(words, []) and many.tolist() == list(map(len, words))
    for head in ([], ["a", "b", "w1.,1", "never"]):
        lexicon = lm.Lexicon(PATH, pa.array(head, pa.string()))
        kept = len(lexicon.pool)
        for texts in (every[:4], every[4:], odd[1:2], every):  # slices with white space inside words and without
            read = lexicon.read(pa.array(texts, pa.string()))
            want = lm.subwords([lm.words_of((t or "").encode()) for t in texts], PATH)
            assert [read.ids[a:b].tolist() for a, b in zip(read.bounds, read.bounds[1:], strict=False)] == [x.tolist() for x in want]
            names = [*head, *read.rare.to_pylist()]
            assert [names[i].encode() for i in read.at] == sum((lm.words_of((t or "").encode()) for t in texts), [])
        assert len(lexicon.pool) == kept  # what a task holds does not grow with its texts
    assert lexicon.encoded(pa.array(["a"] * 50, pa.string()), most=7)[1].tolist() == [1] * 50


def test_training_needs_ids_alone(spark, docs):
    """Ids that were read once give the weights that texts give."""
    texts = lm.subwords([lm.words_of(r.text.encode()) for r in docs[1]], PATH)
    seen, n = np.unique(np.concatenate(texts), return_counts=True)
    settings = lm.Settings(shard_ids=int(n.sum()) // 2, steps=20)
    read = lm.keyed_ids(docs[0], PATH, settings)
    assert read.columns == ["key", "ids"]
    kind = lm._narrow(lm._vocabulary(PATH))
    assert sorted(np.frombuffer(r.ids, kind).tolist() for r in read.collect()) == sorted(t.tolist() for t in texts)
    one, other = (lm.train(x, PATH, seen, n, len(texts), settings) for x in (docs[0], read))
    assert all(np.array_equal(one.p[k], other.p[k]) for k in one.p)
