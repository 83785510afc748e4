"""Toxicity by a convolutional text classifier, trained here in numpy.

A word is the sum of hashed embeddings of itself and of its first four and five characters, so that unseen
endings of a known stem are covered. Filters one, two and three words wide run over the whole text; each
filter's largest response (never below zero) is kept, and a logistic layer turns them into a score. Only the
text is an input. The weights are learned from a bounded sample of labelled rows, in one task. All labelled rows of
another fold, which the weights never see, set the threshold of each language: they are scored and counted by bins.

Defined cases: null and empty texts have no response, so their score is the model's bias; null labels and
ids are not learned from; a null or unknown language, or one without a toxic row in that fold, takes the threshold of all; without any labelled row the
score is 0 for all; equal rows are each returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import encoded, fold_of, record, sampled, slices, stored

MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_"


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows that are learned from, `steps` the descent (`batch` rows each)."""

    buckets: int = 1 << 15
    size: int = 16
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    sample: int = 6000
    steps: int = 2000
    batch: int = 16
    rate: float = 0.1
    seed: int = 7


def word_ids(words: list[bytes], buckets: int) -> np.ndarray:
    """Three buckets of each word; the rows of a word do not depend on the text around it."""
    out = np.empty((len(words), 3), np.int32)
    crc = zlib.crc32
    for i, raw in enumerate(words):
        word = raw.decode(errors="replace").lower().strip(MARKS)
        out[i] = crc(word.encode()) % buckets, crc(b"4" + word[:4].encode()) % buckets, crc(b"5" + word[:5].encode()) % buckets
    return out


class Model:
    """Weights: embeddings, for each width an array (place in the window, size, filter), the logistic layer."""

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.settings = settings
        self.words = rng.normal(0, 0.05, (settings.buckets, settings.size)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, settings.size, settings.filters)).astype(np.float32) for w in settings.widths]
        self.out = rng.normal(0, 0.3, settings.filters * len(settings.widths)).astype(np.float32)
        self.bias = np.float32(-2)

    def respond(self, x: np.ndarray) -> np.ndarray:
        """Response of each filter at each place of a text of word vectors; the text ends in zeros."""
        parts = []
        for taps in self.filters:
            padded = np.concatenate([x, np.zeros((len(taps) - 1, x.shape[1]), np.float32)])
            parts.append(sum(padded[k : k + len(x)] @ taps[k] for k in range(len(taps))))
        return np.concatenate(parts, axis=1)

    def train(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Adagrad on the log loss; the gradient passes the places that won the maximum alone."""
        s = self.settings
        rng = np.random.default_rng(s.seed + 1)
        params = [self.words, *self.filters, self.out]
        squares = [np.full_like(p, 1e-3) for p in params]
        bias_square = 1e-3
        for _ in range(s.steps):
            grads = [None, *[np.zeros_like(f) for f in self.filters], np.zeros_like(self.out)]
            rows, parts, bias_grad = [], [], 0.0
            for t in rng.integers(0, len(texts), s.batch):
                ids = texts[t]
                if not len(ids):
                    bias_grad += 1 / (1 + np.exp(-self.bias)) - labels[t]
                    continue
                x = self.words[ids].sum(axis=1)
                response = self.respond(x)
                place = response.argmax(axis=0)
                best = response[place, np.arange(response.shape[1])]
                pooled = np.maximum(best, 0)
                error = float(1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30))) - labels[t])
                bias_grad += error
                grads[-1] += error * pooled
                back = error * self.out * (best > 0)
                for n, taps in enumerate(self.filters):
                    mine = slice(n * s.filters, (n + 1) * s.filters)
                    for k in range(len(taps)):
                        at = place[mine] + k
                        inside = at < len(x)
                        if inside.any():
                            g = back[mine][inside]
                            grads[n + 1][k][:, inside] += x[at[inside]].T * g
                            rows.append(ids[at[inside]])
                            parts.append(np.repeat((taps[k][:, inside] * g).T[:, None], 3, axis=1))
            if rows:
                row, part = np.concatenate(rows).ravel(), np.concatenate(parts).reshape(-1, s.size)
                touched, inverse = np.unique(row, return_inverse=True)
                total = np.zeros((len(touched), s.size), np.float32)
                np.add.at(total, inverse, part / s.batch)
                squares[0][touched] += total**2
                self.words[touched] -= s.rate * total / np.sqrt(squares[0][touched])
            for p, q, g in zip(params[1:], squares[1:], grads[1:], strict=True):
                g = g / s.batch
                q += g * g
                p -= 0.5 * s.rate * g / np.sqrt(q)
            bias_square += (bias_grad / s.batch) ** 2
            self.bias -= np.float32(0.5 * s.rate * bias_grad / s.batch / np.sqrt(bias_square))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts. Each distinct word meets the filters once; places only add up its responses."""
        s = self.settings
        found = [t.split() for t in texts]
        known: dict[bytes, int] = {}
        flat = [known.setdefault(w, len(known) + 1) for words in found for w in words]
        table = self.words[word_ids(list(known), s.buckets)].sum(axis=1)
        table = np.concatenate([np.zeros((1, s.size), np.float32), table])
        taps = [table @ f[k] for f in self.filters for k in range(len(f))]
        pad = max(s.widths)
        sizes = np.array([len(words) for words in found])
        starts = np.concatenate([[0], np.cumsum(sizes + pad)])
        places = np.zeros(starts[-1] + pad, np.int64)
        inside = np.arange(len(flat)) + np.repeat(np.arange(len(found)) * pad, sizes)
        places[inside] = flat
        pooled, tap = [], 0
        for width in s.widths:
            response = np.zeros((starts[-1], s.filters), np.float32)
            for k in range(width):
                response += taps[tap][places[k : k + starts[-1]]]
                tap += 1
            response[places[: len(response)] == 0] = 0
            pooled.append(np.maximum.reduceat(response, starts[:-1], axis=0))
        logit = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def dump(self) -> bytes:
        return b"".join(a.astype("<f4").tobytes() for a in (self.words, *self.filters, self.out, np.atleast_1d(self.bias)))

    def load(self, data: bytes) -> Model:
        at, values = 0, np.frombuffer(data, "<f4")
        for a in (self.words, *self.filters, self.out):
            a[...] = values[at : at + a.size].reshape(a.shape)
            at += a.size
        self.bias = values[at]
        return self


BINS = 1 << 12


def _threshold(bins: np.ndarray, label: np.ndarray, n: np.ndarray) -> float:
    """The gap between bins of scores with the best F1, the nearest to 0.3 of equals; in it, what is nearest to 0.3 of its inner half.

    Bin b holds `n` scores of a label from b / BINS to below (b + 1) / BINS; each cut lies between two bins.
    """
    used, place = np.unique(bins, return_inverse=True)
    toxic, every = np.bincount(place, n * label), np.bincount(place, n)
    hit, above = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (toxic, every))
    start, end = np.concatenate([[0], (used + 1) / BINS]), np.concatenate([used / BINS, [1]])
    end = np.maximum(start, end)
    cuts = np.clip(0.3, start * 0.75 + end * 0.25, start * 0.25 + end * 0.75)
    f1 = 2 * hit / (above + toxic.sum())
    return float(np.clip(cuts[np.lexsort((np.abs(cuts - 0.3), -f1))[0]], 0.05, 0.95))


def _cut(table: pa.Table) -> pa.Table:
    bins, label, n = table["bin"].to_numpy(), table["_toxic"].to_numpy() == 1, table["n"].to_numpy()
    cuts = [_threshold(bins, label, n)] if label.any() else []
    return pa.table({"name": table["name"][: len(cuts)], "cut": pa.array(cuts, pa.float64())})


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 4, held_out: int = 2) -> tuple[Model, dict[str | None, float]]:
    """The model, and thresholds by language (None: of all). Rows whose fold is `held_out` are not read.

    All labelled rows of fold `held_out` - 1 set thresholds, a sample of the rest the weights.
    """
    marked = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna().distinct()
    check = (held_out - 1) % folds
    learned = marked.filter(~fold_of(F.col("_id"), folds).isin(held_out, check))
    sample = learned.filter(sampled(F.col("_id"), settings.sample, learned.count()))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    rows = texts.join(sample, F.col("_doc") == F.col("_id")).select("text", "_toxic", "_doc")

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table["_doc"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        label = table["_toxic"].to_numpy()
        model = Model(settings)
        if label.any():
            model.train([word_ids((x or b"").split(), settings.buckets) for x in table["text"].cast(pa.binary()).to_pylist()], label)
        else:
            model.bias = np.float32(-30)
        return pa.table({"weights": pa.array([model.dump()], pa.binary())})

    # one task holds the sample, whose size `settings.sample` bounds
    found = rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(fit, "weights binary").first()
    if found is None:
        model = Model(settings)
        model.bias = np.float32(-30)
        return model, {None: 0.3}
    model = Model(settings).load(bytes(found["weights"]))
    weights = docs.sparkSession.sparkContext.broadcast(model.dump())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(settings).load(weights.value)
        schema = pa.schema([("_doc", pa.int64()), ("lang", pa.string()), ("bin", pa.int32())])
        for batch in slices(batches):
            bins = np.floor(own.score(encoded(batch)) * BINS).astype(np.int32)
            yield record(schema, [batch.column("_doc"), batch.column("lang"), bins])

    # texts stay where they are: the fold is chosen by id and only scores meet the labels
    scored = texts.filter(fold_of(F.col("_doc"), folds) == check).mapInArrow(judge, "_doc long, lang string, bin int")
    cells = scored.join(marked, F.col("_doc") == F.col("_id")).groupBy(F.coalesce("lang", F.lit("")).alias("name"), "_toxic", "bin").agg(F.count(F.lit(1)).alias("n"))
    cells = stored(cells)
    pooled = cells.groupBy("_toxic", "bin").agg(F.sum("n").alias("n")).select(F.lit("").alias("name"), "_toxic", "bin", "n")
    cuts = cells.filter("name <> ''").union(pooled).groupBy("name").applyInArrow(_cut, "name string, cut double").collect()
    return model, {None: 0.3} | {r["name"] or None: r["cut"] for r in cuts}


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 4, held_out: int = 2, carry: list[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, threshold, rejected) of each row; `rejected` goes by the language's threshold.

    Columns of `docs` named in `carry` are added, each under its name after an underscore.
    """
    model, cuts = train(docs, labels, settings, folds, held_out)
    weights = docs.sparkSession.sparkContext.broadcast(model.dump())  # of the size that the settings fix
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"), *[F.col(c).alias(f"_{c}") for c in carry])
    more = "".join(f", _{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    names = [f"_{c}" for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(settings).load(weights.value)
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("threshold", pa.float64())])
        for batch in slices(batches):
            limits = [cuts.get(x, cuts[None]) for x in batch.column("lang").to_pylist()]
            found = record(schema, [batch.column("doc_id"), own.score(encoded(batch)), limits])
            yield pa.RecordBatch.from_arrays([*found.columns, *[batch.column(c) for c in names]], names=[*schema.names, *names])

    scored = texts.mapInArrow(run, f"doc_id long, score double, threshold double{more}")
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "threshold",
        (F.col("score") >= F.col("threshold")).alias("rejected"), *names,
    )
