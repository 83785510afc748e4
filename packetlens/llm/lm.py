"""Scores of texts by a causal self-attention model, trained here in numpy, and by smoothed word counts.

The model reads the subword ids of a text's lower-cased words. It predicts the class of the next id from a window of ids before it (one attention
layer, one hidden layer) and the id within its class from counts over the whole training corpus, so every text
has a probability. Windows overlap: each id is scored once, with at least `WINDOW - STRIDE` ids of context
unless the text is younger than that; a batch of windows is one masked attention.

Weights are learned from all training texts: each id of each text, and each end, is predicted once in a pass. Texts are cut to pieces, which
are dealt to shards, as many as the corpus asks for. A round takes its part of the texts: each shard's task takes the weights on
by steps of descent over all windows of its pieces, and the mean over the windows is where the next round starts. Classes come from what
stands before and after the frequent ids in all training texts.

Texts are cut to words twice: for the word counts, and once the frequent words are known, for the subword ids of every text. These are stored
and serve the classes, the rounds and the score. A task keeps ids of the frequent words only, and encodes others slice by slice.

Word counts cover every training text. The most frequent words, at most `head` of them, travel to all tasks;
of all other words each text sends its own counts to a join. So no frequent word is a hot key.

Defined cases: null and empty texts are the end token alone; rows without training texts score by the untrained
model and by counts of zero; null ids are in the fold of the empty text; equal rows are each returned; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.bpe import codec
from packetlens.llm.common import Recent, encoded, fold_of, keyed_texts, record, slices, stored

WINDOW, STRIDE = 32, 24
LN10 = np.log(10)


@dataclass(frozen=True)
class Settings:
    """`shard_ids` is how many ids a shard learns from, `steps` how many steps it makes at least: a small shard is passed more than once.
    `head` bounds the words that are broadcast, `shard_windows` the windows of a shard in `sampled_windows`."""

    size: int = 16
    hidden: int = 32
    own: int = 2048  # ids with an embedding of their own; the rest share their class's
    classes: int = 64
    shard_ids: int = 8_000_000
    shard_windows: int = 40_000
    rounds: int = 2
    steps: int = 1200  # of a shard at least, over all rounds
    batch: int = 64
    rate: float = 0.004
    seed: int = 11
    head: int = 1 << 17
    head_bytes: int = 64


#: Contexts that are told apart: the most frequent ids, the end, all others.
CONTEXTS = 256


def _places(top: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id its place in `top` (-1: none) and its context."""
    place = np.full(end + 1, -1)
    place[top] = np.arange(len(top))
    context = np.full(end + 1, CONTEXTS - 1)
    context[top[: CONTEXTS - 2]] = np.arange(len(top[: CONTEXTS - 2]))
    context[end] = CONTEXTS - 2
    return place, context


def _steady(x: np.ndarray, mask: np.ndarray | None = None, most: float = 40) -> np.ndarray:
    """`x`, less the greatest of each row (under `mask`) where its exponentials could leave single precision; their ratios stay."""
    if x.size and max(x.max(), -x.min()) > most:
        if mask is not None:
            x += mask
        x -= x.max(axis=-1, keepdims=True)
    return x


class Model:
    """`vocabulary` ids and the end token, which is the next number. Class 0 is the end alone, the last one the rare ids."""

    def __init__(self, settings: Settings, vocabulary: int):
        rng = np.random.default_rng(settings.seed)
        s, d = settings, settings.size
        self.settings, self.end = s, vocabulary
        self.kind = np.full(vocabulary + 1, s.classes + 1, np.int64)
        self.kind[self.end] = 0
        self.row = s.own + self.kind  # embedding of each id
        self.within = np.zeros(vocabulary + 1)

        def start(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.p = {
            "embed": rng.normal(0, 0.3, (s.own + s.classes + 2, d)).astype(np.float32), "place": rng.normal(0, 0.1, (WINDOW, d)).astype(np.float32),
            "qkv": start(d, 3 * d), "out": start(d, d), "up": start(d, s.hidden), "up_b": np.zeros(s.hidden, np.float32),
            "down": start(s.hidden, d), "read": start(d, s.classes + 2), "read_b": np.zeros(s.classes + 2, np.float32),
        }
        self.mask = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)
        self.seen = np.tri(WINDOW, dtype=np.float32)

    # classes of ids

    def cluster(self, texts: list[np.ndarray]) -> None:
        """Classes of the frequent ids of texts that are at hand."""
        flat = np.concatenate([np.r_[self.end, t] for t in texts]) if texts else np.zeros(0, np.int64)
        n = np.bincount(flat, minlength=self.end + 1)
        n[self.end] = 0
        order = np.argsort(-n, kind="stable")

        def contexts(top: np.ndarray) -> np.ndarray:
            place, context = _places(top, self.end)
            table = np.zeros((len(top), 2 * CONTEXTS), np.float32)
            known = place[flat[1:-1]] >= 0
            at = place[flat[1:-1]][known]
            np.add.at(table, (at, context[flat[:-2]][known]), 1)
            np.add.at(table, (at, CONTEXTS + context[flat[2:]][known]), 1)
            return table

        self.group(order[n[order] > 0], contexts)

    def group(self, order: np.ndarray, contexts) -> None:
        """Classes of the first ids of `order` (the most frequent first), by k-means over what `contexts` counts before and after them."""
        s = self.settings
        top = order[: s.own]
        table = contexts(top)
        table = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
        k = min(s.classes, len(top))
        centres = table[:k].copy()
        nearest = np.zeros(len(top), np.int64)
        for _ in range(12):
            if not k:
                break
            nearest = (table @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            for c in np.unique(nearest):
                centres[c] = table[nearest == c].mean(axis=0)
        self.kind[top] = 1 + nearest
        self.row = s.own + self.kind
        self.row[top] = np.arange(len(top))

    def count(self, ids: np.ndarray, n: np.ndarray) -> None:
        """Log probability of each id within its class, from counts of ids; one is added to each."""
        total = np.ones(self.end + 1)
        total[ids] += n
        mass = np.bincount(self.kind, total, minlength=self.settings.classes + 2)
        self.within = np.log(total / mass[self.kind])

    # forward and back

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, dict]:
        """Last hidden states (window, place, size) of embedding rows, and what the way back needs."""
        p, d = self.p, self.settings.size
        n = len(rows)
        x = p["embed"].take(rows, axis=0)
        x += p["place"]
        qkv = (p["embed"] @ p["qkv"]).take(rows, axis=0)  # rows are few, places many
        qkv += p["place"] @ p["qkv"]
        q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
        weight = np.matmul(q, k.transpose(0, 2, 1))
        weight *= np.float32(1 / np.sqrt(d))
        weight = _steady(weight, self.mask)
        np.exp(weight, out=weight)
        weight *= self.seen
        weight /= (weight @ np.ones(WINDOW, weight.dtype))[..., None]
        heard = np.matmul(weight, v).reshape(-1, d)
        h = x.reshape(-1, d) + heard @ p["out"]
        up = np.maximum(h @ p["up"] + p["up_b"], 0)
        return h + up @ p["down"], {"x": x, "q": q, "k": k, "v": v, "weight": weight, "heard": heard, "h": h, "up": up}

    def log_classes(self, state: np.ndarray) -> np.ndarray:
        logit = state @ self.p["read"] + self.p["read_b"]
        logit -= logit.max(axis=1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))

    def gradients(self, rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean log loss over places of weight 1, and its gradient."""
        p, d, n = self.p, self.settings.size, len(rows)
        last, m = self.forward(rows)
        flat, used = target.ravel(), weight.ravel() / max(weight.sum(), 1)
        at = np.arange(len(flat))
        back = last @ p["read"]
        back += p["read_b"]
        back = _steady(back)
        picked = back[at, flat]
        np.exp(back, out=back)
        mass = back @ np.ones(back.shape[1], back.dtype)
        loss = -float(((picked - np.log(mass)) * used).sum())
        back /= mass[:, None]
        back[at, flat] -= 1
        back *= used[:, None]
        g = {"read": last.T @ back, "read_b": np.ones(len(back), back.dtype) @ back}
        to_last = back @ p["read"].T
        g["down"] = m["up"].T @ to_last
        to_up = (to_last @ p["down"].T) * (m["up"] > 0)
        g["up"], g["up_b"] = m["h"].T @ to_up, to_up.sum(axis=0)
        to_h = to_last + to_up @ p["up"].T
        g["out"] = m["heard"].T @ to_h
        to_heard = (to_h @ p["out"].T).reshape(n, WINDOW, d)
        a = m["weight"]
        to_a = np.matmul(to_heard, m["v"].transpose(0, 2, 1))
        to_a -= np.einsum("nij,nij->ni", to_a, a)[..., None]
        to_a *= a
        to_a *= np.float32(1 / np.sqrt(d))
        to_score = to_a
        to_qkv = np.empty((n, WINDOW, 3 * d), to_score.dtype)
        np.matmul(to_score, m["k"], out=to_qkv[..., :d])
        np.matmul(to_score.transpose(0, 2, 1), m["q"], out=to_qkv[..., d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), to_heard, out=to_qkv[..., 2 * d :])
        to_qkv = to_qkv.reshape(-1, 3 * d)
        x = m["x"].reshape(-1, d)
        g["qkv"] = x.T @ to_qkv
        to_x = to_h + to_qkv @ p["qkv"].T
        g["place"] = to_x.reshape(n, WINDOW, d).sum(axis=0)
        g["embed"] = np.zeros_like(p["embed"])
        own = rows.ravel().astype(np.min_scalar_type(len(g["embed"])))  # the narrowest sorts fastest
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        g["embed"][own[first]] = np.add.reduceat(to_x[order], first)
        return loss, g

    def train(self, texts: list[np.ndarray]) -> list[float]:
        """Adam over all windows of texts that are at hand; returns the losses."""
        read, starts, stops = self.windows(texts)
        return self.learn(read, starts, stops, self.settings.steps, [self.settings.seed + 1], self.settings.rate)

    def learn(self, read: np.ndarray, starts: np.ndarray, stops: np.ndarray, steps: int, seed: list[int], most: float) -> list[float]:
        """Adam over all windows in random order, again until `steps` steps are made; returns the losses."""
        s = self.settings
        if not len(starts):
            return []
        rng = np.random.default_rng(seed)
        many = -(-len(starts) // s.batch)  # steps of a pass
        steps = -(-max(steps, many) // many) * many
        # all arrays in one, of which those of the model are parts
        every = np.concatenate([v.ravel() for v in self.p.values()])
        parts = np.split(every, np.cumsum([v.size for v in self.p.values()])[:-1])
        self.p = {k: part.reshape(v.shape) for (k, v), part in zip(self.p.items(), parts, strict=True)}
        first, second, spare, move = (np.zeros_like(every) for _ in range(4))
        losses = []
        for step in range(1, steps + 1):
            if step % many == 1 or many == 1:
                order = rng.permutation(len(starts))
            pick = order[(step - 1) % many :: many]
            ids, target, inside = self.cut(read, starts[pick], stops[pick])
            loss, g = self.gradients(self.row[ids], self.kind[target], inside.astype(np.float32))
            losses.append(loss)
            rate = most * min(1, 2 * (1 - step / (steps + 1)))
            slope = np.concatenate([g[k].ravel() for k in self.p])
            np.subtract(slope, first, out=spare)
            spare *= 0.1
            first += spare
            slope *= slope
            slope -= second
            slope *= 0.01
            second += slope
            np.sqrt(np.divide(second, 1 - 0.99**step, out=spare), out=spare)
            spare += 1e-8
            np.divide(first, 1 - 0.9**step, out=move)
            move *= rate
            move /= spare
            every -= move
        return losses

    # texts to windows

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts, each between two ends, in one array; start of each window; end of its text."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        read = np.concatenate([x for t in texts for x in ([self.end], t, [self.end])], dtype=np.int64)
        sizes = np.array([len(t) + 1 for t in texts])  # ids to predict
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        many = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
        of = np.repeat(np.arange(len(texts)), many)
        number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        return read, begin[of] + number * STRIDE, begin[of] + sizes[of]

    def cut(self, read: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids read, ids to predict, and whether a place is inside its text, (window, place) each."""
        at = starts[:, None] + np.arange(WINDOW)
        inside = at < stops[:, None]
        at = np.minimum(at, stops[:, None] - 1)
        return read[at], read[at + 1], inside

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring looks up for each embedding row: scaled query, key, value after the output layer.

        Values have a one more, which adds up weights and, divided by their sum, is the input of the biases.
        """
        p, d = self.p, self.settings.size
        q, k, v = np.split(p["qkv"], 3, axis=1)
        one = np.array([0] * d + [1], np.float32)
        scale = np.float32(1 / np.sqrt(d))

        def wide(x):
            return np.pad(x, ((0, 0), (0, 1)))

        return {
            "q": p["embed"] @ q * scale, "q_place": p["place"] @ q * scale, "k": p["embed"] @ k, "k_place": p["place"] @ k,
            "v": wide(p["embed"] @ v @ p["out"]), "v_place": wide(p["place"] @ v @ p["out"]) + one, "embed": wide(p["embed"]), "place": wide(p["place"]),
            "up": np.vstack([p["up"], p["up_b"]]), "down": wide(p["down"]), "read": np.vstack([p["read"], p["read_b"]]),
        }

    def log_kinds(self, tables: dict[str, np.ndarray], rows: np.ndarray, wanted: np.ndarray, skip: int) -> np.ndarray:
        """Log probability of the class `wanted` at each place of the windows from `skip` on, as `forward` has it."""
        d, late = self.settings.size, rows[:, skip:]
        q, k, v = (tables[n].take(r, axis=0) for n, r in (("q", late), ("k", rows), ("v", rows)))
        q += tables["q_place"][skip:]
        k += tables["k_place"]
        v += tables["v_place"]
        weight = _steady(np.matmul(q, k.transpose(0, 2, 1)), self.mask[skip:])
        np.exp(weight, out=weight)
        weight *= self.mask[skip:] == 0
        heard = np.matmul(weight, v).reshape(-1, d + 1)
        heard /= heard[:, d:].copy()
        h = tables["embed"].take(late, axis=0)
        h += tables["place"][skip:]
        h = h.reshape(-1, d + 1)
        h += heard
        up = h @ tables["up"]
        np.maximum(up, 0, out=up)
        h += up @ tables["down"]
        logit = _steady(h @ tables["read"])
        picked = logit[np.arange(len(logit)), wanted.ravel()]
        np.exp(logit, out=logit)
        return (picked - np.log(logit @ np.ones(logit.shape[1], np.float32))).reshape(wanted.shape)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text and its end.

        A text's first window scores all its places, a later one those that the window before did not reach.
        """
        read, starts, stops = self.windows(texts)
        out, tables = np.zeros(len(read)), self.tables()
        fresh = np.r_[True, stops[1:] != stops[:-1]][: len(starts)]
        for these, skip in ((np.flatnonzero(fresh), 0), (np.flatnonzero(~fresh), WINDOW - STRIDE)):
            for part in range(0, len(these), 128):
                some = these[part : part + 128]
                ids, target, inside = self.cut(read, starts[some], stops[some])
                target, inside = target[:, skip:], inside[:, skip:]
                logs = self.log_kinds(tables, self.row[ids], self.kind[target], skip)
                place = starts[some, None] + np.arange(skip, WINDOW)
                out[place[inside]] = logs[inside] + self.within[target[inside]]
        begin = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])[:-1]]).astype(np.int64)
        return np.add.reduceat(out, begin) / LN10 if len(texts) else np.zeros(0)

    def dump(self) -> dict[str, bytes]:
        return {k: v.tobytes() for k, v in self.p.items()} | {"kind": self.kind.tobytes(), "row": self.row.tobytes(), "within": self.within.tobytes()}

    def load(self, data: dict[str, bytes]) -> Model:
        for k, v in self.p.items():
            self.p[k] = np.frombuffer(data[k], np.float32).reshape(v.shape).copy()
        self.kind, self.row = np.frombuffer(data["kind"], np.int64), np.frombuffer(data["row"], np.int64)
        self.within = np.frombuffer(data["within"])
        return self


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec(path).ranks, special_tokens={})


WORDS: dict[str, Recent] = {}


def word_ids(path: str) -> Recent:
    """Subword ids of words, each after a space, kept for words already met; once per Python worker."""
    if path not in WORDS:
        encoding = _encoding(path)

        def compute(word: bytes) -> bytes:
            return array("i", encoding.encode_ordinary(" " + word.decode())).tobytes()

        WORDS[path] = Recent(compute, 300_000)
    return WORDS[path]


def subwords(texts: list[list[bytes]], path: str) -> list[np.ndarray]:
    """Ids of the words of each text; like the word counts, they do not tell kinds of white space apart."""
    of = word_ids(path).__getitem__
    return [np.frombuffer(b"".join(map(of, words)), np.int32) for words in texts]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


#: Bytes of text whose words are looked up together.
SLICE = 4 << 20


def released(run):
    """`run` over the batches of a task, after which the worker gives back what Arrow held for it: workers wait for their next task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as `words_of` has them, in one array, and how many each text has. Null is the empty text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space before the first word or after the last parts an empty one
    of = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy())[real.to_numpy(zero_copy_only=False)]
    return words.filter(real), np.bincount(of, minlength=len(parts))


@dataclass(frozen=True)
class Read:
    """Words of some texts: `many` of each text, place `at` each in the words of the head and then those of `rare`; all ids, of a text between two `bounds`."""

    many: np.ndarray
    at: np.ndarray
    rare: pa.Array
    ids: np.ndarray
    bounds: np.ndarray


class Lexicon:
    """Subword ids of words: those of `head` are kept, others are encoded for each slice of texts in which they are."""

    def __init__(self, path: str, head: pa.Array):
        self.encode, self.encoding, self.head = word_ids(path).compute, _encoding(path), head
        self.leads = np.array([x[:1] == b" " for x in codec(path).tokens])
        self.pool, self.sizes = self.encoded(head)

    def encoded(self, words: pa.Array, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all `words` and how many each has. As one text, in which every space begins a word, unless a word holds white space."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part in range(0, len(words), most):
            some = words.slice(part, most)
            text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            if re.search(r"[^\S ]", text):
                found = [np.frombuffer(self.encode(w), np.int32) for w in some.cast(pa.binary()).to_pylist()]
                ids += found
                sizes.append(np.array(list(map(len, found))))
            else:
                ids.append(np.array(self.encoding.encode_ordinary(text), np.int32))
                sizes.append(np.diff(np.flatnonzero(self.leads[ids[-1]]), append=len(ids[-1])))
        return np.concatenate(ids), np.concatenate(sizes)

    def read(self, texts: pa.Array) -> Read:
        words, many = parted(texts)
        coded = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(known < 0)
        known[new] = len(self.head) + np.arange(len(new))
        rare = coded.dictionary.take(pa.array(new))
        at = known[coded.indices.to_numpy(zero_copy_only=False)]
        pool, sizes = self.encoded(rare)
        pool, sizes = np.concatenate([self.pool, pool]), np.concatenate([self.sizes, sizes])
        begin, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(begin - total[:-1], size)
        place += np.arange(total[-1])
        return Read(many, at, rare, pool[place], total[np.concatenate([[0], np.cumsum(many)])])


def sampled_windows(docs: DataFrame, path: str, settings: Settings, total_ids: int, total_texts: int) -> tuple[DataFrame, int]:
    """(shard, ids) of some windows, each with the id after it, and the number of shards. For a look at a corpus: `train` learns from all.

    There is a shard for each `shard_ids` ids of the corpus, with about `shard_windows` windows. A hash chooses texts and then their
    windows, from any place of a text, so that every place of the corpus has the same chance.
    """
    s = settings
    shards = max(1, round(total_ids / s.shard_ids))
    share = min(1.0, shards * s.shard_windows / max(1, total_ids / STRIDE + total_texts))
    chosen = min(1.0, 8 * share)
    texts = keyed_texts(docs).withColumn("key", F.xxhash64(F.lit(s.seed), "doc_id", "text"))
    texts = texts.filter(F.pmod("key", F.lit(1 << 40)) < int(chosen * (1 << 40))).select("key", "text")
    end = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int32()))])
        model = Model(s, end)
        for batch in slices(batches):
            for key, text in zip(batch.column("key").to_pylist(), encoded(batch), strict=True):
                read, starts, stops = model.windows(subwords([words_of(text)], path))
                rng = np.random.default_rng([key & (1 << 63) - 1, s.seed])
                use = np.flatnonzero(rng.random(len(starts)) < share / chosen)
                shard = rng.integers(0, shards, len(use))
                if len(use):
                    ids = [read[a : min(a + WINDOW, b) + 1] for a, b in zip(starts[use].tolist(), stops[use].tolist(), strict=True)]
                    yield record(schema, [shard, ids])

    return texts.mapInArrow(run, "shard long, ids array<int>"), shards


#: Ids to predict in one piece of a text.
PIECE = 32 * WINDOW


def keyed_ids(docs: DataFrame, path: str, settings: Settings) -> DataFrame:
    """(key, ids) of each text: a hash of its row, and its subword ids. A table that has both is taken as it is."""
    if "ids" in docs.columns:
        return docs.select("key", "ids")
    kind = _narrow(_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("ids", pa.binary())])
        words = Lexicon(path, pa.array([], pa.string()))
        for batch in slices(batches, most_bytes=SLICE):
            found = words.read(batch.column("text"))
            yield record(schema, [batch.column("key"), _binaries(found.ids, found.bounds, kind)])

    texts = keyed_texts(docs).select(_key(settings), "text")
    return texts.mapInArrow(released(run), "key long, ids binary")


def _key(settings: Settings):
    return F.xxhash64(F.lit(settings.seed), "doc_id", "text").alias("key")


def _binaries(flat: np.ndarray, bounds: np.ndarray, kind: type) -> pa.Array:
    """A value for each stretch of `flat` between two bounds, its ids as `kind`."""
    offsets = (bounds * kind().itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.astype(kind).tobytes())])


def pieces(docs: DataFrame, path: str, settings: Settings, shards: int, turn: int) -> DataFrame:
    """(shard, key, piece, ids) of all texts of a round, each with an end before and after: ids to predict, after the one before them.

    A hash of its row tells the round of a text, and with the number of a piece the shard of the piece.
    """
    texts = keyed_ids(docs, path, settings).filter(F.pmod("key", F.lit(settings.rounds)) == turn)
    end = _vocabulary(path)
    last = np.array([end], _narrow(end)).tobytes()
    step = PIECE * len(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("piece", pa.int64()), ("ids", pa.binary())])
        for batch in slices(batches, "ids", most_bytes=1 << 20):
            out = [[], [], [], []]
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                read = last + ids + last
                for piece, at in enumerate(range(0, len(read) - len(last), step)):
                    for column, value in zip(out, ((key // settings.rounds + piece) % shards, key, piece, read[at : at + step + len(last)]), strict=True):
                        column.append(value)
            yield record(schema, out)

    return texts.mapInArrow(released(run), "shard long, key long, piece long, ids binary")


def _narrow(end: int) -> type:
    """The type in which ids up to `end` travel."""
    return np.uint16 if end < 1 << 16 else np.int32


def _piece_windows(ids: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in one array; start of each window, which do not overlap; end of its piece."""
    read = np.frombuffer(b"".join(ids), kind)
    sizes = np.array([len(x) // kind().itemsize for x in ids], np.int64)
    many = -(-(sizes - 1) // WINDOW)
    begin = np.repeat(np.cumsum(sizes) - sizes, many)
    number = np.arange(len(begin)) - np.repeat(np.cumsum(many) - many, many)
    return read, begin + number * WINDOW, begin + np.repeat(sizes, many) - 1


def context_counts(docs: DataFrame, path: str, top: np.ndarray, end: int) -> np.ndarray:
    """How often each context id stands before (first half) and after each id of `top`, over all texts."""
    place, context = (x.astype(np.int32) for x in _places(top, end))
    wide = 2 * CONTEXTS
    kind = _narrow(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(top) * wide, np.int64)
        last = np.array([end], kind).tobytes()
        for batch in slices(batches, "ids", most_bytes=1 << 20):
            flat = np.frombuffer(last + last.join([*batch.column("ids").to_pylist(), b""]), kind)
            known = np.flatnonzero(place[flat] >= 0)
            at = place[flat[known]] * wide
            np.add.at(total, at + context[flat[known - 1]], 1)
            np.add.at(total, at + CONTEXTS + context[flat[known + 1]], 1)
        at = np.flatnonzero(total)
        yield record(pa.schema([("cell", pa.int64()), ("n", pa.int64())]), [at, total[at]])

    found = keyed_ids(docs, path, Settings()).select("ids").mapInArrow(released(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(top) * wide, np.float32)  # a row for each pair of a frequent id and a context at most
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(len(top), wide)


def _added(dumps: DataFrame) -> DataFrame:
    """(name, data, n) summed by name: arrays of single precision, and how many. A task holds one sum for each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        count: Counter[str] = Counter()
        for batch in batches:
            for name, data, n in zip(*[batch.column(c).to_pylist() for c in ("name", "data", "n")], strict=True):
                total[name] = total.get(name, 0) + np.frombuffer(data, np.float32).astype(np.float64)
                count[name] += n
        schema = pa.schema([("name", pa.string()), ("data", pa.binary()), ("n", pa.int64())])
        yield record(schema, [list(total), [v.astype(np.float32).tobytes() for v in total.values()], [count[k] for k in total]])

    return dumps.mapInArrow(released(run), "name string, data binary, n long")


def train(docs: DataFrame, path: str, ids: np.ndarray, counts: np.ndarray, texts: int, settings: Settings = Settings()) -> Model:
    """Classes and weights from all of `docs`; `counts` of `ids` and the number of `texts` are those of the corpus.
    `docs` has texts, or (key, ids) of them.

    Each shard of a round takes the weights on over all its windows, all shards side by side; their mean, by windows, is where the next round starts.
    """
    if "ids" not in docs.columns:
        docs = stored(keyed_ids(docs, path, settings))  # read once for the classes and once for the rounds
    model = Model(settings, _vocabulary(path))
    model.count(ids, counts)
    model.group(ids[np.argsort(-counts, kind="stable")], lambda top: context_counts(docs, path, top, model.end))
    model.count(ids, counts)  # within the classes that are now known
    shards = max(1, round((int(counts.sum()) + texts) / settings.shard_ids))
    steps = -(-settings.steps // settings.rounds)

    def taken_on(start: dict[str, bytes], turn: int):
        def fit(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            own = Model(settings, model.end).load(start)
            table = table.sort_by([("key", "ascending"), ("piece", "ascending")])  # in any order of arrival
            read, starts, stops = _piece_windows(table["ids"].to_pylist(), _narrow(model.end))
            own.learn(read, starts, stops, steps, [settings.seed, turn, shard], settings.rate / (1 + turn))
            data = [(v * np.float32(len(starts))).tobytes() for v in own.p.values()]
            return pa.table({"name": pa.array(list(own.p), pa.string()), "data": pa.array(data, pa.binary()), "n": pa.array([len(starts)] * len(own.p))})

        return fit

    for turn in range(settings.rounds):
        dealt = pieces(docs, path, settings, shards, turn).repartition(shards, "shard")  # a task for a shard or a few
        dumps = dealt.groupBy("shard").applyInArrow(taken_on(model.dump(), turn), "name string, data binary, n long")
        for row in _added(_added(dumps).repartition("name")).collect():  # a row for each array of the model
            shape = model.p[row["name"]].shape
            model.p[row["name"]] = (np.frombuffer(row["data"], np.float32) / row["n"]).astype(np.float32).reshape(shape)
    return model


def _vocabulary(path: str) -> int:
    return len(codec(path).tokens)


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n) over all rows of `docs`; the end of a text is the empty word. A task adds up before it sends."""

    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches, most_bytes=SLICE):
            found = parted(batch.column("text"))[0].value_counts()
            parts += [pa.table({"word": found.field("values"), "n": found.field("counts")}), pa.table({"word": [""], "n": [batch.num_rows]})]
            held += len(found) + 1
            if held > 2 * most:
                parts = [added(parts)]
                held = parts[0].num_rows
                if held > most:
                    yield from parts[0].to_batches()
                    parts, held = [], 0
        if parts:
            yield from added(parts).to_batches()

    return keyed_texts(docs).mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(words: DataFrame, path: str) -> DataFrame:
    """(id, n) of subword ids over (word, n): each distinct word is encoded once. At most a vocabulary of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = Lexicon(path, pa.array([], pa.string()))  # each word comes once
        total = np.zeros(_vocabulary(path), np.int64)
        for batch in slices(batches, "word", most_rows=20_000):
            batch = batch.filter(pc.greater(pc.binary_length(batch.column("word")), 0))
            ids, sizes = every.encoded(batch.column("word"))
            total += np.bincount(ids, np.repeat(batch.column("n").to_numpy(), sizes), minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield record(pa.schema([("id", pa.int64()), ("n", pa.int64())]), [at, total[at]])

    return words.mapInArrow(released(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, settings: Settings) -> dict[bytes, int]:
    """The words above a count that at most `head` words reach, by a histogram over powers of two; none over `head_bytes`."""
    short = counts.filter(F.octet_length("word") <= settings.head_bytes)
    sizes = short.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("b")).collect()
    least, held = None, 0
    for r in sizes:
        held += r.k
        if held > settings.head:
            break
        least = r.b
    if least is None:
        return {}
    return {r.word.encode(): r.n for r in short.filter(F.floor(F.log2("n")) >= least).collect()}


def score_texts(docs: DataFrame, path: str, settings: Settings = Settings(), folds: int = 7, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`."""
    texts = keyed_texts(docs)
    learned = texts.filter(fold_of(F.col("doc_id"), folds) != held_out)
    counts = stored(word_counts(learned))
    ended = F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))
    tokens, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), ended).first()
    spark = docs.sparkSession
    found = sorted((r.id, r.n) for r in id_counts(counts, path).collect())
    ids, n = np.array([i for i, _ in found], np.int64), np.array([k for _, k in found], np.int64)
    rest = np.log10(tokens + distinct + 1)
    frequent = {w: k for w, k in head_words(counts, settings).items() if w}  # at most settings.head words; the end is none
    head = spark.sparkContext.broadcast((pa.array(list(frequent), pa.binary()).cast(pa.string()), np.array(list(frequent.values()), np.float64)))
    kind = _narrow(_vocabulary(path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = pa.struct([("word", pa.string()), ("n", pa.int64())])
        schema = pa.schema([
            ("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_score", pa.float64()), ("rare", pa.list_(word)),
        ])
        end_gain = float(np.log10(ends + 1) - rest)
        gain = np.log10(head.value[1] + 1) - rest
        words = Lexicon(path, head.value[0])
        for batch in slices(batches, most_bytes=SLICE):
            found = words.read(batch.column("text"))
            of = np.repeat(np.arange(batch.num_rows), found.many)
            frequent = found.at < len(gain)
            heads = np.bincount(of[frequent], minlength=batch.num_rows) + (ends > 0)
            sums = np.bincount(of[frequent], gain[found.at[frequent]], minlength=batch.num_rows) + end_gain
            # other words of each text, each once
            base = max(1, len(found.rare))
            pair, times = np.unique(of[~frequent] * base + found.at[~frequent] - len(gain), return_counts=True)
            bounds = np.searchsorted(pair, np.arange(batch.num_rows + 1) * base)
            pairs = pa.StructArray.from_arrays([found.rare.take(pa.array(pair % base)), pa.array(times, pa.int64())], fields=list(word))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs, type=pa.list_(word))
            yield record(schema, [batch.column("doc_id"), batch.column("key"), _binaries(found.ids, found.bounds, kind), found.many + 1, heads, sums, lists])

    # read once and numbered: a row's ids serve classes, both rounds and the score, and equal rows are told apart
    columns = "doc_id long, key long, ids binary, n_tokens long, n_head long, head_score double, rare array<struct<word: string, n: long>>"
    rows = stored(texts.select("doc_id", _key(settings), "text").mapInArrow(released(read), columns).withColumn("row", F.monotonically_increasing_id()))
    model = train(rows.filter(fold_of(F.col("doc_id"), folds) != held_out).select("key", "ids"), path, ids, n, ends, settings)
    sent = spark.sparkContext.broadcast((model.dump(), model.end))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, end = sent.value
        own = Model(settings, end).load(data)
        kept = ["row", "doc_id", "n_tokens", "n_head", "head_score"]
        for batch in slices(batches, "ids", most_bytes=1 << 19):
            found = own.score([np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found, pa.float64())], [*kept, "score"])

    columns = "row long, doc_id long, n_tokens long, n_head long, head_score double, score double"
    scored = stored(rows.select("row", "doc_id", "n_tokens", "n_head", "head_score", "ids").mapInArrow(released(score), columns))
    each = rows.select("row", F.inline("rare")).join(counts.select(F.col("word").alias("_word"), F.col("n").alias("c")), F.col("word") == F.col("_word"), "left")
    gain = F.log10(F.coalesce("c", F.lit(0)) + 1.0) - F.lit(float(rest))
    summed = each.groupBy(F.col("row").alias("_row")).agg(F.sum(gain * F.col("n")).alias("tail_score"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_tail"))
    joined = scored.join(summed, F.col("row") == F.col("_row"), "left")
    return joined.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"), "score",
    )
