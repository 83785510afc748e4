"""Byte-level BPE without regular expressions: encode, and decode again.

A text is split by a small automaton over classes of code points. Each place has a symbol: its class, with what the
places after it decide (whether a space leads a word, whether an apostrophe can open a contraction). A symbol is a
transition function over the automaton's states, and functions compose associatively: blocks of places are
composed side by side, the blocks are scanned by doubling, and a last pass marks where slices begin. Slices feed
pair merging by rank, kept for slices already met. Byte offsets of the ids are retained, so decoding can be
checked or cut anywhere.

Defined cases: null counts as empty; empty texts have no ids; null ids and equal rows are each returned; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetlens.llm.common import Recent, keyed_texts, record, slices, strings

LETTER, NUMBER, OTHER, LEAD, WHITE, ALONE, ONE, TWO, END = range(9)
#: States: nothing open, in letters, in numbers, in other characters, in white space, after a leading space, one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, SPACES, LED, LAST, LAST_TWO = range(8)
STATES = 8
BLOCK = 64
#: White space by the Unicode property of that name (fixed values).
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            out[point] = LETTER if kind == "L" else NUMBER
    out[list(WHITE_SPACE)] = WHITE
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a slice begins, at [symbol * STATES + state]."""
    after, begins = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)
    for symbol, state in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        after[symbol] = state
        begins[symbol, [state, LED]] = False
    after[LEAD] = LED
    after[WHITE] = SPACES
    begins[WHITE, SPACES] = False
    after[[ALONE, END]] = FRESH
    for symbol, state in ((ONE, LAST), (TWO, LAST_TWO)):
        after[symbol] = state
        after[symbol, [OTHERS, LED]] = OTHERS
        begins[symbol, [OTHERS, LED]] = False
    after[:END, LAST], after[:END, LAST_TWO] = FRESH, LAST
    begins[:END, [LAST, LAST_TWO]] = False
    return after.ravel(), begins.ravel()


AFTER, BEGINS = _automaton()


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each place; `ends` are the places of the ends of texts."""
    out = classes()[points]
    out[ends] = END
    white = out == WHITE
    closes = np.flatnonzero(white & ~np.r_[white[1:] | (out[1:] == END), True])
    out[closes] = np.where(points[closes] == 32, LEAD, ALONE)
    marks = np.flatnonzero((points == 39) & (out == OTHER))
    ahead = np.concatenate([points, np.zeros(2, points.dtype)])
    first, second = ahead[marks + 1], ahead[marks + 2]
    out[marks[np.isin(first, [ord(c) for c in "stmd"])]] = ONE
    pairs = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    out[marks[pairs]] = TWO
    return out


def slice_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places where slices begin, by a scan of composed transition functions."""
    n = len(points)
    rows = -(-n // BLOCK)
    symbol = np.full(rows * BLOCK, END, np.uint8)
    symbol[:n] = symbols(points, ends)
    grid = np.ascontiguousarray(symbol.reshape(rows, BLOCK).T) * np.uint8(STATES)
    composed = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        composed = AFTER[column[:, None] + composed]
    shift = 1
    while shift < rows:
        composed[shift:] = np.take_along_axis(composed[shift:], composed[:-shift].astype(np.intp), axis=1)
        shift *= 2
    state = np.r_[np.uint8(FRESH), composed[:-1, FRESH]]
    starts = np.empty((BLOCK, rows), bool)
    for i, column in enumerate(grid):
        at = column + state
        starts[i], state = BEGINS[at], AFTER[at]
    return np.flatnonzero(starts.T.ravel()[:n])


class Codec:
    """Ranks of a file, with slices already merged."""

    def __init__(self, path: str, keep: int = 400_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = [str(i).encode() for i in range(len(self.tokens))]
        self.known = Recent(self.merge, keep)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the pair of least rank is merged, the leftmost of equals, until none is left."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            least = min((r for r in pairs if r is not None), default=None)
            if least is None:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1])
        return tuple([ranks[p] for p in parts])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over the pairs, for slices of any length."""
        ranks, n = self.ranks, len(piece)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(a: int) -> None:
            b = stop[a]
            if b < n:
                rank = ranks.get(piece[a : stop[b]])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, stop[b]))

        for a in range(n):
            offer(a)
        gone = bytearray(n + 1)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if gone[a] or gone[b] or stop[a] != b or stop[b] != c:
                continue
            gone[b], stop[a] = 1, c
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(ranks[piece[a : stop[a]]])
            a = stop[a]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; all texts are split together."""
        if not texts:
            return []
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = slice_starts(points, ends)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.concatenate([[0], np.cumsum(width)])
        cuts = offsets[np.r_[starts, len(points)]].tolist()
        data, of = joined.encode(), self.known.__getitem__
        closing = np.searchsorted(starts, ends).tolist()
        out, first = [], 0
        for last in closing:
            pieces = [data[a:b] for a, b in zip(cuts[first:last], cuts[first + 1 : last + 1], strict=True)]
            out.append(list(chain.from_iterable(map(of, pieces))))
            first = last + 1
        return out

    def offsets(self, ids: list[int]) -> np.ndarray:
        """The byte at which each id begins in the text, and the end."""
        return np.concatenate([[0], np.cumsum([len(self.tokens[i]) for i in ids])]).astype(np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, once per Python worker."""
    if path not in CODECS:
        CODECS[path] = Codec(path)
    return CODECS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, offsets) of each row: offsets has the byte where each id begins, then the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])
        for batch in slices(batches):
            ids = own.encode(strings(batch))
            yield record(schema, [batch.column("doc_id"), ids, [own.offsets(x) for x in ids]])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text as bytes) of rows (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
        for batch in batches:
            yield record(schema, [batch.column("doc_id"), [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for batch in slices(batches):
            ids = own.encode(strings(batch))
            listed = [hashlib.sha256(b",".join(map(own.names.__getitem__, x))).hexdigest() for x in ids]
            decoded = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
            yield record(schema, [batch.column("doc_id"), list(map(len, ids)), listed, decoded])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
