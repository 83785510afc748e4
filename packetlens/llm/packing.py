"""Documents in as few fixed-length sequences as possible, by vector best fit.

A piece takes a vector of a bin's capacities: its tokens, one document and the square of its length (attention
cost). Pieces come longest first; of the bins that hold a piece under every constraint, it goes to the one
with the smallest weighted norm of what would be left, or the largest weighted dot-product of piece and residual.

Documents are tokenised where they are read and only (id, piece, length, checksum) travels. Groups of `rows_per_group`
pieces, alike by hash, are packed each in one task: its bins waste about one sequence in thousands.
Whole pieces of full length are sequences of their own and meet no one.

Defined cases: null and empty texts are the closing id alone; equal rows and null ids are packed like any other; an
empty table gives no rows; other columns are not read. Documents are cut so that each piece alone
keeps to the cost; a count capacity below one raises an error.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import Recent, encoded, keyed_texts, record, slices, stored


@dataclass(frozen=True)
class Bins:
    """Capacities of a sequence, weights of the three residuals, and the rule that chooses a bin.

    By default documents and attention cost bind only where tokens do, so that sequences are few.
    """

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-3)
    rule: str = "norm"


#: Words of these characters alone need no Unicode normalisation; any other goes to the tokenizer as it is.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own split of a lower-cased word, for those characters (a fixed value).
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of a tokenizer that treats the words between white space apart, kept for words and parts already met."""

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words, self.parts = Recent(self._word, keep), Recent(self._part, keep)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join(map(self.letters.__getitem__, part.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        of = self.words.__getitem__
        return [b"".join(map(of, text.split())) for text in texts]


TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of a file, once per Python worker."""
    if path not in TOKENIZERS:
        TOKENIZERS[path] = WordIds(path)
    return TOKENIZERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Each document's ids and `end_id`, cut where longer than `most`; with `ids`, the ids themselves too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        if ids:
            schema = schema.append(pa.field("ids", pa.list_(pa.int64())))
        for batch in slices(batches):
            out: list[list] = [[] for _ in schema]
            for doc, code in zip(batch.column("doc_id").to_pylist(), encode(encoded(batch)), strict=True):
                code += end
                for k, at in enumerate(range(0, len(code), 4 * most)):
                    part = code[at : at + 4 * most]
                    row = [doc, k, at // 4, len(part) // 4, zlib.crc32(part)]
                    if ids:
                        row.append(np.frombuffer(part, "<u4").astype(np.int64))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield record(schema, out)

    return keyed_texts(docs).mapInArrow(run, PIECES + ", ids array<long>" * ids)


def best_fit(lengths: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths may come in any order."""
    if bins.documents < 1:
        raise ValueError("a sequence must hold a document")
    full = np.array([bins.tokens, bins.documents, bins.cost], float)
    weights = np.array(bins.weights) / full
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    room = np.zeros((3, 64))  # residuals of the bins that can still take a piece
    number = np.zeros(64, np.int64)
    opened = held = 0
    for at in order:
        n = int(lengths[at])
        need = np.array([n, 1, n * n], float)
        if (need > full).any():
            raise ValueError(f"a piece of {n} tokens exceeds a capacity")
        left = room[:, :held] - need[:, None]
        fits = (left >= 0).all(axis=0)
        if fits.any():
            if bins.rule == "norm":
                score = ((left * weights[:, None]) ** 2).sum(axis=0)
            else:
                score = -((need * weights**2) @ room[:, :held])
            k = int(np.where(fits, score, np.inf).argmin())
        else:
            if held == room.shape[1]:
                room, number = np.pad(room, ((0, 0), (0, held))), np.pad(number, (0, held))
            k, number[held], room[:, held] = held, opened, full
            opened, held = opened + 1, held + 1
        where[at], offset[at] = number[k], int(full[0] - room[0, k])
        room[:, k] -= need
        if room[0, k] < least or room[1, k] < 1 or room[2, k] < least * least:  # closed: no piece is that short
            held -= 1
            room[:, k], number[k] = room[:, held], number[held]
    return where, offset


PACKED = PIECES + ", sequence_id long, offset long"


def pack(cut: DataFrame, bins: Bins = Bins(), rows_per_group: int = 8192) -> DataFrame:
    """The pieces of a stored table, with sequence_id and offset."""
    whole = cut.filter(F.col("length") >= bins.tokens)
    parts = cut.filter(F.col("length") < bins.tokens)
    groups = max(1, -(-parts.count() // rows_per_group))
    # equal pieces would all have one hash: the length and a running number within each partition spread them
    spread = F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(groups)).cast("long")

    def fit(table: pa.Table) -> pa.Table:
        where, offset = best_fit(table["length"].to_numpy(), bins)
        ids = np.int64(table["_group"][0].as_py()) * np.int64(rows_per_group * 64) + where
        return table.select(PIECES_NAMES).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    packed = parts.withColumn("_group", spread).groupBy("_group").applyInArrow(fit, PACKED)
    alone = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.union(alone)


PIECES_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack_documents(docs: DataFrame, tokenizer: str, bins: Bins = Bins(), rows_per_group: int = 8192) -> DataFrame:
    """Tokenise, cut and pack: one row per piece."""
    most = min(bins.tokens, math.isqrt(bins.cost))
    return pack(stored(pieces(docs, tokenizer, most)), bins, rows_per_group)
