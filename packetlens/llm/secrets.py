"""Secrets in texts: key patterns, and a battery of randomness tests over other long tokens.

Patterns give the base spans: assignments to a secret's name, access keys, long hexadecimal runs. Any other
run of at least 20 key characters is a candidate if its characters imply an encoding (hexadecimal, base 32, base 36,
base 64). Where the whole implies none, its parts between '-', '_' and '/' are candidates if one is that long, and else
their characters joined (prefixed keys, UUIDs). Words and numbers are left to the tests. The battery
asks whether it can be a random string of that encoding: chi-squared for uniform use of the alphabet, the number of runs
of a class of characters, and serial correlation, joined by Fisher's method. Short tokens are tested
with less power than long ones, so the false-discovery control (Benjamini and Hochberg) runs within each
encoding and length class, over all candidates of the corpus: those found not to be random are dropped and
at most the share `q` of the dropped are expected to be real secrets. The rest are spans of kind `random`.

Defined cases: null text counts as empty; null ids and equal rows are each returned; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlens.llm.common import record, slices, stored, strings

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
PART = re.compile(r"[^/_-]+")

#: Encodings from the narrowest, with their characters.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
PLACES = [(name, {c: i for i, c in enumerate(chars)}) for name, chars in ENCODINGS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the pattern matches."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def encoding_of(token: str) -> tuple[str, dict[str, int]] | None:
    """The narrowest encoding whose characters a token keeps to; base 64 only if it has capital and small letters."""
    used = set(token)
    mixed = any(c.islower() for c in used) and any(c.isupper() for c in used)
    for name, places in PLACES:
        if used <= places.keys() and (mixed or not name.startswith("base64")):
            return name, places
    return None


def tokens(text: str) -> Iterator[tuple[int, int, str, tuple[str, dict[str, int]]]]:
    """(start, end, characters to judge, encoding) of each candidate."""
    for m in TOKEN.finditer(text):
        whole = m.group().rstrip("=")
        kind = encoding_of(whole)
        if kind is not None:
            yield m.start(), m.end(), whole, kind
            continue
        parts = [(m.start() + p.start(), m.start() + p.end(), p.group()) for p in PART.finditer(whole)]
        long = [p for p in parts if len(p[2]) >= LEAST]
        joined = "".join(p[2] for p in parts)
        for start, stop, part in long or [(m.start(), m.end(), joined)] * (len(joined) >= LEAST):
            kind = encoding_of(part)
            if kind is not None:
                yield start, stop, part, kind


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(chi: float, free: int) -> float:
    """Upper tail of chi-squared in the normal form of Wilson and Hilferty."""
    spread = 2 / (9 * free)
    return _upper_tail(((max(chi, 1e-9) / free) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def _classes(chars: str) -> tuple[list[int], list[float]]:
    """The class (capital, small, digit, other) of each character of an alphabet, and the share of each class."""
    own = [0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in chars]
    used = sorted(set(own))
    return [used.index(k) for k in own], [own.count(k) / len(own) for k in used]


CLASSES = {len(places): _classes("".join(places)) for _, places in PLACES}


def battery(symbols: list[int], size: int) -> float:
    """The joint p-value that a symbol sequence is random over an alphabet of `size` symbols.

    Uniform use is tested by symbol, which has power for long tokens, and by class of character, which has some
    for short ones; a run is a run of one class.
    """
    n = len(symbols)
    counts: dict[int, int] = {}
    for s in symbols:
        counts[s] = counts.get(s, 0) + 1
    of, share = CLASSES[size]
    kinds = [of[s] for s in symbols]
    fine = _chi_tail(sum(c * c for c in counts.values()) * size / n - n, size - 1)
    coarse = _chi_tail(sum((kinds.count(k) - n * p) ** 2 / (n * p) for k, p in enumerate(share)), len(share) - 1)
    uniform = min(1.0, 2 * min(fine, coarse))
    square, cube = sum(p**2 for p in share), sum(p**3 for p in share)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    spread = (n - 1) * square * (1 - square) + 2 * (n - 2) * (cube - square**2)
    runs = math.erfc(abs(changes - (n - 1) * (1 - square)) / math.sqrt(2 * spread))
    middle = sum(symbols) / n
    around = [s - middle for s in symbols]
    power = sum(a * a for a in around)
    serial = sum(a * b for a, b in zip(around, around[1:], strict=False)) / power * math.sqrt(n) if power else math.sqrt(n)
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, math.erfc(abs(serial) / math.sqrt(2))))
    return math.exp(-half) * (1 + half + half * half / 2)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding and length class, p) of the tokens to judge, none of them touching a base span.

    Base spans are in order of their starts: of those that start before a token's end, the furthest end decides.
    """
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, b, _ in base), max))

    def free(start: int, stop: int) -> bool:
        before = bisect_left(starts, stop)
        return before == 0 or reach[before - 1] <= start

    return [
        (start, stop, f"{name}:{len(token).bit_length()}", battery([places[c] for c in token], len(places)))
        for start, stop, token, (name, places) in tokens(text)
        if free(start, stop)
    ]


SPANS = "array<struct<start:long,stop:long,kind:int>>"
JUDGED = "array<struct<start:long,stop:long,cell:string,p_bin:int>>"
STEPS = 8  # bins of p per factor of e


def _bin(p: float) -> int:
    """Bins of p, the smallest first; each stands for its upper end, which errs towards keeping."""
    return -min(int(-math.log(max(p, 1e-280)) * STEPS), 640 * STEPS)


def _scan(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32())]))
    judged = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("cell", pa.string()), ("p_bin", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("judged", judged), ("base_sha256", pa.string())])
    for batch in slices(batches):
        base, more, digests = [], [], []
        for text in strings(batch):
            found = base_spans(text)
            base.append([{"start": a, "stop": b, "kind": k} for a, b, k in found])
            more.append([{"start": a, "stop": b, "cell": c, "p_bin": _bin(p)} for a, b, c, p in candidates(text, found)])
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found).encode()).hexdigest())
        found = record(schema, [batch.column("doc_id"), base, more, digests])
        yield pa.RecordBatch.from_arrays([*found.columns, *[batch.column(f"_{c}") for c in carry]], names=[*schema.names, *[f"_{c}" for c in carry]])


def scan_secrets(docs: DataFrame, q: float = 0.01, carry: list[str] = ()) -> DataFrame:
    """(doc_id, base, spans, base_sha256), one row per row of `docs`; spans have start, stop and the kind's number in KINDS.

    Columns of `docs` named in `carry` are added, each under its name after an underscore.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    more = "".join(f", _{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    names = list(carry)
    scanned = stored(texts.mapInArrow(lambda batches: _scan(batches, names), f"doc_id long, base {SPANS}, judged {JUDGED}, base_sha256 string{more}"))
    cells = scanned.select(F.inline("judged")).groupBy("cell", "p_bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("cell").orderBy("p_bin"))
    every = F.sum("n").over(W.partitionBy("cell"))
    rejects = F.exp(F.col("p_bin") / STEPS) <= q * upto / every
    # bounded: encodings times length classes
    cut = cells.select("cell", F.when(rejects, F.col("p_bin")).alias("b")).groupBy("cell").agg(F.max("b").alias("b"))
    limits = cut.filter("b is not null").agg(F.map_from_entries(F.collect_list(F.struct("cell", "b"))).alias("m")).scalar()
    table = scanned.withColumn("limits", limits)
    extra = F.filter("judged", lambda c: c["p_bin"] > F.coalesce(F.element_at("limits", c["cell"]), F.lit(-(2**31))))
    named = F.transform(extra, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.lit(KINDS.index("random")).alias("kind")))
    spans = F.transform(
        F.array_sort(F.transform(F.concat("base", named), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")),
    )
    return table.select("doc_id", "base", spans.alias("spans"), "base_sha256", *[f"_{c}" for c in carry])


def span_text(spans):
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: str, spans: list, mark: str = "[secret]") -> str:
    """`text` with a mark in place of its spans (in order of their starts); one that starts within an earlier span is part of it."""
    parts, at = [], 0
    for span in spans:
        if span["start"] >= at:
            parts += [text[at : span["start"]], mark]
        at = max(at, span["stop"])
    return "".join([*parts, text[at:]])


def redact(text, spans, mark: str = "[secret]"):
    """`redacted` of two columns. Only texts with spans go to Python."""

    @F.udf("string", useArrow=True)
    def run(text, spans):
        return None if text is None else redacted(text, spans, mark)

    return F.coalesce(run(F.when(F.size(spans) > 0, text), spans), text)
