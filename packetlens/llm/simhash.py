"""SimHash near-duplicates, compared at the anchor points of a covering code.

The code is Hamming(31, 26): every 31-bit word is within its covering radius 1 of exactly one anchor.
It covers two disjoint sets of 31 of the 64 bits. Two fingerprints that differ in 3 bits or fewer differ in
at most 1 bit on one of the sets. Each fingerprint is replicated to every anchor within 1 + 1 of its
31 bits (1 or 16 anchors), so the two meet at the anchor that covers either of them. Only pairs with a
member at home (within the covering radius) are compared there, over all 64 bits.

Equal fingerprints are one row from the start. A task compares the fingerprints of an anchor in memory
only up to `most`; a larger anchor is cut into chunks and each pair of chunks is a task of its own. Each
gives at most one link per fingerprint (a spanning forest), never all pairs.

Defined cases: null or empty text has fingerprint zero and is linked like any other; null ids never
become a component's id unless it has no other; equal rows are each returned; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import encoded, record, slices, stored
from packetlens.llm.components import components

BITS = 31
MASK = np.uint64((1 << BITS) - 1)
MOST = 2048
SMALL = 48


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority of the XXH64 (seed 42) of all word shingles, bit by bit."""
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops, strict=False)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, carry: list[str] = ()) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long, and its columns named in `carry`."""
    names = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
        for batch in slices(batches):
            found = np.array([fingerprint(t, words) for t in encoded(batch)], dtype=np.uint64).view(np.int64)
            own = record(schema, [batch.column("doc_id"), pa.array(found)])
            yield pa.RecordBatch.from_arrays([*own.columns, *[batch.column(c) for c in names]], names=[*schema.names, *names])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *names)
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return texts.mapInArrow(run, f"doc_id long, fp long{more}")


def _syndromes() -> np.ndarray:
    """Per byte and byte place of a 31-bit word: the xor of the numbers 1..31 of its set bits."""
    out = np.zeros((4, 256), np.uint8)
    for place in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and place * 8 + bit < BITS:
                    out[place, value] ^= place * 8 + bit + 1
    return out


SYNDROMES = _syndromes()
#: For each syndrome s, the 15 pairs of bits whose numbers have the xor s, as masks; flipping one pair leads to an anchor at distance 2.
PAIRS = np.array([[0] * 15] + [[(1 << a - 1) | (1 << (a ^ s) - 1) for a in range(1, 32) if a < a ^ s] for s in range(1, 32)], dtype=np.uint64)


def anchors(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor within distance 2 of each 31-bit word; home: within 1."""
    word = part.astype(np.uint64)
    syndrome = np.zeros(len(word), np.uint8)
    for place in range(4):
        syndrome ^= SYNDROMES[place, ((word >> np.uint64(8 * place)) & np.uint64(255)).astype(np.intp)]
    off = np.flatnonzero(syndrome)
    nearest = word.copy()
    nearest[off] ^= np.uint64(1) << (syndrome[off].astype(np.uint64) - np.uint64(1))
    further = (word[off, None] ^ PAIRS[syndrome[off]]).ravel()
    rows = np.concatenate([np.arange(len(word)), np.repeat(off, 15)])
    return rows, np.concatenate([nearest, further]), np.arange(len(rows)) < len(word)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        word = fps.view(np.uint64)
        for half in (0, 1):
            rows, anchor, home = anchors((word >> np.uint64(BITS * half)) & MASK)
            key = (anchor | np.uint64(half << BITS)).view(np.int64)
            yield record(schema, [pa.array(key), pa.array(fps[rows]), pa.array(home)])


def _forest(fps: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of which one is at home."""
    word, label = fps.view(np.uint64), np.arange(len(fps))
    for i in np.flatnonzero(home):
        near = np.unique(label[np.bitwise_count(word ^ word[i]) <= most])
        if len(near) > 1:
            label[np.isin(label, near[1:])] = near[0]
    other = label != np.arange(len(fps))
    return fps[label[other]], fps[other]


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("anchor", pa.int64()), ("home", pa.bool_())])


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return record(LINKS, [pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.bool_())])


def _small_groups(key: np.ndarray, fps: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of an equal key, all runs at once: rows are compared with the k-th row after them."""
    u, v = [], []
    for k in range(1, SMALL):
        same = key[k:] == key[:-k]
        if not same.any():
            break
        at = np.flatnonzero(same & (home[k:] | home[:-k]))
        at = at[np.bitwise_count((fps[at] ^ fps[at + k]).view(np.uint64)) <= most]
        u.append(fps[at])
        v.append(fps[at + k])
    empty = np.zeros(0, np.int64)
    u, v = np.concatenate([empty, *u]), np.concatenate([empty, *v])
    low, high = np.minimum(u, v), np.maximum(u, v)
    pairs = np.unique(np.stack([low, high], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _compare(batches: Iterator[pa.RecordBatch], distance: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted (anchor, fp, home) rows. Rows of an anchor with more than `most` are handed on."""
    kept: list[np.ndarray] = []
    hot = None

    def groups(key, fps, home):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        large = sizes >= SMALL
        rest = ~np.repeat(large, sizes)
        yield _links(*_small_groups(key[rest], fps[rest], home[rest], distance))
        for at, n in zip(starts[large], sizes[large], strict=True):
            yield _links(*_forest(fps[at : at + n], home[at : at + n], distance))

    def handed(key, fps, home):
        return record(LINKS, [pa.array(fps), pa.array(fps), pa.array(key), pa.array(home)])

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(new[0]):
            continue
        key, fps, home = (np.concatenate(x) for x in zip(kept, new, strict=True)) if kept else new
        if hot is not None:
            n = int(np.searchsorted(key, hot, side="right"))
            if n:
                yield handed(key[:n], fps[:n], home[:n])
            key, fps, home = key[n:], fps[n:], home[n:]
            if not len(key):
                kept = []
                continue
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield from _split(key[:last], fps[:last], home[:last], most, groups, handed)
        key, fps, home = key[last:], fps[last:], home[last:]
        kept, hot = [key, fps, home], None
        if len(key) > most:
            yield handed(key, fps, home)
            kept, hot = [], key[-1]
    if kept and len(kept[0]):
        yield from _split(*kept, most, groups, handed)


def _split(key, fps, home, most, groups, handed):
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    hot = np.repeat(sizes > most, sizes)
    if hot.any():
        yield handed(key[hot], fps[hot], home[hot])
    if not hot.all():
        yield from groups(key[~hot], fps[~hot], home[~hot])


def fingerprint_links(fps: DataFrame, distance: int = 3, most: int = MOST) -> DataFrame:
    """Links (u, v) of a forest for each anchor, over the distinct fingerprints `fps`; together they join all that are within `distance`."""
    if distance > 3:
        raise ValueError("two covered halves find up to 3 differing bits")

    def compare(batches):
        return _compare(batches, distance, most)

    def compare_chunks(batches):
        return _compare(batches, distance, np.iinfo(np.int64).max)

    out = "u long, v long, anchor long, home boolean"
    replicas = fps.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean")
    first = stored(replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, out))
    # anchors over `most`: chunk i of those at home meets chunk j of all
    handed = first.filter("anchor is not null").select("anchor", F.col("u").alias("fp"), "home")
    sizes = handed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).select(F.col("anchor").alias("a"), F.ceil(F.col("n") / most).alias("chunks"))
    cut = handed.join(sizes, F.col("anchor") == F.col("a")).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    homes = cut.filter("home").withColumn("j", each).select("anchor", F.col("chunk").alias("i"), "j", "fp", "home")
    others = cut.withColumn("i", each).select("anchor", "i", F.col("chunk").alias("j"), "fp", F.lit(False).alias("home"))
    pairs = homes.union(others).select(F.xxhash64("anchor", "i", "j").alias("anchor"), "fp", "home")
    second = pairs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare_chunks, out)
    return first.filter("anchor is null").select("u", "v").union(second.select("u", "v")).distinct()


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3, most: int = MOST, carry: list[str] = ()) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of `docs`: fingerprint and least id reachable over links.

    With columns named in `carry` come these and the component's `root`, its least fingerprint.
    """
    rows = stored(fingerprints(docs, words, carry))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(classes, distance, most))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select(F.col("fp").alias("_fp"), F.col("root").alias("_root")).join(ids, F.col("_root") == F.col("root")).select("_fp", "component_id", F.col("_root").alias("root"))
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id", *(["root", *carry] if carry else []))
