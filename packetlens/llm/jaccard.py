"""Joins of texts by the Jaccard similarity of their word n-grams, with signature trees.

Two texts are linked if 100 * common >= 85 * joint holds for their sets of 4-word shingles (64 hashed bits of the XXH64 of each
word). Texts of one set are one node from the start. The result is exact: every pair of linked sets ends in one component.

Which sets meet: shingles have one global order, rare ones first, by a table of counts in `SLOTS` hash slots (any fixed order is
right; a good one keeps groups small). Linked sets share one of their first size - ceil(0.85 * size) + 1 shingles, so the sets that
hold such a shingle are a group; groups of the same members are one.

How a group is compared: its sets are the leaves of a signature tree. A leaf has a bitmap of its shingles (a power of two of bits, at
least `BITS` and twice its size; one of twice another's width is folded to meet it), its size and its excess (shingles beyond
the bits set); inner nodes hold the OR of the bitmaps, the range of sizes and the largest excess. Two trees, or one with itself, are walked together from the top: two nodes can only hold linked sets if the bits
common to both plus the smaller excess reach the overlap that their least sizes need, so most pairs of nodes end a
walk early. Pairs that are in one component already are passed over as well.

Three rounds keep the work in proportion to the rows, however large a group is:
1. the least node of each group is compared with the others, each node with the one of these that it shares most groups with;
   pairs that pass the bitmaps are checked on their sets, and linked ones become components;
2. groups that still hold several components are walked by their bitmaps. Members of the group's largest component need not meet
   each other; beyond `most` rows all are cut into chunks, and pairs of chunks are tasks of their own;
3. the components that this joins into candidates are walked with their sets at hand, chunks bounded by shingles.
Each walk returns a forest, never all pairs. Sets are read again only for rows that pass a round of bitmaps.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing, their component is their own id.
Null ids never name a component unless it has no other. Equal rows are each returned. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import encoded, record, slices, stored, word_slices
from packetlens.llm.components import components

BITS = 1024
SLOTS = 1 << 18
PART = 1 << 12
FAN = 8
#: Pairs of tree nodes that are tested at once.
STEP = 4096
#: Rows of a chunk, shingles of a chunk, keys of texts that are sent to all executors.
MOST, MOST_SHINGLES, MOST_KEYS = 4096, 1 << 21, 1 << 20


#: White space separates words.
IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3; its constants are fixed values."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the distinct hashes of its word shingles, sorted; a shorter text is one shingle.

    Words are hashed once a batch; a shingle's hash is a sum of its words' hashes, each times the factor of its place.
    """
    data, starts, lengths, owner = word_slices(texts, IN_WORD, b" ")
    ends = np.cumsum(lengths)
    offsets = np.r_[0, ends].astype(np.int64)
    kept = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w, 42) for w in found.dictionary.to_pylist()], np.uint64)
    hashed = known[found.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint64)
    n = np.bincount(owner, minlength=len(texts))
    size = max(0, len(hashed) - words + 1)
    sums = np.zeros(size, np.uint64)
    for k in range(words):
        sums += hashed[k : k + size] * FACTORS[k]
    sums = _mixed(sums)
    first = np.cumsum(n) - n
    out = []
    for at, count in zip(first.tolist(), n.tolist(), strict=True):
        if count >= words:
            out.append(np.unique(sums[at : at + count - words + 1]))
        else:
            short = (hashed[at : at + count] * FACTORS[:count]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mixed(short + np.uint64(count)) if count else short[:0])
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


def slot_levels(texts: DataFrame, words: int) -> np.ndarray:
    """How frequent the shingles of each slot are over all rows, in eighths of a power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in slices(batches):
            found = [_slot(s) for s in shingles(encoded(batch), words)]
            if found:
                counts += np.bincount(np.concatenate(found), minlength=SLOTS)
        parts = counts.reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["part", "counts"])

    kind = "part long, counts binary"
    counts = np.zeros(SLOTS, np.int64)
    for row in texts.select("text").mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).toLocalIterator():
        counts[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(row["counts"], np.int64)
    return np.round(8 * np.log2(counts + 1.0)).astype(np.int16)


def bitmap(hashes: np.ndarray) -> bytes:
    width = max(BITS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else BITS
    bits = np.zeros(width, np.uint8)
    bits[(hashes >> np.uint64(32)).astype(np.int64) % width] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def prefix(hashes: np.ndarray, levels: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """The rarest shingles, of which two linked sets share one."""
    length = len(hashes) - -(-numerator * len(hashes) // denominator) + 1
    return hashes[np.lexsort((hashes, levels[_slot(hashes)]))[:length]]


SKETCH = "doc_id long, a long, b long, node long, size long, bits binary, prefix array<long>"


def _sketched(texts: DataFrame, levels: np.ndarray, words: int, numerator: int, denominator: int) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(encoded(batch), words)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            first = [prefix(s, levels, numerator, denominator).view(np.int64) if len(s) else [] for s in sets]
            own = record(schema, [nodes, [len(s) for s in sets], [bitmap(s) for s in sets], first])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "a", "b")], *own.columns], names=["doc_id", "a", "b", *schema.names])

    return texts.mapInArrow(run, SKETCH)


class Leaves:
    """Sets of a block: node, label of the component, size, bitmaps, and (where they are at hand) the hashes.

    The bitmaps are bytes of any width, or rows of words of one width.
    """

    def __init__(self, node, label, size, bits, sets):
        self.node, self.label, self.size, self.bits, self.sets = node, label, size, bits, sets

    def take(self, at: np.ndarray) -> Leaves:
        bits = self.bits[at] if isinstance(self.bits, np.ndarray) else [self.bits[i] for i in at.tolist()]
        return Leaves(self.node[at], self.label[at], self.size[at], bits, self.sets and [self.sets[i] for i in at.tolist()])

    def by_width(self) -> dict[int, Leaves]:
        """The leaves of each width of bitmap, as rows of words."""
        width = np.array([len(b) for b in self.bits])
        out = {}
        for w in np.unique(width).tolist():
            part = self.take(np.flatnonzero(width == w))
            part.bits = np.frombuffer(b"".join(part.bits), np.uint64).reshape(len(part.size), -1)
            out[w] = part.ordered()
        return out

    def folded(self) -> Leaves:
        """The same with bitmaps of half the width."""
        half = self.bits.shape[1] // 2
        return Leaves(self.node, self.label, self.size, self.bits[:, :half] | self.bits[:, half:], self.sets)

    def ordered(self) -> Leaves:
        """Members of a component side by side, components by their least size."""
        least = np.full(int(self.label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, self.size)
        return self.take(np.lexsort((self.size, self.label, least[self.label])))

    def tree(self) -> list[tuple]:
        """Levels of (bitmap, least and greatest size, largest excess, least and greatest label), leaves first."""
        excess = self.size - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        out = [(self.bits, self.size, self.size, excess, self.label, self.label)]
        while len(out[-1][1]) > 2 * FAN:
            bits, low, high, excess, first, last = out[-1]
            at = np.arange(0, len(low), FAN)
            out.append((
                np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(excess, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at),
            ))
        return out


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Whether nodes i of a level and j of another may hold linked sets of different components."""
    low_a, high_a, low_b, high_b = a[1][i], a[2][i], b[1][j], b[2][j]
    most = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][i], b[3][j])
    most = np.minimum(most, np.minimum(high_a, high_b))
    fit = most * (numerator + denominator) >= numerator * (low_a + low_b)
    fit &= (denominator * high_a >= numerator * low_b) & (denominator * high_b >= numerator * low_a)
    return fit & ~((a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j]))


def _children(at: np.ndarray, level: int, size: int) -> np.ndarray:
    """A row of children for each node; -1 where there are less."""
    if level == 0:
        return at[:, None]
    out = at[:, None] * FAN + np.arange(FAN)
    return np.where(out < size, out, -1)


def walk(one: list[tuple], other: list[tuple] | None, numerator: int, denominator: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that the trees cannot rule out, each once; of one tree with itself if there is no other."""
    two = one if other is None else other
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(one[-1][1])), np.arange(len(two[-1][1])), indexing="ij"))
    stack = [(len(one) - 1, len(two) - 1, i, j)]
    while stack:
        at, to, i, j = stack.pop()
        if len(i) > STEP:
            stack.append((at, to, i[STEP:], j[STEP:]))
            i, j = i[:STEP], j[:STEP]
        if other is None:
            once = i < j if at == 0 else i <= j
            i, j = i[once], j[once]
        fit = _possible(one[at], two[to], i, j, numerator, denominator)
        i, j = i[fit], j[fit]
        if not len(i):
            continue
        if at == to == 0:
            yield i, j
            continue
        below_i = _children(i, at, len(one[max(at - 1, 0)][1]))
        below_j = _children(j, to, len(two[max(to - 1, 0)][1]))
        both = np.broadcast_arrays(below_i[:, :, None], below_j[:, None, :])
        i, j = both[0].ravel(), both[1].ravel()
        real = (i >= 0) & (j >= 0)
        stack.append((max(at - 1, 0), max(to - 1, 0), i[real], j[real]))


def _sides(one: Leaves, other: Leaves | None) -> Iterator[tuple[Leaves, Leaves | None]]:
    """What to walk: linked sets have bitmaps of one width, or one of twice the other's."""
    mine = one.by_width()
    theirs = mine if other is None else other.by_width()
    for width, part in mine.items():
        if other is None:
            yield part, None
        elif width in theirs:
            yield part, theirs[width]
        if 2 * width in theirs:
            yield part, theirs[2 * width].folded()
        if other is not None and 2 * width in mine and width in theirs:
            yield mine[2 * width].folded(), theirs[width]


def forest(one: Leaves, other: Leaves | None, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links between nodes of different components that join all which are linked; labels are numbers from 0.

    Without hashes every pair that the bitmaps let pass counts as linked. The ratio must be over 1 / 2.
    """
    root = np.arange(1 + max(int(one.label.max()), -1 if other is None else int(other.label.max())))
    out = []
    for mine, theirs in _sides(one, other):
        two = mine if theirs is None else theirs
        for i, j in walk(mine.tree(), None if theirs is None else theirs.tree(), numerator, denominator):
            apart = root[mine.label[i]] != root[two.label[j]]
            for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                a, b = root[mine.label[x]], root[two.label[y]]
                if a == b:
                    continue
                if mine.sets is not None:
                    s, t = mine.sets[x], two.sets[y]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if common * (numerator + denominator) < numerator * (len(s) + len(t)):
                        continue
                root[root == b] = a
                out.append((int(mine.node[x]), int(two.node[y])))
    return out


def _compared(blocks: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (u, v) of blocks (g, i, j): a block's own rows with each other if i = j, else those at home with the others."""
    exact = "hashes" in blocks.columns
    names = ["g", "i", "j", "home", "node", "root", "size", "bits", *(["hashes"] if exact else [])]

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        node, root, size = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6))
        label = np.unique(root, return_inverse=True)[1]
        leaves = Leaves(node, label, size, [r[7] for r in rows], [np.frombuffer(r[8], np.uint64) for r in rows] if exact else None)
        if rows[0][1] == rows[0][2]:
            return forest(leaves, None, numerator, denominator)
        home = np.array([r[3] for r in rows])
        if home.all() or not home.any():
            return []
        return forest(leaves.take(np.flatnonzero(home)), leaves.take(np.flatnonzero(~home)), numerator, denominator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if kept and kept[0][:3] != row[:3]:
                    found.extend(links(kept))
                    kept = []
                kept.append(row)
            yield record(LINKS, list(zip(*found, strict=True)) if found else [[], []])
        if kept:
            found = links(kept)
            yield record(LINKS, list(zip(*found, strict=True)) if found else [[], []])

    return blocks.select(*names).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "u long, v long")


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _stars(pairs: DataFrame, budget: int) -> DataFrame:
    """Blocks (g, i, j, home, node, root) that compare each centre with its nodes (node, centre, weight), in parts of about `budget`."""
    parts = pairs.groupBy("centre").agg(F.ceil(F.sum("weight") / budget).cast("int").alias("parts")).select(F.col("centre").alias("g"), "parts")
    zero = F.lit(0).alias("i")
    others = pairs.join(parts, F.col("centre") == F.col("g")).select(
        "g", zero, (F.pmod(F.xxhash64("node"), F.col("parts")) + 1).cast("int").alias("j"), F.lit(False).alias("home"), "node")
    homes = parts.select("g", zero, F.explode(F.sequence(F.lit(1), "parts")).alias("j"), F.lit(True).alias("home"), F.col("g").alias("node"))
    return homes.union(others).withColumn("root", F.col("node"))


def _chunks(rows: DataFrame, budget: int) -> DataFrame:
    """Blocks (g, i, j, home, node, root) of groups (g, node, root, weight): one for a group of up to `budget`, else pairs of chunks.

    The members of a group's largest component are chunks that do not meet each other.
    """
    sizes = rows.groupBy("g", "root").agg(F.sum("weight").alias("w")).groupBy("g").agg(F.sum("w").alias("all"), F.max(F.struct("w", "root")).alias("top"))
    large = sizes.filter(F.col("all") > budget).select(
        F.col("g").alias("_g"), F.col("top.root").alias("_root"),
        F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.w")) / budget)).cast("int").alias("p"),
        F.ceil(F.col("top.w") / budget).cast("int").alias("q"),
    )
    dealt = rows.join(large, F.col("g") == F.col("_g"), "left")
    h = F.xxhash64("node")
    own = F.when(F.col("root") == F.col("_root"), F.col("p") + F.pmod(h, F.col("q"))).otherwise(F.pmod(h, F.col("p"))).cast("int")
    dealt = dealt.withColumn("k", F.coalesce(own, F.lit(0))).withColumns({"p": F.coalesce("p", F.lit(1)), "q": F.coalesce("q", F.lit(0))})

    def at(i, j, home):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(home).alias("home"))

    # chunk k meets itself and the later ones at home, and the earlier ones as the other side
    k, none = F.col("k"), F.array().cast("array<struct<i: int, j: int, home: boolean>>")
    later = F.when(k < F.col("p"), F.transform(F.sequence(k, F.col("p") + F.col("q") - 1), lambda j: at(k, j, True))).otherwise(none)
    last = F.least(k, F.col("p")) - 1
    earlier = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: at(i, k, False))).otherwise(none)
    return dealt.withColumn("_at", F.explode(F.concat(later, earlier))).select("g", "_at.i", "_at.j", "_at.home", "node", "root")


def _sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, from one text each."""
    keys = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "node")
    keys = stored(keys)
    if keys.count() <= MOST_KEYS:
        keys = F.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in shingles(encoded(batch), words)], pa.binary())], names=["node", "hashes"])

    found = texts.join(keys, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("node", "text")
    return stored(found.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"]))


def jaccard_components(docs: DataFrame, words: int = 4, numerator: int = 85, denominator: int = 100, most: int = MOST, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs`: set size and least id reachable over links."""
    if 2 * numerator <= denominator:
        raise ValueError("the ratio must be over one half")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("a", F.xxhash64("doc_id", "text")).withColumn("b", F.xxhash64(F.lit(1), "text", "doc_id"))
    rows = stored(_sketched(texts, slot_levels(texts, words), words, numerator, denominator))
    nodes = stored(rows.filter("size > 0").dropDuplicates(["node"]))
    light = nodes.select("node", "size", "bits")

    entries = nodes.select("node", F.explode("prefix").alias("token"))
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.min("node").alias("centre")]
    shared = entries.groupBy("token").agg(*members).filter("n > 1")
    groups = stored(shared.groupBy("n", "x", "y").agg(F.min("token").alias("g"), F.count(F.lit(1)).alias("tokens"), F.min("centre").alias("centre")).select("g", "tokens", "centre"))
    meet = stored(entries.join(groups, F.col("token") == F.col("g")).select("g", "node", "tokens", "centre"))

    def compared(blocks: DataFrame) -> DataFrame:
        return stored(_compared(blocks, numerator, denominator))

    # 1. each node with the centre that it shares most with
    votes = meet.filter("node <> centre").groupBy("node", "centre").agg(F.sum("tokens").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", "centre")).alias("m")).select("node", F.col("m.centre").alias("centre"), F.lit(1).alias("weight"))
    near = compared(_stars(best, most).join(light, "node"))
    ends = near.select(F.col("u").alias("node")).union(near.select(F.col("v").alias("node")))
    read = _sets(texts, nodes, ends, words)
    full = light.join(read, "node")
    pairs = near.select(F.col("v").alias("node"), F.col("u").alias("centre")).join(light.select("node", F.col("size").alias("weight")), "node")
    links = compared(_stars(pairs, most_shingles).join(full, "node"))
    roots = stored(components(links))

    # 2. groups of several components, by their bitmaps
    named = meet.join(roots, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("g")
    light_rows = named.join(mixed, "g", "left_semi").withColumn("weight", F.lit(1))
    maybe = compared(_chunks(stored(light_rows), most).join(light, "node"))

    # 3. candidates that hold several components, by their sets
    joined = stored(components(links.union(maybe)).withColumnRenamed("root", "g"))
    touched = joined.join(maybe.select(F.col("u").alias("node")), "node", "left_semi").select("g").distinct()
    inside = joined.join(touched, "g", "left_semi").join(roots, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root"))
    inside = stored(inside.join(light.select("node", F.col("size").alias("weight")), "node"))
    read = read.union(_sets(texts, nodes, inside.join(read, "node", "left_anti"), words))
    more = compared(_chunks(inside, most_shingles).join(light.join(read, "node"), "node"))

    final = stored(components(links.union(more)))
    classes = rows.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(final, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select(F.col("node").alias("_node"), "component_id")
    own = rows.select("doc_id", "size", F.when(F.col("size") > 0, F.col("node")).alias("node"))
    found = own.join(named, F.col("node") == F.col("_node"), "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
