import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

from packetlens.llm import components, exact, simhash


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        text = r.text or ""
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", text).encode()).hexdigest()
        groups[key].append((-len(text), r.doc_id is None, r.doc_id or 0, i))
    out = []
    for key, members in groups.items():
        members.sort()
        first = None if members[0][1] else members[0][2]
        out += [(rows[m[3]].doc_id, first, len(members), k == 0, key) for k, m in enumerate(members)]
    return sorted(out, key=str)


def exact_rows(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exact.exact_duplicates(frame).collect()), key=str)


def test_exact_against_brute_force(docs, odd, empty):
    assert exact_rows(docs[0]) == exact_by_hand(docs[1])
    assert exact_rows(odd) == exact_by_hand(odd.collect())
    assert exact_rows(empty) == []


def test_exact_does_not_depend_on_history_or_shards(odd, docs):
    from pyspark.sql import functions as F

    want = exact_rows(docs[0])
    for history, shard in ((F.lit(True), 10), (F.lit(False), 100), (F.col("doc_id") < 50, 7)):
        got = exact.exact_duplicates(docs[0], history, shard)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got.collect()), key=str) == want


def test_minimal_perfect_hash_has_one_slot_per_digest():
    rng = np.random.default_rng(1)
    digest = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    levels = exact.build_hash(digest)
    assert sorted(exact.slots_of(levels, digest)) == list(range(5000))


def fingerprint_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_by_hand(rows):
    prints = [fingerprint_by_hand(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)].append(r.doc_id)
    return sorted(((r.doc_id, prints[i], min(least[find(i)], default=None)) for i, r in enumerate(rows)), key=str)


def simhash_rows(frame, **more):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(frame, **more).collect()), key=str)


def test_simhash_against_brute_force(docs, odd, empty):
    assert simhash_rows(docs[0]) == linked_by_hand(docs[1])
    assert simhash_rows(odd) == linked_by_hand(odd.collect())
    assert simhash_rows(empty) == []


def links_by_hand(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def test_anchors_miss_no_link_and_hot_anchors_are_cut(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(2**63), 2**63, 6)
    prints = set()
    for i in range(700):  # a few dense clouds around shared centres
        p = int(centres[i % 6]) % 2**64
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            p ^= 1 << int(bit)
        prints.add(p - 2**64 if p >= 2**63 else p)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    want = links_by_hand(prints)
    for most in (2048, 20):
        found = components.components(simhash.fingerprint_links(frame, most=most)).collect()
        got = {p: p for p in prints} | {r.node: r.root for r in found}
        assert got == want


def test_each_word_has_its_anchors():
    rng = np.random.default_rng(4)
    word = rng.integers(0, 2**31, 200).astype(np.uint64)
    rows, anchor, home = simhash.anchors(word)
    away = np.bitwise_count(word[rows] ^ anchor)
    assert (away <= np.where(home, 1, 2)).all()
    assert len(np.unique(np.stack([rows.astype(np.uint64), anchor]), axis=1).T) == len(rows)
    assert (simhash.anchors(anchor)[0] == np.arange(len(anchor))).all()  # an anchor has no other within 2


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(200, 200), (301, 300), (300, 301)]
    found = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {300: 300, 301: 300}
    assert {r.node: r.root for r in found} == want


def test_one_row_repeated_many_times(spark):
    one = spark.range(25_000).selectExpr("CAST(7 AS BIGINT) AS doc_id", "'same  text' AS text").union(spark.createDataFrame([(3, "same text"), (None, "x")], "doc_id long, text string"))
    got = exact.exact_duplicates(one)
    assert got.count() == 25_002 and got.filter("kept").count() == 2
    assert got.filter("kept and keep_id = 7 and group_size = 25001").count() == 1
