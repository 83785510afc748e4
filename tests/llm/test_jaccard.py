import itertools
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from packetlens.llm import jaccard, queries

from .conftest import SF


def sets_of(texts, words=4):
    out = []
    for text in texts:
        found = (text or "").encode().lower().split()
        out.append({b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    return out


def by_hand(rows, words=4, numerator=85):
    """Sorted (doc_id, set size, component) of (doc_id, text) rows, over all pairs that share a shingle."""
    sets, root = sets_of([t for _, t in rows], words), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        for x in own:
            holders[x].append(i)
    common = Counter(pair for held in holders.values() for pair in itertools.combinations(held, 2))
    for (i, j), n in common.items():
        if 100 * n >= numerator * (len(sets[i]) + len(sets[j]) - n):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min((k for k in (least.get(find(i)), key) if k is not None), default=None)
    return sorted(((key, len(sets[i]), least[find(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)), key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_registered_query_against_all_pairs_and_sql(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = rows_of(queries.QUERIES["op12_ngram_jaccard_join"](spark, sf))
    assert found == by_hand(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(db.execute(queries.ORACLE["op12_ngram_jaccard_join"]).fetchall(), key=str) == found


def clusters(seed=3):
    """Near copies of templates, a chain, texts that share half of their words, and pairs just at and just below the limit."""
    rng = random.Random(seed)
    texts = []
    for k in range(3):
        base = [f"t{k}w{i}" for i in range(150)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    line = [f"c{i}" for i in range(200)]
    texts += [" ".join(line[i * 10 :]) for i in range(8)]
    texts += [" ".join(line[:60] + [f"y{k}_{i}" for i in range(60)]) for k in range(40)]
    # 100 shingles; 85 of them make 85 %, 84 do not
    limit = [f"l{i}" for i in range(103)]
    texts += [" ".join(limit), " ".join(limit[:88]), " ".join([f"m{i}" for i in range(103)]), " ".join([f"m{i}" for i in range(87)])]
    return texts


@pytest.mark.parametrize("most", [(4096, 1 << 21), (7, 500), (1, 1)])
def test_clusters_in_one_task_and_in_chunks(spark, odd, most):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(clusters())]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS size", "true AS component_id", "2 AS g").repartition(3)
    assert rows_of(jaccard.jaccard_components(frame, most=most[0], most_shingles=most[1])) == by_hand(rows)


def test_other_settings_and_empty_tables(spark, empty):
    rows = list(enumerate(clusters(5)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.jaccard_components(frame, words=2, numerator=60)) == by_hand(rows, 2, 60)
    assert jaccard.jaccard_components(empty).collect() == []
    assert rows_of(jaccard.jaccard_components(frame.limit(3).selectExpr("doc_id", "' ' AS text"))) == [(i, 0, i) for i in range(3)]


def leaves_of(sets):
    return jaccard.Leaves(np.arange(len(sets)), np.arange(len(sets)), np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets], sets)


def walked(one, other=None):
    return {
        (int(mine.node[a]), int((mine if theirs is None else theirs).node[b]))
        for mine, theirs in jaccard._sides(one, other)
        for i, j in jaccard.walk(mine.tree(), None if theirs is None else theirs.tree(), 85, 100) for a, b in zip(i, j, strict=True)
    }


def test_walk_loses_no_link_and_prunes():
    rng = np.random.default_rng(4)
    pools = [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in rng.choice([20, 300, 540, 1080], 30)]
    sets = [np.sort(rng.choice(p, int(rng.integers(len(p) * 8 // 10, len(p) + 1)), replace=False)) for p in pools for _ in range(20)]
    sets += [np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)) for _ in range(5)]
    linked = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[i], sets[j]))
        if 185 * n >= 85 * (len(sets[i]) + len(sets[j])):
            linked.add((i, j))
    assert len(linked) > 300
    all_leaves = leaves_of(sets)
    assert len({len(b) for b in all_leaves.bits}) > 3 and max(len(part.tree()) for part in all_leaves.by_width().values()) > 2
    met = {tuple(sorted(p)) for p in walked(all_leaves)}
    assert linked <= met and len(met) < len(sets) ** 2 / 20
    one, two = all_leaves.take(np.arange(0, 300)), all_leaves.take(np.arange(300, len(sets)))
    assert {(i, j) for i, j in linked if i < 300 <= j} <= walked(one, two)
    found = jaccard.forest(all_leaves, None, 85, 100)
    assert {tuple(sorted(p)) for p in found} <= linked
    root = list(range(len(sets)))
    for links in (found, linked):
        before = list(root)
        for i, j in links:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        merged = len(set(before)) - len(set(root))
        assert merged == (len(found) if links is found else 0)


def test_shingles_of_batches():
    texts = [b"", b" \t", b"One two", b"one TWO three four", b"one two three four five one two three four", "Größe 漢字 a b c".encode(), b"w " * 100_000]
    found = jaccard.shingles(texts, 4)
    assert [len(s) for s in found] == [0, 0, 1, 1, 5, 2, 1]
    for text, own in zip(texts, found, strict=True):
        assert jaccard.shingles([text], 4)[0].tolist() == own.tolist()
    assert set(found[3].tolist()) < set(found[4].tolist()) and jaccard.shingles([], 4) == []
    assert jaccard.shingles([b"b a", b"a b", b"a", b"a a"], 4) != jaccard.shingles([b"a b"] * 4, 4)
