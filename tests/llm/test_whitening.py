from fractions import Fraction
from math import floor

import numpy as np
import pytest
from packetlens.llm import queries, whitening

from .conftest import SF


def by_hand(rows):
    """n, deviation of each row, exact covariances, in plain integers and fractions."""
    xs = [[floor(64 * float(c)) + 1_000_000 for c in r] for r in rows]
    n, dims = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(dims)]
    off = [[n * x[i] - sums[i] for i in range(dims)] for x in xs]
    cov = [[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(dims)] for i in range(dims)]
    return n, [sum(v * v for v in o) for o in off], np.array(cov), np.array(off, float) / n


def check(found, ids, rows, most=32):
    n, deviations, cov, centred = by_hand(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    values, axes = values[values > 1e-9 * values[0]], axes[:, values > 1e-9 * values[0]]
    want = centred @ axes / np.sqrt(values)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(rows) * len(values) and sorted(got) == sorted(ids)
    place = {key: k for k, key in enumerate(ids)}
    signs = None
    for key, parts in got.items():
        k = place[key]
        line = np.array([parts[c + 1].whitened for c in range(len(values))])
        signs = np.where(line * want[k] < 0, -1, 1) if signs is None else signs
        assert {(r.n, int(r.deviation)) for r in parts.values()} == {(n, deviations[k])}
        assert np.allclose(line * signs, want[k], atol=1e-6)
        assert np.allclose([parts[c + 1].explained for c in range(len(values))], values / np.trace(cov), rtol=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-7


def test_registered_query_against_exact_fractions(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    found = queries.QUERIES["op13_embedding_whitening"](spark, SF).collect()
    check(found, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=3).tolist() for _ in range(40)]
    good.append([float(2**15), -float(2**16), 3.0])
    rows = [(i, v, "x", 1) for i, v in enumerate(good)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0]), (93, [1.0, float("-inf"), 0.0]), (94, [1.0]), (95, []), (96, [1.0] * 4)]
    frame = spark.createDataFrame([*rows, *[(*b, None, None) for b in bad]], "vec_id long, embedding array<double>, n string, component int").repartition(5)
    check(whitening.whiten(frame).collect(), list(range(41)), good)
    assert len(whitening.whiten(frame, most=2).collect()) == 82
    assert whitening.whiten(frame.filter("vec_id >= 90 and vec_id < 94")).collect() == []
    assert whitening.whiten(frame.filter("false")).collect() == [] and whitening.whiten(frame.filter("vec_id = 3")).collect() == []
    # a null id and repeated rows are rows; the third dimension repeats the first, so one component is missing
    twice = [(None, [1.0, 5.0, 1.0]), (1, [2.0, 1.0, 2.0]), (1, [2.0, 1.0, 2.0]), (2, [-1.0, 0.0, -1.0])]
    found = whitening.whiten(spark.createDataFrame(twice, "vec_id long, embedding array<float>")).collect()
    assert len(found) == 8 and sum(r.vec_id is None for r in found) == 2 and found[0].identity_error < 1e-7


@pytest.mark.parametrize("size", [10, 1 << 30])
def test_squares_are_exact(size):
    rng = np.random.default_rng(2)
    d = rng.integers(-size, size, (50, 4))
    i, j = whitening.pair_numbers(4)
    want = [sum((int(r[a]) if a == b else int(r[a]) + int(r[b])) ** 2 for r in d) for a, b in zip(i, j, strict=True)]
    assert whitening.squares_of(d).tolist() == want
    low, middle, high = whitening._limbs(-(7**40))
    assert whitening._whole({"low": low, "middle": middle, "high": high}) == -(7**40)
