"""Whitening against NumPy on the whole list at once."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rowparity.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, whitened string, x string"


def frame(spark, vectors, partitions=3):
    return spark.createDataFrame([(i, v, 0, "-", "-", "-") for i, v in enumerate(vectors)], SCHEMA).repartition(partitions)


def expected(vectors, components=4):
    """By definition: exact whole numbers, one covariance, one eigh."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    listed = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(listed), listed.sum(axis=0)
    mean = np.array([float(Fraction(int(s), n)) for s in sums])
    centred = listed.astype(float) - mean
    covariance = centred.T @ centred / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * c - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    return n, deviation, (np.array(x, dtype=float) - mean) @ v[:, :components] / np.sqrt(e[:components]), e[:components] / np.trace(covariance)


@pytest.mark.parametrize("spread", [1.0, 40.0, 3e3])
def test_as_numpy(spark, spread):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(90, 6)) * np.array([5, 3, 2, 1, 0.5, 0.2]) * spread + 100
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 200 + [base[1].tolist()] * 5
    n, deviation, whitened, share = expected(vectors)
    rows = whitening.by_component(frame(spark, vectors)).collect()
    assert len(rows) == 4 * len(vectors) and {r["n"] for r in rows} == {n}
    assert all(r["identity_error"] < 1e-9 for r in rows) and len({r["identity_error"] for r in rows}) == 1
    got = np.zeros((len(vectors), 4))
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9)
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.allclose(got * sign, whitened, rtol=1e-8, atol=1e-8)


def test_copies_count_once(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(30, 5)).tolist()
    once = whitening.fit(frame(spark, vectors))
    often = whitening.fit(frame(spark, vectors + vectors[:3] * 100))
    assert once.n == often.n and once.sums == often.sums and np.allclose(once.values, often.values)


def test_odd_rows(spark):
    good = [[1.0, 2.0], [2.0, 5.0], [0.5, -1.0], [-0.0, 0.0]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)] + [(None, good[0])], "vec_id long, embedding array<float>")
    found = whitening.by_component(rows).collect()
    assert sorted({r["vec_id"] for r in found}, key=str) == [0, 1, 2, 3, None] and len(found) == 10
    assert {r["n"] for r in found} == {4} and max(r["component"] for r in found) == 2


def test_without_variance(spark):
    rows = whitening.by_component(frame(spark, [[1.0, 2.0, 3.0]] * 4)).collect()
    assert len(rows) == 12 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in rows)
    flat = whitening.by_component(frame(spark, [[1.0, k, 3.0] for k in (0.0, 1.0, 5.0)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and flat[0]["identity_error"] < 1e-12
    assert whitening.by_component(frame(spark, [[1.0]]).where("false")).count() == 0


def test_sums_beyond_64_bits_are_exact(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [1e17, 3.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(rows)
    x = [[(1 << 63) - 1, 256], [-(1 << 63), 512], [math.floor(256 * 1e17) if 256 * 1e17 < 2**63 else (1 << 63) - 1, 768]]
    assert model.n == 3 and model.sums == tuple(map(sum, zip(*x)))
    assert {r["deviation"] for r in whitening.transform(rows, model).collect()} == {None}


def test_packing_is_lossless():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-(1 << b), 1 << b, size=(20, 5)) for b in (3, 7, 8, 15, 16, 31, 32, 62)])
    assert np.array_equal(whitening.unpack(whitening.pack(x), 5), x)
    assert whitening.pack(np.array([[-128, 127]]))[0] == bytes([128, 127]) and len(whitening.pack(np.array([[-129, 127]]))[0]) == 4
