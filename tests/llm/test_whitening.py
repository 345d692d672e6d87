"""Whitening next to numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.whitening import polar_factor, spectral_components, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=24), st.integers(0, 2**31))
def test_components_of_any_spectrum(values, seed):
    a = symmetric(values, seed)
    a = (a + a.T) / 2
    found, axes = spectral_components(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.allclose(found, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-13 * size * len(a))
    assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-12
    assert np.linalg.norm(a @ axes - axes * found) < 1e-12 * size * len(a)


@pytest.mark.parametrize(
    "values",
    [[1.0] * 6, [0.0] * 5, [2.0] * 4 + [1.0] * 4, [1, 1e-8, 1e-12, 0, 0], [5, 5, 5, 5 + 1e-13, 1], list(range(128)), [3.0]],
)
def test_equal_close_and_vanishing_eigenvalues(values):
    a = symmetric(values, 7)
    found, axes = spectral_components((a + a.T) / 2)
    assert np.allclose(found, np.sort(np.array(values, float))[::-1], atol=1e-12 * max(1, *values))
    assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-12


def test_polar_factor_of_badly_conditioned_matrix():
    a = symmetric([1, 1e-5, -1e-10, -1], 3)
    u = polar_factor(a)
    assert np.abs(u @ u.T - np.eye(4)).max() < 1e-12
    assert np.linalg.eigvalsh(u @ a).min() > -1e-15  # the other factor is not negative


def brute(rows, components=8):
    """Expected rows by vec_id and component, from numpy's own decomposition."""
    by_length = {}
    for vec_id, e, _ in rows:
        if e and all(v is not None and math.isfinite(v) for v in e):
            by_length.setdefault(len(e), []).append((vec_id, [math.floor(1024 * float(np.float32(v))) + 100000 for v in e]))
    out = {}
    for length, held in by_length.items():
        n, sums = len(held), [sum(x[i] for _, x in held) for i in range(length)]
        z = np.array([[(n * x[i] - sums[i]) / n for i in range(length)] for _, x in held])
        values, axes = np.linalg.eigh(z.T @ z / n)
        values, axes = values[::-1], axes[:, ::-1]
        for k in range(min(components, int((values > 1e-12 * max(values[0], 0)).sum()) if values[0] > 0 else 0)):
            for (vec_id, x), white in zip(held, z @ axes[:, k] / math.sqrt(values[k]), strict=True):
                deviation = sum((n * x[i] - sums[i]) ** 2 for i in range(length))
                out[vec_id, k + 1] = (n, deviation, white, values[k] / values.sum())
    return out


def check(found, wanted):
    got = {(r.vec_id, r.component): r for r in found}
    assert set(got) == set(wanted) and len(got) == len(found)
    signs = {}
    for key in sorted(wanted, key=lambda k: -abs(wanted[k][2])):
        n, deviation, white, explained = wanted[key]
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error <= 1e-8
        sign = signs.setdefault((n, key[1]), math.copysign(1, r.whitened * white))
        assert r.whitened == pytest.approx(sign * white, abs=1e-7)


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 0) for r in table.collect()]
    check(whiten(table).collect(), brute(rows))


def test_unusable_rows_and_two_lengths(make):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.standard_normal(5) * [9, 5, 3, 2, 1]], 0) for i in range(40)]
    rows += [(100 + i, [float(v) for v in rng.standard_normal(3) * [4, 2, 1]], 0) for i in range(30)]
    rows += [(200, None, 0), (201, [], 0), (202, [1.0, None, 2.0], 0), (203, [1.0, float("nan"), 2.0], 0)]
    rows += [(204, [float("inf")] * 5, 0), (205, [1.0, 2.0, 3.0, 4.0], 0)]  # one of its length: no component
    wanted = brute(rows)
    found = whiten(make(rows, SCHEMA)).collect()
    check(found, wanted)
    assert {r.vec_id for r in found} == set(range(40)) | set(range(100, 130))


def test_ties_repeats_and_null_ids(make):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [3.0, 1.0], 0), (4, [1.5, 0.0], 0)]
    found = whiten(make(rows, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found) == sorted(
        (v is None, v or 0, c) for v, _, _ in rows for c in (1, 2)
    )
    assert all(r.n == 4 and r.identity_error < 1e-9 for r in found)
    equal = [(i, [0.5, 0.25], 0) for i in range(6)]
    assert whiten(make(equal, SCHEMA)).count() == 0


def test_deviation_is_exact_and_null_beyond_a_long(make):
    rows = [(i, [float(2**20 * (i % 7)), float(i)], 0) for i in range(50)]
    wanted = brute(rows)
    assert {(r.vec_id, r.component): r.deviation for r in whiten(make(rows, SCHEMA)).collect()} == {
        k: v[1] if v[1] < 2**63 else None for k, v in wanted.items()
    }
    huge = [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 3.0], 0)]
    assert all(r.deviation is None for r in whiten(make(huge, SCHEMA)).filter("vec_id < 3").collect())


def test_empty_table(make):
    assert whiten(make([], SCHEMA)).collect() == []


def test_more_components_may_be_asked_for(make):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.standard_normal(12)], 0) for i in range(60)]
    found = whiten(make(rows, SCHEMA), components=12).collect()
    check(found, brute(rows, components=12))
    assert sum(r.explained for r in found if r.vec_id == 0) == pytest.approx(1)
