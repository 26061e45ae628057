"""Whitening against exact fractions, numpy's eigenvectors, and matrices of known eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pulseloom.llm import whitening as wh


def leverrier(a):
    """Coefficients (constant first) of det(xI - a) by traces of powers."""
    d = len(a)
    m, c = np.zeros((d, d), object), [0] * d + [1]
    eye = np.eye(d, dtype=int).astype(object)
    for k in range(1, d + 1):
        m = a @ m + c[d - k + 1] * eye
        c[d - k] = -int((a @ m).trace()) // k
    return c


def test_gram_is_exact():
    rng = np.random.default_rng(3)
    for most in (3, 1 << 15, 1 << 40, wh.FAR):
        x = rng.integers(-most, most, (5000 if most == 3 else 60, 5), endpoint=True)
        x[0] = most
        y = x.astype(object)
        assert (wh.exact_gram(x) == y.T @ y).all()
        assert (wh.unpacked([wh.packed(v) for v in x], 5) == x).all()


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_characteristic_polynomial(spark, d):
    rng = np.random.default_rng(d)
    for low in (0, 1):  # of full rank, and of lower rank with entries that vanish
        x = rng.integers(-9, 9, (max(1, d - low * 2), d)).astype(object)
        x[:, : low * (d // 2)] = 0
        a = x.T @ x + (0 if low else np.eye(d, dtype=int).astype(object))
        assert wh.characteristic(spark, a) == leverrier(a)


def test_roots_with_multiplicity():
    poly = [1]
    for r in (2, 3, 3, 3, 7, 7, 1000):  # times (x - r)
        poly = [b - r * a for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    for k, want in enumerate((1000, 7, 7, 3, 3, 3, 2), 1):
        t, scale = wh.root(poly, k, 1026)
        assert abs(Fraction(t, 1 << scale) - want) < Fraction(1, 1 << 95)
        assert wh.roots_above(poly, want, 0) == sum(r > want for r in (2, 3, 3, 3, 7, 7, 1000))


def test_null_space_of_a_repeated_eigenvalue(spark):
    h = np.array([[1]], object)
    for _ in range(3):
        h = np.block([[h, h], [h, -h]]).astype(object)
    a = h @ np.diag(np.array([5, 5, 5, 2, 2, 1, 0, 0], object)) @ h.T  # eigenvalues times 8
    found = wh.components(spark, a, 5)
    assert [round(t / 2**s, 9) for t, s, _ in found] == [40, 40, 40, 16, 16]
    v = np.array([v for _, _, v in found])
    assert np.abs(v @ v.T - np.eye(5)).max() < 1e-15
    assert np.abs(v @ a.astype(float) - np.array([[40], [40], [40], [16], [16]]) * v).max() < 1e-13


def brute(rows, many=16):
    """n, grid vectors, and covariance in fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    fit = [list(v) for v in sorted({tuple(v) for v in x})]
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = [[sum(Fraction(n * v[i] - s[i], n) * Fraction(n * v[j] - s[j], n) for v in fit) / n for j in range(d)] for i in range(d)]
    return x, n, s, cov


def test_table_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [tuple(float(c) for c in v) for v in (rng.normal(0, 0.2, (70, 6)) @ rng.normal(0, 1, (6, 6))).astype(np.float32)]
    rows += rows[:9] + [rows[3]] * 40
    table = [(i, list(v), "x") for i, v in enumerate(rows)] + [(900, None, "x"), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (902, [math.nan] * 6, "x"), (903, [math.inf] + [0.0] * 5, "x"), (904, [1.0, 2.0], "x"), (None, list(rows[0]), "x")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, n string").repartition(3)
    got = wh.whitened(df).collect()
    x, n, s, cov = brute(rows)
    trace = float(sum(cov[i][i] for i in range(6)))
    e, v = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == (len(rows) + 2) * 6 and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, 7):
        sign = np.sign(by[0, c].whitened * sum((x[0][j] - s[j] / n) * v[j, c - 1] for j in range(6)))
        assert by[0, c].whitened == by[None, c].whitened and by[904, c].whitened is None and by[904, c].deviation is None
        for i in range(len(rows)):
            r = by[i, c]
            assert r.deviation == sum((n * x[i][j] - s[j]) ** 2 for j in range(6))
            assert math.isclose(r.explained, e[c - 1] / trace, rel_tol=1e-12)
            want = sign * sum((n * x[i][j] - s[j]) / n * v[j, c - 1] for j in range(6)) / math.sqrt(e[c - 1])
            assert abs(r.whitened - want) < 1e-9


def test_odd_tables(spark):
    make = lambda rows: {(r.vec_id, r.component): r for r in wh.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert make([]) == {} and make([(1, None), (2, [])]) == {}
    one = make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert len(one) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one.values())
    flat = make([(1, [0.5, 0.25]), (2, [0.25, 0.25])])  # the second component has eigenvalue 0
    assert {(k, c): (r.whitened, r.explained) for (k, c), r in flat.items() if c == 2} == {(1, 2): (None, 0.0), (2, 2): (None, 0.0)}
    assert sorted(r.whitened for (_, c), r in flat.items() if c == 1) == [-1, 1] and flat[1, 1].deviation == 256
    far = make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [2.0**40, 3.0]), (4, [2.0**40, 5.0])])
    assert far[1, 1].deviation is None and abs(far[1, 1].whitened) > 1 and far[1, 1].identity_error < 1e-9
