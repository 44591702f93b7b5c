from fractions import Fraction
from math import floor

import numpy as np
import pytest

from pagewright.llm import charpoly, whitening


def exact_polynomial(m):
    """Coefficients from x^0 up by the method of Faddeev and LeVerrier."""
    d = len(m)
    out, now = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        now = [[sum(m[i][l] * (now[l][j] + (out[-1] if l == j else 0)) for l in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(now[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


def gram(rng, rows, dim, size=50):
    a = [[int(x) for x in row] for row in rng.integers(-size, size, (rows, dim))]
    return [[sum(r[i] * r[j] for r in a) for j in range(dim)] for i in range(dim)]


@pytest.mark.parametrize("rows, dim", [(5, 1), (9, 2), (20, 7), (3, 8), (30, 12), (0, 4)])
def test_polynomial_is_exact(rows, dim):
    m = gram(np.random.default_rng(dim), rows, dim)
    primes = charpoly.primes_below(1 << 31, 2 * charpoly.coefficient_bound(m))
    got = charpoly.chinese(primes, [charpoly.polynomial_mod(m, p).tolist() for p in primes])
    assert got == exact_polynomial(m)


def test_primes_are_prime():
    found = charpoly.primes_below(1000, 10**9)
    assert found == [p for p in range(999, 1, -1) if all(p % q for q in range(2, p))][: len(found)]


def test_sparse_matrices_have_their_polynomial():
    m = [[0, 0, 0, 2], [0, 3, 0, 0], [0, 0, 5, 0], [2, 0, 0, 7]]
    assert [int(x) for x in charpoly.polynomial_mod(m, 10007)] == [c % 10007 for c in exact_polynomial(m)]


def times(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0] + poly, poly + [0])]
    return poly


def test_roots_come_with_their_copies():
    roots = charpoly.largest_roots(times([10**12, 10**12 - 1, 7, 7, 7, 3, 0, 0]), 8)
    assert [(round(a / 2**p), c) for a, p, c in roots] == [(10**12, 1), (10**12 - 1, 1), (7, 3), (3, 1)]
    assert all(abs(Fraction(a, 2**p) - round(a / 2**p)) < Fraction(1, 2**150) for a, p, c in roots)
    assert charpoly.largest_roots([0, 0, 1], 3) == []
    small = charpoly.largest_roots([1, -(10**30), 10**30 * 3, -(10**20), 1], 0)
    assert small == []


def test_root_of_two():
    (a, p, c), (b, q, e) = charpoly.largest_roots([7, -6, 1], 2)  # 3 +- sqrt 2
    assert abs((Fraction(a, 2**p) - 3) ** 2 - 2) < Fraction(1, 2**180) and abs((Fraction(b, 2**q) - 3) ** 2 - 2) < Fraction(1, 2**180)


def test_vectors_of_close_and_equal_roots():
    rng = np.random.default_rng(3)
    m = gram(rng, 40, 6)
    for i in range(6):  # two equal blocks: every root twice
        m[i] += [0] * 6
    m = m + [[0] * 6 + row[:6] for row in m]
    roots = charpoly.largest_roots(charpoly.chinese(ps := charpoly.primes_below(1 << 31, 2 * charpoly.coefficient_bound(m)), [charpoly.polynomial_mod(m, p).tolist() for p in ps]), 12)
    assert [c for _, _, c in roots] == [2] * 6
    v = np.array([[float(x) for x in u] for r in roots for u in charpoly.null_vectors(m, *r)])
    values = np.repeat([a / 2**p for a, p, _ in roots], 2)
    assert np.abs(v @ v.T - np.eye(12)).max() < 1e-14
    assert np.abs(v @ np.array(m, float) - values[:, None] * v).max() < 1e-13 * values[0]


def run(spark, rows, count=16):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS x", "3 AS n")
    return whitening.whitened(frame, count=count).collect()


def brute(rows, count):
    x = [(i, [floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, _ in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s).astype(float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    out = {}
    for i, v in x:
        z = n * np.array(v, object) - s
        out[i] = (int((z * z).sum()), (z.astype(float) / n) @ vectors / np.sqrt(values), values / np.linalg.eigvalsh(y.T @ y / n).sum())
    return n, out


@pytest.mark.parametrize("dim, count", [(3, 16), (20, 5), (64, 16)])
def test_equals_linear_algebra(spark, dim, count):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(c) for c in 5 + rng.normal(size=dim) * np.linspace(3, 1, dim)], 0) for i in range(250)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(100)] + [rows[3]]
    n, want = brute(rows, min(count, dim))
    got = run(spark, rows, count)
    assert len(got) == len(rows) * min(count, dim) and {r.n for r in got} == {n} == {250}
    signs = {}
    for r in got:
        deviation, w, share = want[r.id]
        c = r.component - 1
        assert r.deviation == deviation and abs(r.explained - share[c]) < 1e-9
        sign = signs.setdefault(c, np.sign(r.whitened * w[c])) if abs(w[c]) > 1e-3 else signs.get(c)
        assert sign is None or abs(r.whitened - sign * w[c]) < 1e-6
        assert r.identity_error < 1e-10


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=4)], 0) for i in range(30)]
    odd = [(50, None, 1), (51, [1.0, None, 2.0, 3.0], 1), (52, [float("nan"), 0.0, 0.0, 0.0], 1), (53, [float("-inf")] * 4, 1), (54, [], 1), (55, [1.0], 1), (56, [1e30] * 4, 1)]
    want = sorted((r.id, r.component, r.deviation) for r in run(spark, good))
    assert sorted((r.id, r.component, r.deviation) for r in run(spark, good + odd)) == want and len(want) == 120
    assert len(run(spark, good + [(None, good[0][1], None)])) == 124
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]) == []


def test_rank_is_known_exactly(spark):
    """Vectors on a line through space have one component, whatever their number of entries."""
    rows = [(i, [float(i), 2.0 * i, -float(i), 7.0], 0) for i in range(40)]
    got = run(spark, rows)
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-15 for r in got)
    # large entries, whose sums leave 64 bits
    far = [(i, [float(2**30 * (i % 3)), float(i), -float(2**31 * (i % 5))], 0) for i in range(60)]
    n, want = brute(far, 3)
    assert all(r.deviation == (want[r.id][0] if want[r.id][0] < 2**63 else None) and r.identity_error < 1e-9 for r in run(spark, far))
