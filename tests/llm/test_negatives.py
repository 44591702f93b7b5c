import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import negatives


def brute(rows, positives=5, many=3):
    """rows: (id, vector, label), already as the operator counts them."""
    q = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label in rows]
    out = []
    for i, label, a in q:
        if i % 5:
            continue
        score = lambda b: sum(x * y for x, y in zip(a, b))
        alike = sorted((-score(b), j) for j, other, b in q if other == label and j != i and len(a) == len(b))[:positives]
        for p, j in alike:
            p = -p
            band = sorted((-score(b), n) for n, other, b in q if other != label and len(a) == len(b) and 50 * p <= 100 * score(b) <= 95 * p)[:many]
            out += [(i, j, r + 1, n, p, -s) for r, (s, n) in enumerate(band)]
    return sorted(out)


def run(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS q", "3 AS lo", "4 AS block")
    got = negatives.hard_negatives(frame, F.col("id") % 5 == 0, **sizes)
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim)) / dim**0.5
    return [(i, [float(x) for x in centres[i % 4] + spread * rng.normal(size=dim) / dim**0.5], int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 7, 64])
def test_equals_brute_force_over_many_blocks(spark, dim):
    rows = vectors(150, dim, dim)
    assert run(spark, rows, block=40, anchors=9) == brute(rows)


def test_ties_copies_and_a_hot_label(spark):
    base = vectors(12, 8, 3)
    rows = [(i, base[i % 12][1], 0 if i % 3 else 1) for i in range(120)]
    assert run(spark, rows, block=25) == brute(rows)


def test_rows_that_take_no_part(spark):
    good = vectors(60, 4, 9)
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [float("nan")] * 4, 1), (103, [float("inf"), 0.0, 0.0, 0.0], 1), (105, [0.1] * 4, None), (None, [0.1] * 4, 1), (104, [3e38] * 4, 1)]
    assert run(spark, good + odd + good[:10]) == brute(good)
    other = [(200 + i, [0.5] * (2 + i % 2), i % 4) for i in range(20)] + [(300, [0.0] * 4, 1), (305, [0.0] * 4, 2)] + [(310, [], 1), (315, [], 1), (316, [], 2)]
    assert run(spark, good + other) == brute(good + other)
    assert run(spark, []) == [] and run(spark, [(1, [0.1], 1)]) == []


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (40, 64)), rng.integers(-300, 300, (50, 64))
    exact, before = a @ b.T, np.inf
    for (ma, da), (mb, db) in zip(negatives.summaries(a), negatives.summaries(b)):
        middle, wide = ma @ mb.T, da @ db.T
        assert (np.abs(exact - middle) <= wide).all()
        assert (wide <= before * (1 + 1e-9) + 1e-6).all()
        before = wide
    big = rng.integers(-(2**27), 2**27, (5, 8))
    assert (negatives.exact_scores(big, big) == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in big] for r in big]).all()


def test_rows_leave_before_exact_scoring(monkeypatch):
    """On vectors that differ in their segments, most rows are never scored."""
    rng = np.random.default_rng(4)
    smooth = lambda n: np.repeat(rng.integers(-200, 200, (n, 16)), 4, axis=1) + rng.integers(-5, 5, (n, 64))
    a, b = smooth(20), smooth(3000)
    scored = []
    real = np.einsum
    monkeypatch.setattr(negatives.np, "einsum", lambda f, x, y: (scored.append(len(x)), real(f, x, y))[1])
    free = np.full((20, 1), -(1 << 62)), np.full((20, 1), 1 << 62)
    q, _, r, s = negatives.best_within((a, negatives.summaries(a)), (b, negatives.summaries(b), np.arange(3000)), np.ones((20, 3000), bool), *free, 5, [True] * 3)
    want = a @ b.T
    for i in range(20):
        assert sorted(zip(-s[q == i], r[q == i])) == sorted(zip(-want[i], range(3000)))[:5]
    assert sum(scored) < 0.05 * want.size


def test_scores_of_random_vectors_match_random_bands():
    rng = random.Random(2)
    x = np.array([[rng.randint(-50, 50) for _ in range(10)] for _ in range(200)])
    lo = np.array([[rng.randint(-2000, 0), rng.randint(-9000, 0)] for _ in range(200)])
    hi = lo + [4000, 9000]
    hi[::3, 1] = lo[::3, 1] - 1
    levels = negatives.summaries(x)
    allowed = np.array([[i != j for j in range(200)] for i in range(200)])
    for worth in ([True, True], [False, False]):
        q, band, r, s = negatives.best_within((x, levels), (x, levels, np.arange(200)), allowed, lo, hi, 3, worth)
        full = x @ x.T
        for i in range(200):
            for c in range(2):
                want = sorted((-full[i, j], j) for j in range(200) if i != j and lo[i, c] <= full[i, j] <= hi[i, c])[:3]
                at = (q == i) & (band == c)
                assert sorted(zip(-s[at], r[at])) == want
