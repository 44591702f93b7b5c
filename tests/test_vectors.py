"""Vector search against all pairs, on vectors with and without clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import vectors as ops


def made(kind, n=240, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    if kind == "random":
        x = rng.normal(size=(n, dim))
    else:
        centres = np.eye(dim) * 5
        x = centres[rng.integers(dim, size=n)] + 0.3 * rng.normal(size=(n, dim))
    x[5], x[6], x[7] = x[4], x[4] * 2, 0
    return x


def frame(spark, x, name=lambda i: i, kind="long"):
    return spark.createDataFrame([(name(i), [float(c) for c in v]) for i, v in enumerate(x)], f"id {kind}, v array<double>")


def cosines(x):
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    return u @ u.T


@pytest.mark.parametrize("kind", ["random", "clustered"])
@pytest.mark.parametrize("rows", [20, 5000])
def test_top_k_equals_all_pairs(spark, kind, rows):
    x = made(kind)
    score = np.round(cosines(x), 9)
    f = frame(spark, x)
    got = {}
    for r in ops.vector_top_k(f, f, 4, rows).collect():
        got.setdefault(r.id, []).append((r["rank"], -r.score, r.neighbour))
    for i in range(len(x)):
        want = sorted((-score[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert [(s, j) for _, s, j in sorted(got[i])] == want


def test_queries_of_their_own_and_names_as_ids(spark):
    x, q = made("clustered"), made("random", 50, seed=9)
    f, g = frame(spark, x, lambda i: f"v{i:03d}", "string"), frame(spark, q, lambda i: f"q{i:03d}", "string")
    both = np.vstack([q, x])
    score = np.round(cosines(both)[:50, 50:], 9)
    got = {(r.id, r.neighbour) for r in ops.vector_top_k(g, f, 3, 16).collect()}
    assert got == {(f"q{i:03d}", f"v{j:03d}") for i in range(50) for _, j in sorted((-score[i, j], j) for j in range(len(x)))[:3]}
    pairs = {(r.left, r.right) for r in ops.vector_pairs(f, 0.97, 16).collect()}
    full = cosines(x)
    one = [i for i in range(len(x)) if i != 5]
    assert pairs == {(f"v{i:03d}", f"v{j:03d}") for i in one for j in one if i < j and full[i, j] >= 0.97}


@pytest.mark.parametrize("floor", [-0.5, 0.0, 0.4, 0.99])
def test_pairs_equal_all_pairs(spark, floor):
    x = made("random", 120, 4)
    full = cosines(x)
    one = [i for i in range(len(x)) if i != 5]
    got = {(r.left, r.right): r.score for r in ops.vector_pairs(frame(spark, x), floor, 10).collect()}
    assert set(got) == {(i, j) for i in one for j in one if i < j and full[i, j] >= floor}


def test_donors_lie_in_their_band(spark):
    x = made("clustered", 150)
    f = frame(spark, x)
    full = np.round(cosines(x), 9)
    got = {(r.id, r.donor) for r in ops.donors(f.where("id % 3 = 0"), f.where("id % 2 = 1"), 0.2, 0.9, 2, 12).collect()}
    want = set()
    for i in range(0, 150, 3):
        inside = sorted((-full[i, j], j) for j in range(1, 150, 2) if i != j and 0.2 <= full[i, j] <= 0.9)[:2]
        want |= {(i, j) for _, j in inside}
    assert got == want


def test_far_blocks_never_meet(spark):
    x = made("clustered", 1200, 12)
    f = frame(spark, x)
    own = ops.blocks(f, ops.pivots_of(f, 24), 20)
    n = own.names.count()
    met = ops.block_pairs(own, own, F.lit(0.9), half=True).count()
    assert n >= 40 and met < 0.2 * n * (n + 1) / 2
    assert own.names.agg(F.sum("n")).first()[0] == 1200 and own.names.agg(F.max("n")).first()[0] <= 120


def test_no_vectors(spark):
    f = spark.createDataFrame([], "id long, v array<double>")
    g = spark.createDataFrame([(1, None), (2, [])], "id long, v array<double>")
    for x in (f, g):
        assert ops.vector_top_k(x, x, 3).collect() == [] and ops.vector_pairs(x, 0.5).collect() == []


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_what_a_query_has_is_the_least_it_asks_of_other_blocks(spark, monkeypatch, kind):
    x = made(kind, n=600)
    x[20:60] = x[20]  # many equal scores
    f = frame(spark, x)
    rows, top_k = [], ops.shapes.top_k
    monkeypatch.setattr(ops.shapes, "top_k", lambda df, *a: rows.append(df.count()) or top_k(df, *a))
    got = sorted((r.id, r["rank"], r.neighbour, r.score) for r in ops.vector_top_k(f, f, 3, 25).collect())
    assert rows[0] <= 2 * 3 * len(x)  # of its own block and of all others together
    score = np.round(cosines(x), 9)
    for i in range(len(x)):
        best = sorted((-score[i, j], j) for j in range(len(x)) if j != i)[:3]
        assert [(n, s) for _, _, n, s in got[3 * i : 3 * i + 3]] == [(j, pytest.approx(-s, abs=1e-9)) for s, j in best]
