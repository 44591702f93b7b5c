import numpy as np
import pytest

from pagewright.llm import embeddings, hnsw


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 8), dim))
    return (centres[rng.integers(0, len(centres), n)] + rng.choice([0.05, 0.25, 1.0], size=(n, 1)) * rng.normal(size=(n, dim))).astype(np.float32)


def brute(rows, floor=0.93):
    def usable(v):
        return v and None not in v and np.isfinite(np.array(v, np.float32)).all() and np.any(np.array(v, np.float32))

    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if usable(v) else None for _, v, _ in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))
    for i in range(n):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] is None or rows[i][2] != rows[j][2] or len(unit[i]) != len(unit[j]) or unit[i] @ unit[j] < floor:
                continue
            links[i] += 1
            links[j] += 1
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[root[i]] = min(vec, least.get(root[i], vec))
    return sorted(((vec, links[i], least.get(root[i])) for i, (vec, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("n,dim", [(1, 4), (2, 4), (40, 8), (3000, 16)])
def test_graph_recall(n, dim):
    x = clustered(n, dim, n)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.from_bytes(x, hnsw.build(x).to_bytes())
    a, b = hnsw.near(graph, x, 0.9)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.9))}
    assert set(zip(a.tolist(), b.tolist())) <= want and len(a) >= 0.98 * len(want)


@pytest.mark.parametrize("shard", [1 << 20, 1500])
def test_equals_brute_force(spark, shard):
    x = clustered(160, 6, 5)
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(len(x))]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(300, rows[3][1], 0), (301, [v * 3e30 for v in rows[3][1]], 1), (302, [v * 1e-30 for v in rows[3][1]], 1)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 6, 1), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (404, [float("nan")] * 6, 1), (405, [float("inf")] * 6, 1), (406, rows[3][1], None), (407, rows[3][1][:5], 1)]
    rows += [(None, rows[5][1], rows[5][2]), (7, rows[7][1], rows[7][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS mark", "2 AS id", "3 AS shard")
    got = embeddings.near_vectors(frame, shard=shard).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.id is not None and r.id == r.component_id) for r in got)


def test_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_audit_sees_a_bad_graph_where_the_sample_has_no_links():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.build(x)
    graph.links[0][rng.random(len(x)) < 0.7] = -1  # most nodes lead nowhere
    y = rng.normal(size=(2000, 24)).astype(np.float32)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    sample = np.unique(np.linspace(0, len(y) - 1, 64).astype(np.int64))
    twins = np.setdiff1d(np.arange(len(y)), sample)[:500]
    y[twins] = x[:500]
    assert not (y[sample] @ x.T >= 0.93).any()
    a, b = hnsw.near(graph, y, 0.93)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(y @ x.T >= 0.93))}
    got = set(zip(a.tolist(), b.tolist()))
    assert got <= want and len(got) >= 0.98 * len(want)
