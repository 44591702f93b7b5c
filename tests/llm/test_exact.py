import hashlib

import pytest
from pyspark.sql import functions as F

from pagewright.llm import exact


def brute(rows, best):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = [i for i in groups[t or ""] if i is not None]
        keep = best(ids) if ids else None
        out.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = (
    [(i, "common line") for i in range(100, 160)] + [(i, f"text {i % 7} é") for i in range(30)] + [(i, f"own {i}") for i in range(200, 260)]
    + [(300, None), (301, ""), (302, " "), (303, "x" * 500_000), (304, "x" * 500_000), (305, "x" * 500_000 + " ")]
    + [(None, "nobody"), (None, "nobody"), (None, "text 1 é"), (7, "text 0 é"), (7, "text 0 é"), (400, "A"), (401, "a"), (402, "á"), (403, "á")]
)


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("hot", [1, 8, 4096])
def test_equals_brute_force(docs, largest, hot):
    frame = docs(ROWS).selectExpr("*", "1 AS hash", "2 AS id", "3 AS n", "4 AS keep_id", "5 AS key")
    got = sorted((tuple(r) for r in exact.exact_groups(frame, largest=largest, hot=hot).collect()), key=repr)
    assert got == brute(ROWS, max if largest else min)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_texts_with_one_hash_stay_apart(docs, bits):
    weak = lambda text: F.substring(F.unhex(F.md5(text)), 1, bits)
    got = sorted((tuple(r) for r in exact.exact_groups(docs(ROWS), digest=weak).collect()), key=repr)
    assert got == brute(ROWS, min)


def test_no_rows(docs):
    assert exact.exact_groups(docs([])).collect() == []
    assert exact.keep_one(docs([])).collect() == []


def test_one_row_of_each_group_stays(docs):
    frame = docs(ROWS).withColumn("_place", F.lit(1))
    for largest, best in ((False, min), (True, max)):
        kept = exact.keep_one(frame, largest=largest)
        assert kept.columns == frame.columns
        rows = kept.collect()
        assert len(rows) == len({t or "" for _, t in ROWS})
        ids = {t or "": [d for d, u in ROWS if (u or "") == (t or "") and d is not None] for _, t in ROWS}
        assert all(r.doc_id == (best(ids[r.text or ""]) if ids[r.text or ""] else None) for r in rows)


def test_runs_without_python(docs):
    plan = exact.exact_groups(docs(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
