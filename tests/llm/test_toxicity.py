import random

import numpy as np

from pagewright.llm import toxicity, words


def labelled(n=500, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    bad = ["vile", "rotten", "dreck"]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(plain, k=rng.randint(5, 200))
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 9)):
                text.insert(rng.randrange(len(text)), rng.choice(bad).upper())
        rows.append((i, ", ".join(text)))
        labels.append((i, 1, int(toxic or rng.random() < 0.02)))
    return rows, labels


def test_held_out_accuracy_and_order(spark, docs):
    rows, labels = labelled()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(rows), frame.filter("doc_id < 350"))
    assert {words.hash_of(x) for x in ("vile", "rotten", "dreck")} <= set(model.markers.tolist()) and np.all(np.diff(model.thresholds) > 0)
    found = {r.doc_id: r.s for r in docs(rows).select("doc_id", toxicity.severity(model).alias("s")).collect()}
    truth = {i: "VILE" in t or "ROTTEN" in t or "DRECK" in t for i, t in rows}
    held = [i for i in truth if i >= 350]
    assert all((found[i].p_toxic >= 0.5) == truth[i] for i in held)
    assert all(0 <= found[i].severity <= 3 for i in truth)
    dense, thin = model.reach([b"vile rotten dreck vile rotten dreck", b"vile rotten " + b"some plain words " * 60]).sum(axis=1)
    assert dense > thin > model.reach([b"some plain words"]).sum()


def test_odd_rows(spark, docs):
    rows, labels = labelled(300)
    frame = spark.createDataFrame(labels + [(None, 1, 1), (4, None, None), (7, 0, 1), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(rows + rows[:5]).selectExpr("*", "1 AS y", "2 AS h"), frame)
    odd = [(1, None), (2, ""), (3, "?!"), (4, "vile rotten dreck vile"), (4, "vile rotten dreck vile"), (None, "calm words"), (5, "x" * 200_000), (6, "calm " * 50_000)]
    kept = toxicity.keep_mild(docs(odd), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {(r.doc_id, r.text) for r in kept.collect()} == {x for x in odd if not x[1] or "vile" not in x[1]}


def test_nothing_to_learn(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1, 1)], none.schema), spark.createDataFrame([(1, 1, 0)], none.schema)):
        model = toxicity.train(docs([(1, "a b")]), labels)
        assert [r.s.severity for r in docs([(1, "a b")]).select(toxicity.severity(model).alias("s")).collect()] == [0.0]
    assert docs([]).select(toxicity.severity(model)).count() == 0
