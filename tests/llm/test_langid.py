import random

import numpy as np
import pytest

from pagewright.llm import langid
from pagewright.llm.queries import QUERIES


def corpus(n, seed=1, tongues=("ka ro mi su", "sch tz ung ei", "ção nh lh ã", "що як є ї")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = i % len(tongues)
        text = " ".join("".join(rng.choices(tongues[k].split(), k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text.title() if i % 5 == 0 else text, f"l{k}"))
    return rows


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 30])
def test_codewords_lie_apart(n):
    c = langid.code(n)
    assert c.shape[0] == n and len({tuple(r) for r in c}) == (n if n > 1 else 1)
    if n > 6:
        assert min(int((a != b).sum()) for i, a in enumerate(c) for b in c[:i]) >= c.shape[1] // 5


def test_held_out_accuracy(docs):
    rows = corpus(400)
    model = langid.train(docs([r if r[0] % 50 else (r[0], r[1], None) for r in rows[:300]]))
    got = {r.doc_id: r.p for r in docs(rows).select("doc_id", langid.predict(model).alias("p")).collect()}
    assert np.mean([got[i].lang == lang for i, _, lang in rows[300:]]) >= 0.97
    assert all(0 <= p.score <= 1 for p in got.values())


def test_odd_texts_and_ambiguity(docs):
    model = langid.train(docs(corpus(300)))
    odd = [None, "", "12 34 !?", "é", "karo " * 30_000, "x" * 200_000]
    got = {r.doc_id: r.p for r in docs([(i, t) for i, t in enumerate(odd)]).selectExpr("*", "1 AS p").select("doc_id", langid.predict(model).alias("p")).collect()}
    assert [got[i].lang for i in range(3)] == ["und"] * 3 and all(got[i].lang != "und" for i in range(3, 6)) and got[4].lang == "l0"
    pure, mixed = "karo misu romi " * 20, "karo misu romi schung tzei ungei " * 10
    share = model.decode([pure.encode(), mixed.encode()])[1]
    assert share[0] > share[1]


def test_nothing_to_learn(docs):
    for rows, want in (([], "und"), ([(1, "some text", "xx")], "xx"), ([(1, None, "xx"), (2, "text", None)], "und")):
        model = langid.train(docs(rows))
        assert [r.p.lang for r in docs([(1, "a text")]).select(langid.predict(model).alias("p")).collect()] == [want]
    assert docs([]).select(langid.predict(model)).count() == 0


def test_query_on_given_table(spark):
    rows = QUERIES["op2_language"](spark, "/root/testdata/sf0.001")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    held = rows.join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").selectExpr("avg(CAST(lang = lang_pred AS INT)) AS right").first()
    assert held.right >= 0.9


def test_languages_of_few_texts_with_many_copies_stay(docs):
    rows = corpus(40)[:2] * 300 + corpus(8)[2:8]
    model = langid.train(docs(rows), labelled=2)
    assert model.languages == ["l0", "l1", "l2", "l3"]


def test_copies_do_not_fill_the_sample(docs, monkeypatch):
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, language, languages: seen.append(np.bincount(language).tolist()) or fit(x, language, languages))
    rows = corpus(40)
    langid.train(docs(rows[:1] * 500 + rows), labelled=5)
    langid.train(docs(rows[:1] * 500 + rows[:3]), labelled=5)
    assert seen == [[5] * 4, [1] * 3]
