import random
import re

from pagewright.llm import decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return [w.decode() for w in WORD.findall((text or "").encode().lower())]


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= owners
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abé", k=2)) for _ in range(9)]

    def some(n):
        return " ".join(rng.choices(vocabulary, k=n))

    items = [(i, some(rng.choice([1, 2, 3, 9, 10, 11, 25, 40]))) for i in range(10)]
    items += [(0, some(12)), (50, None), (51, ""), (52, "--"), (None, "unlisted words"), (53, items[4][1].upper() + "!"), (53, items[4][1])]
    rows = [(i, some(rng.randint(0, 40))) for i in range(60)]
    for i in range(60, 110):
        words = items[rng.randrange(10)][1].split()
        cut = words[rng.randrange(3) :]
        rows.append((i, some(5) + ", " + "; ".join(cut).upper() + ". " + some(3)))
    rows += [(300, None), (301, ""), (302, "..."), (None, items[3][1]), (5, items[3][1]), (5, items[3][1]), (303, " ".join([items[6][1]] * 3000)), (304, "Unlisted, words unlisted\x80words")]
    return rows, items


def test_equals_brute_force(spark, docs):
    rows, items = cases()
    frame = docs(rows).selectExpr("*", "1 AS row", "2 AS hits", "3 AS words", "4 AS item_id")
    got = decontamination.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute(rows, items)


def test_long_items_only(spark, docs):
    rows, items = cases()
    items = [x for x in items if len(split(x[1])) > 9]
    got = decontamination.contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute(rows, items)


def test_filter_keeps_clean_rows(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "so Alpha, beta gamma\ndelta stands"), (2, "alpha beta gamma"), (3, None), (4, ""), (2, "alpha beta gamma"), (None, "alpha beta gamma delta")]
    kept = decontamination.keep_clean(docs(rows), bench)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(2, "alpha beta gamma"), (3, None), (4, ""), (2, "alpha beta gamma")], key=lambda x: x[0])


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs([]), none).count() == 0
    assert [tuple(r) for r in decontamination.contamination(docs([(1, "a b")]), none).collect()] == [(1, 2, 0, [])]
