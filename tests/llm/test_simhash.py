import random

from xxhash import xxh64_intdigest

from pagewright.llm import simhash


def brute(rows):
    def fingerprint(text):
        words = (text or "").encode().lower().split()
        k = min(3, len(words))
        h = [xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=4)) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 140):
        words = base[rng.randrange(60)].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, "\t".join(words)))
    return rows + [(200, None), (201, ""), (202, " \n\v"), (203, "A B"), (204, "a\x0bb"), (None, "a b"), (3, base[3]), (3, base[3]), (205, "x " * 30000), (206, "X " * 30001), (207, "a\x1cb\xa0c")]


def test_equals_brute_force(docs):
    rows = corpus()
    got = simhash.near_groups(docs(rows).selectExpr("*", "1 AS fp", "2 AS id", "3 AS component")).collect()
    assert sorted(((r.id, r.fingerprint, r.component_id) for r in got), key=repr) == brute(rows)


def test_large_choices_link_the_same_pairs(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(60)} | set(seeds)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")

    def groups(most):
        return {(r.id, r.component) for r in simhash.components(simhash.close_pairs(frame, most=most)).collect()}

    assert groups(1) == groups(10**6) != set()


def test_keeps_one_of_each_group(docs):
    rows = [(5, "one two three four"), (3, "one two three four"), (None, "one two three four"), (9, "other words stand here"), (9, "other words stand here"), (1, None), (2, ""), (None, "lonely text without id")]
    kept = simhash.keep_first(docs(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(1, None), (3, "one two three four"), (9, "other words stand here")]
    assert [r.text for r in kept if r.doc_id is None] == ["lonely text without id"]


def test_empty_table(docs):
    assert simhash.near_groups(docs([])).count() == simhash.keep_first(docs([])).count() == 0
