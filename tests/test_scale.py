"""What moves between tasks: nothing whole through the driver, no whole set with a pair."""

import math
import random
from itertools import combinations

from pyspark.sql import functions as F

from pagewright.functions import text as text_functions
from pagewright.operators import focus, graph, pages, passages, search, similarity, sparse, termblocks
from pagewright.plans import catalog


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_spread_signatures_are_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id", "id * 7919 AS s").write.parquet(str(tmp_path / "rows"))
    pairs = similarity.near_hash_pairs(spark.read.parquet(str(tmp_path / "rows")), [], 7, "id", "s")
    assert "BroadcastExchange" not in _plan(pairs)


def test_shared_item_pairs_count_without_moving_sets(spark):
    rng = random.Random(5)
    sets = {k: set(rng.sample(range(30), rng.randrange(1, 14))) for k in range(40)}
    sets[41] = sets[3]
    sets[42] = set(range(30))
    rows = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v] + [(None, 1), (7, None), (42, 3)], "key long, item long")
    for least in (1, 3, 6):
        found = similarity.shared_item_pairs(rows, least)
        assert "items2" not in _plan(found)
        one = {}
        for k in sorted(sets, reverse=True):
            one[frozenset(sets[k])] = k
        want = {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(one.values()), 2) if len(sets[a] & sets[b]) >= least}
        assert {tuple(r) for r in found.collect()} == want


def test_hub_verdicts_shuffle_no_pairs_of_hub_and_topic_document(spark):
    areas = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 1, None), ("d", 1, None), ("e", 2, None), ("f", 1, "g"), ("i", 3, "k")], "doc string, section int, hub string")
    links = spark.createDataFrame([("h", "a"), ("h", "b"), ("h", "d"), ("a", "h"), ("g", "f"), ("f", "g"), ("k", "i"), ("i", "k")], "source string, target string")
    topics = spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "t"), ("c", "t"), ("c", "u"), ("d", "t"), ("e", "t"), ("f", "w"), ("i", "z")], "doc string, topic string")
    found = graph.hub_verdicts(areas, links, topics)
    # The pairs that come out of the demand for a topic meet no links any more, which come with the demand.
    assert "array_contains" in _plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == [("g", None, "area-healthy"), ("h", "b", "hub-missing-backlink"), ("h", "c", "hub-missing-member-link"), ("k", None, "area-healthy")]


def test_runs_of_words_are_counted_where_their_page_is(spark):
    rows = [(1, "en", "Big Cities", "big cities the Big cities 4x4 grow"), (1, "en", "Big", "cities"), (2, "de", None, "Größe größe ÜBER x"), (None, None, "", "")]
    pages = spark.createDataFrame(rows, "page int, lang string, title string, body string")
    got = focus.zone_ngrams(pages, {"title": "title", "body": "body"}, longest=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(page#") == 1 and plan.count("Exchange") == 1
    want = {(1, "big"): (7.0, 4), (1, "city"): (5.5, 4), (1, "big city"): (4.5, 3), (1, "grow"): (1.0, 1), (2, "groesse"): (2.0, 2), (2, "groesse groesse"): (1.0, 1), (2, "ueber"): (1.0, 1), (2, "groesse ueber"): (1.0, 1), (2, "groesse groesse ueber"): (1.0, 1)}
    assert {(r.page, r.key): (r.tf, r["count"]) for r in got.collect()} == want


def test_words_of_a_text_get_the_keys_that_each_gets_alone(spark):
    odd = ["Straße", "Œuvre", "ĄĘ", "İstanbul", "cafés", "ΟΔΟΣ", "the", "a1", "12", "x9y8z", "ab", "b", "Cities", "Książkami", "ñandúes", "ǅungla", "२३ab", "\U0001d400\U0001d401", "ﬁn"]
    rows = [(lang, text) for lang in ("de", "en-GB", "pl", None) for text in [" ".join(odd), "\n".join(reversed(odd)), "", "-- ", None, "the", *odd]]
    frame = spark.createDataFrame(rows, "lang string, text string")
    alone = F.transform(text_functions.words(F.col("text")), lambda w: F.when(~text_functions.is_noise(text_functions.fold(w)), text_functions.term_key(w, F.col("lang"))))
    counts = lambda w: (F.regexp_count(w, F.lit(r"\p{L}")), F.regexp_count(w, F.lit(r"\p{N}")))
    noise = lambda w: w.isin(*text_functions.STOPWORDS) | (counts(w)[0] < 2) | (counts(w)[1] >= counts(w)[0])
    plain = F.transform(text_functions.words(F.col("text")), lambda w: noise(text_functions.fold(w)))
    got = frame.select(F.coalesce(alone, F.array().cast("array<string>")).alias("a"), text_functions.word_keys(F.coalesce("text", F.lit("")), F.col("lang")).alias("b"), F.transform("b", lambda k: k.isNull()).alias("n"), F.coalesce(plain, F.array().cast("array<boolean>")).alias("m")).collect()
    assert all(r.a == r.b and r.n == r.m for r in got) and sum(len(r.a) for r in got) > 200


def test_term_vectors_take_texts_apart_once(spark):
    # What the statistics, the sizes and the vectors read is written before.
    for name in ("tfidf_vectors", "core_terms", "anchor_term_mass", "term_cooccurrence"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan, name


def test_dedupe_ranked_keys_an_address_once(spark):
    urls_of = ["https://www.r.example/a/?utm_source=x", "http://r.example/a", "http://r.example/b", "ftp:x", None]
    rows = spark.createDataFrame([(n % 2, urls_of[i], r) for n in range(6) for i in range(5) for r in (7 + n, 3 + i + n, None)] + [(None, urls_of[1], 2)], "list long, url string, rank long")
    found = search.dedupe_ranked(rows)
    assert "regexp" not in _plan(found)
    got = {(r.list, r.url_key, r["rank"], r.position) for r in found.where("list IS NOT NULL").collect()}
    assert got == {(n, f"r.example/{k}", n + d, p) for n in (0, 1) for k, d, p in (("a", 3, 1), ("b", 5, 2))}


def test_dangling_references_look_up_a_target_once(spark):
    page = lambda i: f"https://g.example/p/{i}"
    refs = [("r1", page(i), 0, "$", "brand", page(i % 3) + "#b") for i in range(30)] * 2
    refs += [("r1", page(1), 0, "$", "about", "#own"), ("r1", page(1), 0, "$", "brand", "https://else.example/#b"), ("r1", page(2), 0, "$", "brand", page(5)), (None, page(1), 0, "$", "brand", page(1) + "#b")]
    nodes = [("r1", page(0), 0, "$.b", "@id", "#b"), ("r1", page(0), 0, "$.b", "name", "x"), ("r1", page(2), 0, "$.b", "@id", "#b")]
    triples = spark.createDataFrame(refs + nodes, "run_id string, page string, decl int, path string, property string, value string")
    crawled = spark.createDataFrame([("r1", page(i)) for i in range(3)] + [(None, page(1))], "run_id string, url string")
    found = pages.dangling_references(triples, crawled)
    last = _plan(found).split("Optimized Logical Plan")[1].split("Physical Plan")[0].split("Join Left")[1]  # what is returned comes from what was written
    assert "regexp" not in last
    want = {("r1", page(i), "brand", page(i % 3) + "#b") for i in range(30) if i % 3} | {("r1", page(1), "about", "#own")}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_weighted_sets_meet_in_blocks_without_a_row_for_a_shared_term(spark, monkeypatch):
    monkeypatch.setattr(sparse, "DOCS", 7)
    monkeypatch.setattr(sparse, "_PLACES", 20)
    monkeypatch.setattr(sparse, "_HITS", 15)
    monkeypatch.setattr(sparse, "_SHARE", 0.2)
    monkeypatch.setattr(similarity, "_GROUP", 10)
    monkeypatch.setattr(similarity, "_GROUPS", 4)
    rng = random.Random(3)
    common, sets = [f"c{i}" for i in range(6)], {}
    for lang in ("en", "de"):
        for i in range(60):
            sets[lang, f"{lang}{i:02}"] = {*rng.sample(common, rng.randrange(6)), *(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 12)))}
        sets[lang, f"{lang}98"] = set(sets[lang, f"{lang}07"])
        sets[lang, f"{lang}99"] = sets[lang, f"{lang}07"] | {"more"}
    rows = [(lang, doc, term) for (lang, doc), terms in sets.items() for term in terms]
    terms = spark.createDataFrame(rows + rows[:9] + [(None, "x", "w1"), ("en", "x", None), ("en", None, "w2")], "lang string, doc string, term string")
    weights = similarity.term_weights(terms, ["lang"]).localCheckpoint()
    weight = {(r.lang, r.term): r.weight for r in weights.collect()}
    for floor, least in ((0.3, 2), (0.16, 1)):
        found = similarity.weighted_jaccard_pairs(weights, ["lang"], floor, least)
        # Only names of blocks are joined; the blocks themselves meet in tasks.
        plan = _plan(found)
        assert "FlatMapGroupsInArrow" in plan and "array_intersect" not in plan
        one = {}
        for (lang, doc), held in sorted(sets.items(), reverse=True):
            one[lang, frozenset(held)] = doc
        want = {}
        for (lang, a), (lang2, b) in combinations(sorted(one, key=lambda k: one[k]), 2):
            total = lambda s, lang=lang: sum(weight[lang, t] for t in s)
            if lang == lang2 and len(a & b) >= least and total(a & b) / total(a | b) >= floor:
                want[lang, *sorted((one[lang, a], one[lang, b])), len(a & b)] = total(a & b) / total(a | b)
        got = {(r.lang, r.left, r.right, r.shared): r.similarity for r in found.collect()}
        assert got.keys() == want.keys() and len(got) > 10 and all(math.isclose(got[k], want[k]) for k in got)
        both = {r[1:] for r in got if r[0] == "en"}
    lone = similarity.weighted_jaccard_pairs(weights.where("lang = 'en'").drop("lang"), [], 0.16, 1)
    assert {(r.left, r.right, r.shared) for r in lone.collect()} == both


def test_subtopics_meet_blocks_of_pages_and_not_terms(spark, monkeypatch):
    monkeypatch.setattr(sparse, "DOCS", 5)
    monkeypatch.setattr(sparse, "_PLACES", 9)
    monkeypatch.setattr(sparse, "_HITS", 6)
    rng = random.Random(8)
    pages_of = {p: {f"t{rng.randrange(30)}": float(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 12))} for p in range(23)}
    topics = {s: {f"t{rng.randrange(40)}": float(rng.randrange(1, 5)) for _ in range(6)} for s in "abcd"} | {"e": {"none": 1.0}}
    given = spark.createDataFrame([(p, t, w) for p, v in pages_of.items() for t, w in v.items()] + [(None, "t1", 2.0), (50, None, 3.0)], "page long, term string, weight double")
    refs = spark.createDataFrame([(s, t, w) for s, v in topics.items() for t, w in v.items()] + [(None, "t2", 1.0)], "subtopic string, term string, weight double")
    found = passages.subtopic_coverage(given, refs)
    assert "FlatMapCoGroupsInArrow" in _plan(found)
    length = lambda v: math.sqrt(sum(w * w for w in v.values()))
    got = {r.subtopic: (r.page, round(r.similarity, 9), r.coverage) for r in found.collect() if r.subtopic}
    for s, v in topics.items():
        alike = {p: round(sum(w * v.get(t, 0) for t, w in u.items()) / length(u) / length(v), 9) for p, u in pages_of.items() if u.keys() & v.keys()}
        page = min(alike, key=lambda p: (-alike[p], p), default=None)
        cos = alike.get(page, 0.0)
        assert got[s] == (page if cos >= 0.6 else None, cos, 1.0 if cos >= 0.78 else 0.5 if cos >= 0.6 else 0.0)


def test_packed_terms_give_what_rows_of_terms_give(spark, monkeypatch):
    monkeypatch.setattr(termblocks, "PAGES", 4)
    monkeypatch.setattr(termblocks, "WORDS", 60)
    rng = random.Random(11)
    words = [*"abcdefghijklmnopqrst", "é", "zz", "a b", "x q", "b x"]
    docs = [(site, page, lang, rng.choices(words, k=rng.randrange(25)) + ["a"]) for site in ("s", "t", "u") for page in range(15) for lang in rng.sample(["en", "de", None], rng.randrange(1, 3))]
    docs += docs[:5] + [("s", None, "en", ["a", "b", "b"]), ("t", 3, "fr", []), ("t", 4, "fr", None), (None, 1, "en", ["a"])]
    given = spark.createDataFrame(docs, "site string, page long, lang string, words array<string>").repartition(4).localCheckpoint()
    rows = given.where("site IS NOT NULL").select("site", "page", "lang", F.explode("words").alias("term")).groupBy("site", "page", "lang", "term").agg(F.count("*").alias("tf")).drop("lang").localCheckpoint()
    packed = termblocks.pack(given.where("site IS NOT NULL").repartitionByRange(3, "site", "page").sortWithinPartitions("site", "page", "lang"), "site", ["page", "lang"]).localCheckpoint()
    assert packed.count() > 9 and packed.agg(F.sum("pages")).first()[0] == 46

    def found(terms):
        stats = focus.term_stats(terms, ("zz",)).localCheckpoint()
        v = focus.tfidf(terms, stats).localCheckpoint()
        cluster = focus.site_terms(v).withColumn("cluster", F.when(F.col("term") > "f", "far").otherwise("near"))
        core = focus.core_terms(cluster, focus.site_weights(v), size=9).localCheckpoint()
        yield "stats", stats
        yield "weights", focus.site_weights(v)
        yield "pages", focus.site_pages(v)
        yield "masses", focus.page_masses(v)
        yield "together", focus.cooccurrence(v, focus.top_terms(focus.site_weights(v), 6))
        yield "anchors", focus.anchor_mass(v, spark.createDataFrame([("s", 2), ("s", 9), ("t", 0), ("t", None)], "site string, page long"))
        yield "core", core
        yield "relevance", focus.page_relevance(v, cluster, core)
        yield "lexical", focus.page_relevance(v, cluster, core, "lexical")
        yield "shares", focus.alignment_rows(v, cluster, core, 5).where("page <> 3").select("site", "page", "rank", "is_core", "cluster_share")

    def plain(frame):
        return sorted(([round(x, 8) if isinstance(x, float) else x for x in r] for r in frame.select(*sorted(frame.columns)).collect()), key=repr)

    for (name, a), (_, b) in zip(found(rows), found(packed)):
        assert plain(a) == plain(b) and a.count() > 3, name
    # What moves for a block is its distinct terms.
    assert "FlatMapCoGroupsInArrow" in _plan(focus.tfidf(packed, focus.term_stats(packed)))


def test_packed_sets_meet_like_rows_of_terms(spark, monkeypatch):
    monkeypatch.setattr(termblocks, "PAGES", 9)
    monkeypatch.setattr(sparse, "DOCS", 7)
    rng = random.Random(4)
    docs = [(lang, f"{lang}{i:02}", [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 12))]) for lang in ("en", "de") for i in range(40)]
    docs += docs[:6] + [("en", "en98", docs[7][2]), ("en", "en99", docs[8][2][::-1]), ("en", "en03", ["more"]), ("en", None, ["w2", "w3"]), ("de", "de77", [])]
    given = spark.createDataFrame(docs, "lang string, doc string, words array<string>").repartition(3).localCheckpoint()
    packed = termblocks.pack(given.repartitionByRange(2, "lang", "doc").sortWithinPartitions("lang", "doc"), "lang", ["doc"]).localCheckpoint()
    rows = given.select("lang", "doc", F.explode("words").alias("term"))
    for ceiling, floor in ((None, 0.3), (0.25, 0.16)):
        a, b = (similarity.weighted_jaccard_pairs(similarity.term_weights(x, ["lang"], ceiling=ceiling), ["lang"], floor) for x in (rows, packed))
        plain = lambda x: sorted((r.lang, r.left, r.right, round(r.similarity, 9), r.shared) for r in x.collect())
        assert plain(a) == plain(b) and a.count() > 10


def test_candidate_pages_make_no_row_for_a_shared_term(spark, monkeypatch):
    monkeypatch.setattr(sparse, "DOCS", 6)
    rng = random.Random(9)
    words = {p: ("en" if p % 3 else None, {f"w{rng.randrange(14)}" for _ in range(rng.randrange(1, 9))}) for p in range(40)}
    words[50], words[51] = words[4], words[6]
    terms = spark.createDataFrame([(t, p, w) for p, (t, held) in words.items() for w in held] * 2 + [("en", None, "w1")], "topic string, page long, term string")
    pages_of = spark.createDataFrame([(p, str(p % 30)) for p in words], "page long, content_hash string")
    near = spark.createDataFrame([(0, 1), (4, 50), (1, 39), (2, 60), (0, 30)], "left long, right long")
    found = passages.candidate_pages(pages_of, near, terms, 3)
    plan = _plan(found)
    assert "FlatMapGroupsInArrow" in plan and "array_except" not in plan
    sets = {p: {(t, w) for w in held} for p, (t, held) in words.items()}
    one = {}
    for p in sorted(sets, reverse=True):
        one[frozenset(sets[p])] = p
    want = {}
    for a, b in combinations(sorted(one.values()), 2):
        if len(sets[a] & sets[b]) >= 3:
            want.setdefault((a, b), set()).add("topic-term")
    for a, b in near.collect():
        want.setdefault((a, b), set()).add("fingerprint")
    first = {}
    for p in sorted(words):
        if first.setdefault(p % 30, p) != p:
            want.setdefault((first[p % 30], p), set()).add("same-content")
    assert sorted((r.left, r.right, r.basis) for r in found.collect()) == sorted((a, b, ",".join(sorted(v))) for (a, b), v in want.items())
