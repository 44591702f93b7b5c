"""Hand-made frames with results worked out by hand or by brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagewright.functions import numbers, text, urls
from pagewright.operators import extract, graph, passages, shapes, similarity
from pagewright.sources import logs, tables


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_urls(spark):
    lit = F.lit
    row = one(
        spark, urls.resolve(lit("https://a.b/x/y?q=1"), lit("../z/./w#f")), urls.resolve(lit("https://a.b/x/y"), lit("?p=2")), urls.resolve(lit("https://a.b/"), lit("mailto:x")),
        urls.url_key(lit("HTTP://www.A.b:80/p//q/?b=2&utm_x=1&a=1"), "ranked"), urls.registrable_domain(lit("shop.site.co.uk")), urls.crawl_key(lit("https://a.b/%7Eq?x#y")),
    )
    assert tuple(row) == ("https://a.b/z/w", "https://a.b/x/y?p=2", None, "a.b/p/q?a=1&b=2", "site.co.uk", "https://a.b/~q?x=")


def test_text_rules(spark):
    row = one(spark, text.term_key(F.lit("Książkami"), F.lit("pl")), text.term_key(F.lit("Größe"), F.lit("de")), text.valid_hreflang(F.lit("zh-Hant-TW")), text.valid_hreflang(F.lit("en-x")), numbers.ipv6_hex(F.lit("2001:db8::1")))
    assert tuple(row) == ("ksiazk", "groesse", True, False, "20010db8" + "0" * 23 + "1")


def test_html_nodes_zones_and_headings(spark):
    page = (
        "<html><body><div class='Top-Menu'><a href='/a' rel=nofollow>A</a></div><main><h1>T</h1><p>one two <a href='b'>link</a> three<h3>S</h3>"
        "<div hidden><a href='c'>x</a></div><img src=i.png></main><footer><a href='//o.example/z'>O</a></footer></body></html>"
    )
    pages = extract.parse(spark.createDataFrame([(1, "https://h.example/d/", page)], "page_id long, url string, html string"))
    got = [(r.target, r.zone, r.is_internal) for r in extract.links(pages).orderBy("pos").collect()]
    assert got == [
        ("https://h.example/a", "nav_breadcrumb", True), ("https://h.example/d/b", "main", True), ("https://h.example/d/c", "main", True), ("https://o.example/z", "sidebar_footer", False),
    ]
    ctx = extract.link_context(pages).where("pos = 2").first()
    assert (ctx.before, ctx.after, ctx.anchor_offset) == ("one two", "three", 2)
    assert extract.heading_findings(pages).first().codes == ["level-skipped"]
    assert extract.page_text(pages).first().text == "T one two link three S"


def test_log_lines(spark):
    good = '1.2.3.4 - - [05/Jan/2024:01:00:00 +0200] "GET /a?b=1 HTTP/1.1" 200 - "-" "Googlebot" 0.25'
    rows = logs.parse_lines(spark.createDataFrame([(good,), ("junk",), (good.replace("05/Jan", "45/Jan"),)], "value string")).collect()
    assert (str(rows[0]["at"]), rows[0].path, rows[0].bytes, rows[0].latency_ms, rows[0].family) == ("2024-01-04 23:00:00", "/a", None, 250.0, "googlebot")
    assert rows[1]["at"] is None and rows[2]["at"] is None and rows[2].ip is None


def test_asof_matches_brute_force(spark):
    rng = random.Random(3)
    right = [(rng.randint(0, 2), rng.randint(0, 300), i) for i in range(200)]
    left = [(rng.randint(0, 3), rng.randint(0, 320), i) for i in range(150)]
    r = spark.createDataFrame(right, "k int, t int, v int")
    lf = spark.createDataFrame(left, "k int, t int, id int")
    for strict in (True, False):
        got = {x.id: x.hit for x in shapes.asof(lf, r, ["k"], F.col("t"), F.col("t"), F.col("v"), 17, strict, "hit").collect()}
        for k, t, i in left:
            ok = [(rt, v) for rk, rt, v in right if rk == k and (rt < t if strict else rt <= t)]
            assert got[i] == (max(ok)[1] if ok else None)


def test_numbered_and_gaps(spark):
    rows = [(k, v) for k in "ab" for v in range(50)]
    got = shapes.numbered(spark.createDataFrame(rows, "k string, v int"), ["k"], F.floor(F.col("v") / 7), F.col("v")).collect()
    assert all(r.nr == r.v + 1 for r in got)
    ev = spark.createDataFrame([("p", s) for s in (0, 10, 4000, 9000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    assert sorted(r.gap_ms for r in shapes.gaps(ev, ["k"], "at", 3600).collect() if r.gap_ms is not None) == [10_000, 3_990_000, 5_000_000]


def test_components_and_rank_sum(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (8, 9), (9, 3)], "a long, b long")
    nodes = spark.range(1, 11).select(F.col("id").alias("node"))
    got = {r.node: r.component for r in graph.components(nodes, pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 5, 6: 5, 7: 7, 10: 10}
    e = spark.createDataFrame([("s", "a", "b", 1.0), ("s", "b", "c", 2.0), ("s", "b", "a", 1.0)], "site_id string, source string, target string, weight double")
    n = spark.createDataFrame([("s", x) for x in "abcd"], "site_id string, node string")
    rank = {r.node: r["rank"] for r in graph.page_rank(n, e, graph.RankRules(part_edges=1, max_iterations=30)).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["b"] > rank["d"]


def test_structural_impact_follows_a_known_level(spark):
    """A level with a weekly pattern, raised by a known amount on each day after the change, and one that stays."""
    from datetime import date, timedelta

    from pagewright.operators import experiments

    rng, rows = random.Random(1), []
    for i in range(100):
        d, post = date(2024, 1, 1) + timedelta(days=i), i >= 84
        base = 200 + 15 * (d.weekday() - 3) + rng.gauss(0, 1)
        rows += [("up", d, base + (6 if post else 0), post), ("same", d, base, post), ("short", d, base, i >= 10)]
    got = {r.exp: r for r in experiments.structural_impact(spark.createDataFrame(rows, "exp string, date date, y double, post boolean")).collect()}
    assert abs(got["up"].estimate - 16 * 6) < 25 and got["up"].lower > 0 and got["up"].probability > 0.95 and got["up"].days == 16
    assert got["same"].lower < 0 < got["same"].upper and got["short"].estimate is None
    assert abs((got["up"].estimate - got["same"].estimate) - 96) < 1e-6  # the same draws


def test_ranks_settle_where_plain_iteration_does(spark):
    rng = random.Random(6)
    edges = {(a, b): rng.random() + 0.1 for a, b in ((rng.randrange(40), rng.randrange(60)) for _ in range(150)) if a != b}
    later = {k: w for k, w in edges.items() if k[0] != 3} | {(59, 0): 2.0}

    def plain(edges):
        out = {a: sum(w for (s, _), w in edges.items() if s == a) for a, _ in edges}
        rank = [1 / 60] * 60
        for _ in range(400):
            loose = sum(r for i, r in enumerate(rank) if i not in out)
            new = [0.15 / 60 + 0.85 * loose / 60] * 60
            for (a, b), w in edges.items():
                new[b] += 0.85 * rank[a] * w / out[a]
            rank = new
        return rank

    nodes = spark.createDataFrame([(s, i) for s in "xy" for i in range(60)], "site_id string, node long")
    frame = lambda e: spark.createDataFrame([(s, a, b, w) for s in "xy" for (a, b), w in e.items()], "site_id string, source long, target long, weight double")
    rules = graph.RankRules(tolerance=1e-9, part_edges=2)
    first = graph.page_rank(nodes, frame(edges), rules).collect()
    assert all(r.converged and abs(r["rank"] - plain(edges)[r.node]) < 1e-9 for r in first) and len(first) == 120
    start = spark.createDataFrame([(r.site_id, r.node, r["rank"]) for r in first], "site_id string, node long, rank double")
    again = graph.page_rank(nodes, frame(edges), rules, start).collect()
    assert all(r.iterations <= 1 and abs(r["rank"] - plain(edges)[r.node]) < 1e-8 for r in again)
    moved = graph.page_rank(nodes, frame(later), rules, start).collect()
    assert all(r.converged and abs(r["rank"] - plain(later)[r.node]) < 1e-9 for r in moved)
    cut = graph.page_rank(nodes, frame(edges), graph.RankRules(max_iterations=2)).collect()
    assert not any(r.converged for r in cut) and {r.iterations for r in cut} == {2}


def test_average_linkage_matches_greedy(spark):
    rng = random.Random(11)
    n, floor = 14, 0.25
    sim = {(a, b): rng.random() for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
    groups = {i: [i] for i in range(n)}
    mean = lambda x, y: sum(sim.get((min(p, q), max(p, q)), 0.0) for p in groups[x] for q in groups[y]) / (len(groups[x]) * len(groups[y]))
    while len(groups) > 1:
        s, a, b = min((-mean(x, y), x, y) for x in groups for y in groups if x < y)
        if -s < floor:
            break
        groups[a] += groups.pop(b)
    want = sorted(sorted(g) for g in groups.values())
    nodes = spark.range(n).select(F.col("id").alias("node"))
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "left long, right long, similarity double")
    got = {}
    for r in similarity.average_linkage(nodes, pairs, floor).collect():
        got.setdefault(r.cluster, []).append(r.node)
    assert sorted(sorted(g) for g in got.values()) == want


def test_near_hash_pairs_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    sigs = {i: base[i % 6] ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for i in range(60)}
    df = spark.createDataFrame(list(sigs.items()), "id long, s long")
    got = {(r.left, r.right) for r in similarity.near_hash_pairs(df, [], 7, "id", "s").collect()}
    one = {}
    for i, s in sigs.items():
        one.setdefault(s, i)
    ids = sorted(one.values())
    want = {(a, b) for a in ids for b in ids if a < b and bin(sigs[a] ^ sigs[b]).count("1") <= 7}
    assert got == want


def test_replace_run_keeps_other_runs(spark, tmp_path):
    path = str(tmp_path / "pages")
    frame = lambda run, n: spark.range(n).select(F.lit("s").alias("site_id"), F.lit(run).alias("run_id"), F.col("id").alias("page_id"))
    tables.replace_run(frame("r1", 3), path)
    tables.replace_run(frame("r2", 4), path)
    tables.replace_run(frame("r1", 5), path)
    assert {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"r1": 5, "r2": 4}
