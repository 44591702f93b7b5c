"""Stored runs, feeds and sitemaps on hand-made files."""

import json
import random

import pyarrow as pa
import pytest

from pagewright.sources import feeds, html, runs


def payload(**fields):
    return json.dumps({"url": "https://a.b/x"} | fields)


def test_pages_keep_unknown_fields_and_reject_what_isnt_a_page(spark):
    rows = [("s", "r", payload(http_status=200, title="T", extra={"deep": [1, 2]}, schema_types=["A"])), ("s", "r", payload(http_status="x", title=None, images=[{"src": "i", "width": 3}])),
            ("s", "r", "{"), ("s", "r", None), ("s", "r", "[]"), ("s", "r", "3"), ("s", "r", json.dumps({"title": "no url"})), (None, "r", payload()), ("s", None, payload())]
    pages, rejects = runs.pages_from_json(spark.createDataFrame(rows, "site_id string, run_id string, payload string"))
    got = {r.title: r for r in pages.collect()}
    assert got["T"].http_status == 200 and got["T"].schema_types == ["A"] and got["T"].links is None
    assert got[None].http_status is None and got[None].images[0].src == "i" and got[None].images[0].alt is None
    deep = pages.selectExpr("try_variant_get(payload, '$.extra.deep[1]', 'int') AS d").where("d IS NOT NULL").first().d
    assert deep == 2 and rejects.count() == 7


def test_one_run_is_read_from_its_partition_alone(spark, tmp_path):
    rows = [(f"s{i % 3}", f"r{i % 2}", payload(depth=i)) for i in range(12)]
    pages, _ = runs.pages_from_json(spark.createDataFrame(rows, "site_id string, run_id string, payload string"))
    path = f"{tmp_path}/t"
    runs.save_run(pages, path)
    one = runs.load_pages(spark, path, pages, "s1", "r0")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_id" in plan and sorted(r.depth for r in one.collect()) == [4, 10]
    assert {f.split("site_id=")[1].rsplit("/", 1)[0] for f in one.inputFiles()} >= {"s1/run_id=r0"}
    runs.save_run(pages.where("site_id = 's1' AND depth = 4"), path)
    assert sorted(r.depth for r in runs.load_pages(spark, path, pages).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    runs.replace_history(spark, pages.where("site_id = 's0' AND run_id = 'r1'"), path, "s0")
    assert sorted((r.site_id, r.depth) for r in runs.load_pages(spark, path, pages).collect() if r.site_id == "s0") == [("s0", 3), ("s0", 9)]


def test_exports_are_flat_and_disarmed(spark):
    rows = [("s", "r", payload(title="=cmd()", issues=[{"severity": "error", "message": "m"}, {"message": "+1"}], redirect_chain=[{"http_status": 301, "from_url": "a", "to_url": "b"}])), ("s", "r", payload(url="https://a.b/y"))]
    pages, _ = runs.pages_from_json(spark.createDataFrame(rows, "site_id string, run_id string, payload string"))
    flat = {r.url: r for r in runs.pages_export(pages).collect()}
    x, y = flat["https://a.b/x"], flat["https://a.b/y"]
    assert (x.title, x.issues, x.redirect_chain) == ("'=cmd()", "error: m | : +1", "301: a -> b (timing unavailable)")
    assert (y.title, y.issues, y.issues_count, y.redirect_chain, y.body_truncated) == ("", "", "0", "", "")
    own = [r for r in runs.audit_export(pages).orderBy("url", "nr").collect() if r.url == "https://a.b/x"]
    assert [r.a for r in own][:2] == ["Field", "URL"] and (own[-1].a, own[-1].d) == ("Issue", "'+1") and own[-4].a == ""
    assert runs.nested_rows(pages, "issues").count() == 2


def test_rss(spark):
    item = lambda x: f"<item><title>t</title><link>{x}</link></item>"
    rows = [("a", "<rss><channel>" + item("https://x.y/1") + item("nothing") + item("https://x.y/2") + "</channel></rss>"), ("b", "<rss><channel></channel></rss>"), ("c", "<feed/>"), ("d", "<rss><chan"),
            ("e", "<!DOCTYPE x><rss><channel/></rss>"), ("f", None), ("g", "<rss><channel>" + item("https://x.y/3") + "</channel></rss>")]
    found, rejected = feeds.rss_results(spark.createDataFrame(rows, "keyword string, text string"))
    assert sorted((r.keyword, r["rank"], r.url) for r in found.collect()) == [("a", 1, "https://x.y/1"), ("a", 3, "https://x.y/2"), ("g", 1, "https://x.y/3")]
    assert {r.keyword for r in rejected.collect()} >= {"c", "d", "e", "f"}


def test_trends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Trend,Search-Volume,pub date,Other\n"two\nlines",200K+,2024-01-02 03:04:05,x\n,5,,\nb,"1,500",later,"q ""x"""\nc,,,\n')
    got = {r.keyword: (r.traffic, r.volume, str(r.started)) for r in feeds.trend_rows(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"two\nlines": ("200K+", 200000, "2024-01-02 03:04:05"), "b": ("1,500", 1500, "None"), "c": (None, None, "None")}
    (tmp_path / "b.csv").write_text("Trend,keyword\na,b\n")
    (tmp_path / "c.csv").write_text("traffic\n5\n")
    for name in "bc":
        with pytest.raises(ValueError):
            feeds.trend_rows(spark, str(tmp_path / f"{name}.csv"))


def test_sitemaps_follow_any_graph_of_indexes(spark):
    rng = random.Random(4)
    names = [f"https://h.example/{i}.xml" for i in range(30)]
    links = {n: [] for n in names}
    for i, n in enumerate(names[:18]):  # indexes: a chain, random links and cycles, a foreign and a missing one
        links[n] = [names[i + 1], *rng.sample(names[10:], 2), names[0], "https://other.example/s.xml", "https://h.example/missing.xml"]
    pages = {n: [f"https://h.example/in/{rng.randrange(60)}", f"https://h.example/out/{i}", "https://other.example/in/1", "no address"] for i, n in enumerate(names[18:])}
    text = lambda n: "<SitemapIndex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in links[n]) + "</SitemapIndex>" if n not in pages else "<urlset>" + "".join(f"<url><LOC >\n {x} </LOC></url>" for x in pages[n]) + "</urlset>"
    files = spark.createDataFrame([(n, text(n)) for n in names] + [("https://h.example/never.xml", "<urlset><loc>https://h.example/in/never</loc></urlset>")], "file string, text string")
    found, reached = feeds.discovered_urls(files, spark.createDataFrame([(names[2],), ("https://other.example/",), (None,)], "file string"), "h.example", "/in/")
    depth, todo = {names[2]: 0}, [names[2]]
    while todo:
        n = todo.pop(0)
        for x in links.get(n, []):
            if x not in depth and x.startswith("https://h.example"):
                depth[x] = depth[n] + 1
                todo.append(x)
    assert {r.sitemap: (r.depth, r.loaded) for r in reached.collect()} == {n: (d, n in links) for n, d in depth.items()}
    want = {}
    for n in depth:
        for u in pages.get(n, []):
            if u.startswith("https://h.example/in/"):
                want.setdefault(u, set()).add(n)
    assert {r.url: r.sitemaps for r in found.collect()} == {u: len(of) for u, of in want.items()}


def test_what_a_sitemap_file_is_is_told_once_a_file(spark):
    urls = "".join(f"<url><loc> https://m.example/{i} </loc></url>" for i in range(3))
    files = spark.createDataFrame([("a", f"<urlset>{urls}</urlset>"), ("b", "<SitemapIndex><loc>x</loc></SitemapIndex>"), ("c", None)], "file string, text string")
    got = feeds.sitemap_locations(files)
    assert sorted((r.file, r.is_index, r.location) for r in got.collect()) == [*(("a", False, f"https://m.example/{i}") for i in range(3)), ("b", True, "x")]
    # The plan prints the top first: texts are searched below the step that makes rows of them.
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    line = lambda word: next(i for i, x in enumerate(plan) if word in x)
    assert line("sitemapindex") > line("Generate")


def test_few_pages_at_a_time_become_nodes(spark, monkeypatch):
    pages = ["<p>" + "x" * n + "</p>" for n in (10, 20, 5000, 1, 1)] + [None, ""]
    monkeypatch.setattr(html, "_PART", 64)
    parts = [p.to_pylist() for p in html._few(pa.array(pages))]
    assert sum(parts, []) == pages and [len(p) for p in parts] == [2, 1, 4]
    assert [*html._few(pa.array([], pa.string()))] == []
    frame = spark.createDataFrame([(i, pages[i % 7]) for i in range(70)], "id int, html string").coalesce(1)
    got = {r.id: r.n for r in html.with_nodes(frame).selectExpr("id", "transform(nodes, x -> x.text) AS n").collect()}
    assert got == {i: None if pages[i % 7] is None else [] if not pages[i % 7] else [pages[i % 7][3:-4]] * 2 for i in range(70)}
