"""Extraction from page HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import extract
from pagewright.plans.inputs import LINKS_SQL, cte, page_links
from pagewright.plans.registry import Tables, query
from pagewright.sources import html

_UNESC = "replace(replace(replace({}, '&amp;', '&'), '&copy;', '©'), '&middot;', '·')"


def _pages(t: Tables):
    return extract.parse(t.pages)


@query("page_links", "P4 P5", cte(l=LINKS_SQL) + "SELECT page_id, source, pos, href, anchor, target, 'nav_breadcrumb' AS zone, true AS is_internal FROM l")
def _(t: Tables):
    return page_links(t).select("page_id", "source", "pos", "href", "anchor", "target", "zone", "is_internal")


@query("link_findings", "P4", cte(l=LINKS_SQL) + "SELECT page_id, target, 'http-target' AS code FROM l WHERE target LIKE 'http://%'")
def _(t: Tables):
    return extract.link_findings(page_links(t)).select("page_id", "target", "code")


@query("link_context_windows", "P6", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS anchor, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), 1) AS pos FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos, anchor, '' AS before, '' AS after, CAST(0 AS INTEGER) AS anchor_offset, false AS truncated FROM l""")
def _(t: Tables):
    return extract.link_context(_pages(t)).select("page_id", "pos", "anchor", "before", "after", "anchor_offset", "truncated")


@query("title_and_meta_findings", "P2", f"""
WITH p AS (SELECT page_id, trim(regexp_replace({_UNESC.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) AS title FROM pages)
SELECT page_id, title, array_to_string(list_filter([CASE WHEN title = '' THEN 'title-missing' END, CASE WHEN NOT length(title) BETWEEN 30 AND 60 THEN 'title-length' END, 'description-missing'], lambda x: x IS NOT NULL), ',') AS crawl_codes,
 array_to_string(list_filter([CASE WHEN title = '' THEN 'title-missing' END, CASE WHEN NOT length(title) BETWEEN 40 AND 65 THEN 'title-length' END, 'description-missing', 'canonical-missing', 'viewport-missing'], lambda x: x IS NOT NULL), ',') AS audit_codes FROM p""")
def _(t: Tables):
    p = _pages(t)
    crawl = extract.title_meta(p, "crawl").select("page_id", "title", F.array_join("codes", ",").alias("crawl_codes"))
    audit = extract.title_meta(p, "audit").select("page_id", F.array_join("codes", ",").alias("audit_codes"))
    return crawl.join(audit, "page_id")


@query("heading_rows", "P3", f"""
SELECT page_id, CAST(0 AS INTEGER) AS pos, CAST(1 AS INTEGER) AS level, trim(regexp_replace({_UNESC.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '\\s+', ' ', 'g')) AS text FROM pages""")
def _(t: Tables):
    return extract.headings(_pages(t))


@query("heading_findings", "P3 D42", """
SELECT page_id, len(regexp_extract_all(html, '<h1>'))::INTEGER AS h1_count, 0::INTEGER AS jumps, '' AS codes FROM pages""")
def _(t: Tables):
    return extract.heading_findings(_pages(t)).select("page_id", "h1_count", "jumps", F.array_join("codes", ",").alias("codes"))


@query("repeated_headings", "D42", """
WITH h AS (SELECT doc_id % 400 AS page_id, lower(trim(regexp_extract(text, '^\\s*([\\p{L}]+)', 1))) AS k, 1 + doc_id % 3 AS level FROM documents)
SELECT page_id, k AS text_key, count(*)::BIGINT AS occurrences, array_to_string(list_sort(list_distinct(list(level))), ',') AS levels FROM h WHERE k <> '' GROUP BY ALL HAVING count(*) > 1""")
def _(t: Tables):
    h = t.documents.select(
        (F.col("doc_id") % 400).alias("page_id"), F.regexp_extract("text", r"^\s*([\p{L}]+)", 1).alias("text"), (1 + F.col("doc_id") % 3).alias("level")
    )
    return extract.repeated_headings(h).withColumn("levels", F.array_join("levels", ","))


@query("main_content_text", "P1", """
WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM a""")
def _(t: Tables):
    return extract.page_text(_pages(t)).select("page_id", "text")


@query("layout_signatures", "P18", """
SELECT page_id, 'article,article/h1' || CASE WHEN regexp_matches(html, '<article>.*<p>') THEN ',article/p' ELSE '' END || ',div,footer,nav,nav/ul,nav/ul/li' AS signature, 0::INTEGER AS tables, 1::INTEGER AS unordered_lists FROM pages""")
def _(t: Tables):
    return extract.layout_signature(_pages(t)).select("page_id", "signature", "tables", "unordered_lists")


@query("script_shell_pages", "P17", """
WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages)
SELECT page_id, len(list_filter(regexp_split_to_array(trim(regexp_replace(body, '<[^>]*>', ' ', 'g')), '\\s+'), lambda x: x <> ''))::INTEGER AS words, CAST(NULL AS VARCHAR) AS reason FROM a""")
def _(t: Tables):
    return extract.script_shell(_pages(t))


@query("technology_signals", "P16", """
SELECT page_id, technology FROM (SELECT page_id, unnest(list_filter([CASE WHEN html LIKE '%track(%' THEN 'tracker' END, CASE WHEN html LIKE '%track(1%' THEN 'tracker-one' END], lambda x: x IS NOT NULL)) AS technology FROM pages)""")
def _(t: Tables):
    return extract.technologies(_pages(t), [("tracker", "track("), ("tracker-one", "track(1")]).select("page_id", "technology")


@query("section_paragraphs", "P20", """
SELECT page_id, len(regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>'))::INTEGER AS opened FROM pages""")
def _(t: Tables):
    # A paragraph that holds only a line break has no text, so opened tags are counted over the same region.
    p = _pages(t)
    inside = F.filter(html.elements("p"), lambda n: n["path"].rlike("(^|/)article"))
    return extract.sections(p).select("page_id").distinct().join(p.select("page_id", F.size(inside).alias("opened")), "page_id")


@query("page_sections", "P20")
def _(t: Tables):
    return extract.sections(_pages(t)).withColumn("paragraphs", F.array_join("paragraphs", "\n"))


@query("custom_regex_values", "P21 J1", """
SELECT page_id, 'tracked' AS definition, CAST(0 AS INTEGER) AS nr, regexp_extract(html, 'track\\((\\d+)\\)', 1) AS value FROM pages WHERE regexp_matches(html, 'track\\((\\d+)\\)')
UNION ALL SELECT page_id, 'ads', CAST(0 AS INTEGER), regexp_extract(html, '<!-- ad \\d+ -->', 0) FROM pages WHERE regexp_matches(html, '<!-- ad \\d+ -->')""")
def _(t: Tables):
    return extract.regex_extractions(t.pages, [("tracked", r"track\((\d+)\)"), ("ads", r"<!-- ad \d+ -->")])


@query("custom_selector_values", "P21 J1", f"""
SELECT page_id, 'ad' AS definition, CAST(0 AS INTEGER) AS nr, 'ad' AS value FROM pages WHERE html LIKE '%<div class="ad">%'
UNION ALL SELECT page_id, 'lang', CAST(0 AS INTEGER), regexp_extract(html, '<html lang="([^"]*)"', 1) FROM pages""")
def _(t: Tables):
    return extract.selector_extractions(_pages(t), [("ad", "div.ad", "class"), ("lang", "html[lang]", "lang")]).drop("error")


@query("custom_search_results", "P21 J1", cte(l=LINKS_SQL) + """
, a AS (SELECT page_id, list(href ORDER BY pos) FILTER (href LIKE '/a%') AS a, max(anchor) FILTER (pos = 2) AS second, max(anchor) FILTER (pos = 3) AS third, max(href) FILTER (pos = 1) AS head FROM l GROUP BY 1)
  SELECT page_id, 'a-links' AS id, array_to_string(coalesce(a, [])[1:5], '|') AS found, NULL::VARCHAR AS error, len(coalesce(a, [])) > 5 AS truncated FROM pages LEFT JOIN a USING (page_id)
  UNION ALL SELECT page_id, 'second', coalesce(second, ''), NULL, false FROM pages LEFT JOIN a USING (page_id)
  UNION ALL SELECT page_id, 'beside', coalesce(third, ''), NULL, false FROM pages LEFT JOIN a USING (page_id)
  UNION ALL SELECT page_id, 'head', coalesce(head, ''), NULL, false FROM pages LEFT JOIN a USING (page_id)
  UNION ALL SELECT page_id, 'lang', regexp_extract(html, '<html lang="([^"]*)"', 1), NULL, false FROM pages
  UNION ALL SELECT page_id, 'open', '', 'a step is empty', false FROM pages
  UNION ALL SELECT page_id, 'axis', '', $$can't read the step 'parent::div'$$, false FROM pages""")
def _(t: Tables):
    rows = extract.custom_extractions(_pages(t), [
        extract.Search("a-links", "css", "ul > li a[href^='/a']", "attribute", "href"),
        extract.Search("second", "xpath", "//nav/ul/li[2]/a/text()"),
        extract.Search("beside", "css", "li:first-child + li + li > a"),
        extract.Search("head", "xpath", "//li[position()=1]/a[@href]/@href"),
        extract.Search("lang", "css", "html[lang]:not([class]), body.none", "attribute", "lang"),
        extract.Search("open", "css", "ul >"),
        extract.Search("axis", "xpath", "//li/parent::div"),
    ])
    return rows.select("page_id", "id", F.array_join("values", "|").alias("found"), "error", "truncated")


@query("markup_findings", "P22", """
WITH p AS (SELECT page_id, unnest([{'c': 'control-unlabelled', 'n': 1}, {'c': 'link-nameless', 'n': 1}, {'c': 'image-alt-missing', 'n': 2}, {'c': 'id-duplicate', 'n': 1},
  {'c': 'lang-missing', 'n': CASE WHEN regexp_matches(html, '<html lang="[^"]+"') THEN 0 ELSE 1 END}]) AS f FROM pages)
SELECT page_id, f.c AS code, f.n::BIGINT AS occurrences FROM p WHERE f.n > 0""")
def _(t: Tables):
    # Each page gets a widget with known faults, so that every page has findings.
    widget = '<img id="w" src="a.png"><img id="w" src="b.png"><a href="/x"></a><input type="text"><input type="hidden"></body>'
    return extract.markup_findings(extract.parse(t.pages.withColumn("html", F.concat("html", F.lit(widget)))))


@query("image_rows", "P7", """
SELECT page_id, CAST(0 AS INTEGER) AS pos, regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/img/' || page_id || '.png' AS src, 640::INTEGER AS width, true AS lazy, 800::INTEGER AS largest_candidate, 'alt-missing' AS codes FROM pages
UNION ALL SELECT page_id, CAST(1 AS INTEGER), 'https://cdn.example/b.png', NULL, false, NULL, 'dimensions-missing' FROM pages""")
def _(t: Tables):
    tag = F.concat(F.lit('<img src="/img/'), F.col("page_id"), F.lit('.png" width=640 height=480 loading=lazy srcset="a.png 400w, b.png 800w"><img src="https://cdn.example/b.png" alt=""></body>'))
    p = extract.parse(t.pages.withColumn("html", F.concat("html", tag)))
    return extract.images(p).select("page_id", "pos", "src", "width", "lazy", "largest_candidate", F.array_join("codes", ",").alias("codes"))


@query("page_declarations", "P8 P9", """
WITH o AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS origin FROM pages)
SELECT page_id, d.kind, d.name, d.value FROM (SELECT page_id, unnest([{'kind': 'canonical', 'name': '', 'value': origin || '/c/' || page_id}, {'kind': 'next', 'name': '', 'value': origin || '/c/' || (page_id + 1)}, {'kind': 'icon', 'name': '', 'value': origin || '/f.ico'},
  {'kind': 'hreflang', 'name': 'de', 'value': origin || '/de/' || page_id}, {'kind': 'social', 'name': 'og:title', 'value': 'T ' || page_id}, {'kind': 'refresh', 'name': '5', 'value': origin || '/next'}, {'kind': 'frame', 'name': 'map', 'value': 'https://maps.example/m'}]) AS d FROM o)""")
def _(t: Tables):
    i = F.col("page_id")
    head = F.concat(
        F.lit('<link rel="canonical" href="/c/'), i, F.lit('"><link rel=next href="/c/'), i + 1, F.lit('"><link rel="shortcut icon" href="/f.ico"><link rel="alternate" hreflang="de" href="/de/'), i,
        F.lit('"><meta property="og:title" content=" T '), i, F.lit('"><meta http-equiv="Refresh" content="5; url=/next"></head>'),
    )
    html_text = F.concat(F.replace("html", F.lit("</head>"), head), F.lit('<iframe title="map" src="https://maps.example/m"></iframe>'))
    return extract.declarations(extract.parse(t.pages.withColumn("html", html_text))).select("page_id", "kind", "name", "value")


@query("canonical_relations", "H20 P9", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'multiple' WHEN 2 THEN 'invalid' WHEN 3 THEN 'self' WHEN 4 THEN 'same-host' ELSE 'different-host' END AS relation FROM pages""")
def _(t: Tables):
    i, u = F.col("page_id"), F.col("url")
    count = F.when(i % 6 == 0, 0).when(i % 6 == 1, 2).otherwise(1)
    target = F.when(i % 6 == 2, F.lit("mailto:x")).when(i % 6 == 3, u).when(i % 6 == 4, F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), F.lit("/other"))).otherwise(F.lit("https://elsewhere.example/"))
    return t.pages.select("page_id", extract.canonical_relation(u, count, target).alias("relation"))


@query("page_structure_features", "P19", """
WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages)
SELECT page_id, 1::BIGINT AS headings, 0::BIGINT AS tables, 1::BIGINT AS unordered_lists, len(list_filter(regexp_split_to_array(trim(regexp_replace(body, '<[^>]*>', ' ', 'g')), '\\s+'), lambda x: x <> ''))::BIGINT AS words FROM a""")
def _(t: Tables):
    return extract.page_features(_pages(t)).select("page_id", "headings", "tables", "unordered_lists", "words")
