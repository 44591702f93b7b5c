"""Filters, findings, link joins and roll-ups over crawled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import status, urls
from pagewright.operators import pages as ops
from pagewright.plans.inputs import EDGES_SQL, LINKS_SQL, PAGES_SQL, crawl_pages, cte, page_links, supply_edges
from pagewright.plans.registry import Tables, query
from pagewright.sources import html, jsonld

# Independent statement of the comparison key and the index state in SQL.
_KEYED = """
SELECT *, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS origin, split_part(url, '#', 1) AS bare FROM c"""
_STATE = """
SELECT *, CASE WHEN http_status >= 400 THEN 'error-status'
  WHEN regexp_matches(coalesce(meta_robots, ''), '(?i)(^|[\\s,;])(noindex|none)([\\s,;]|$)') OR x_robots_tag = 'noindex' THEN 'noindex'
  WHEN page_id % 5 IN (1, 3) THEN 'canonicalized' WHEN http_status >= 200 THEN 'indexable' ELSE 'unknown' END AS index_state FROM c"""
_BASE = dict(c=PAGES_SQL)
_S = dict(c=PAGES_SQL, s=_STATE)
_GATE = "CASE WHEN regexp_matches(bare, '^[a-z]+://[^/]+/$') THEN bare WHEN bare LIKE '%?%' THEN rtrim(split_part(bare, '?', 1), '/') || '?' || split_part(bare, '?', 2) ELSE rtrim(bare, '/') END"


@query("url_filter_reasons", "B1", """
SELECT CASE WHEN NOT regexp_matches(url, '/en/|/fr/|/de/') THEN 'no-include-match' WHEN regexp_matches(url, 'page=|\\.html$') THEN 'exclude-match' ELSE 'accepted' END AS reason, count(*)::BIGINT AS pages FROM pages GROUP BY 1""")
def _(t: Tables):
    reason = status.filter_reason(F.col("url"), ["/en/", "/fr/", "/de/"], ["page=", r"\.html$"])
    return t.pages.groupBy(reason.alias("reason")).agg(F.count("*").alias("pages"))


@query("scope_membership", "B2", """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/]+)', 1)) AS host, regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '://[^/]+(.*)$', 1) AS path FROM pages)
SELECT page_id, CASE WHEN host = 'example.net' OR host LIKE '%.example.net' THEN path = '/en' OR path LIKE '/en/%' ELSE host LIKE '%.example.org' END AS inside FROM h""")
def _(t: Tables):
    inside = status.in_scope(F.col("url"), "example.net", subdomains=True, path="/en/", allowed=("example.org",))
    return t.pages.select("page_id", inside.alias("inside"))


@query("index_states", "B3", cte(**_S) + "SELECT page_id, index_state FROM s")
def _(t: Tables):
    return ops.with_index_state(crawl_pages(t)).select("page_id", "index_state")


@query("index_gate_summary", "B4", cte(**_S) + "SELECT site_id, run_id, index_state, count(*)::BIGINT AS pages FROM s GROUP BY ALL")
def _(t: Tables):
    return ops.index_gate_summary(crawl_pages(t))


@query("index_gate_pages", "B4", cte(**_S) + "SELECT page_id, url FROM s WHERE index_state IN ('indexable', 'unknown')")
def _(t: Tables):
    return ops.index_gate(crawl_pages(t)).select("page_id", "url")


@query("index_assessments", "B5", cte(c=PAGES_SQL, r="""
SELECT page_id, list_filter([CASE WHEN NOT http_status BETWEEN 200 AND 299 THEN 'status-not-2xx' END, CASE WHEN meta_robots IN ('noindex, follow', 'none') THEN 'meta-noindex' END,
  CASE WHEN x_robots_tag IS NOT NULL THEN 'header-noindex' END], lambda x: x IS NOT NULL) AS b,
  CASE WHEN canonical IS NULL THEN ['canonical-missing'] WHEN page_id % 5 IN (1, 3) THEN ['canonical-elsewhere'] ELSE [] END AS o FROM c""") +
"SELECT page_id, CASE WHEN len(b) > 0 THEN 'blocked' WHEN len(o) = 0 THEN 'indexable' ELSE 'uncertain' END AS state, array_to_string(list_concat(b, o), ',') AS reasons FROM r")
def _(t: Tables):
    p = crawl_pages(t)
    state, reasons = status.index_reasons(*(F.col(c) for c in ("http_status", "meta_robots", "x_robots_tag", "url", "canonical")))
    return p.select("page_id", state.alias("state"), F.array_join(reasons, ",").alias("reasons"))


_LINKSTAT = """
SELECT *, CASE pos % 5 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 301 WHEN 3 THEN 503 END::INTEGER AS target_status, CASE WHEN page_id % 11 = 0 THEN 'dns' WHEN page_id % 11 = 1 THEN 'timeout' END AS error_kind,
  CASE WHEN page_id % 4 = 0 THEN target || '/moved' END AS redirect_url FROM l"""
_LINKCLASS = """CASE WHEN error_kind = 'dns' THEN 'broken' WHEN error_kind IS NOT NULL THEN 'unverifiable' WHEN target_status = 404 THEN 'broken' WHEN target_status >= 400 THEN 'unverifiable'
  WHEN target_status >= 300 OR redirect_url IS NOT NULL THEN 'redirect' WHEN target_status >= 200 THEN 'ok' ELSE 'unchecked' END"""


def _checked_links(t: Tables):
    pos, pid = F.col("pos"), F.col("page_id")
    code = F.when(pos % 5 == 0, 404).when(pos % 5 == 1, 200).when(pos % 5 == 2, 301).when(pos % 5 == 3, 503)
    return page_links(t).withColumns({
        "target_status": code, "error_kind": F.when(pid % 11 == 0, "dns").when(pid % 11 == 1, "timeout"),
        "redirect_url": F.when(pid % 4 == 0, F.concat("target", F.lit("/moved"))),
    })


@query("link_status_classes", "B6", cte(l=LINKS_SQL, k=_LINKSTAT) + f"SELECT page_id, pos, {_LINKCLASS} AS link_status FROM k")
def _(t: Tables):
    return _checked_links(t).select("page_id", "pos", status.link_status(F.col("error_kind"), F.col("target_status"), F.col("redirect_url")).alias("link_status"))


@query("filtered_links", "B7", cte(l=LINKS_SQL, k=_LINKSTAT, m=f"SELECT *, {_LINKCLASS} AS link_status FROM k") +
"SELECT page_id, pos, source, target, anchor FROM m WHERE link_status = 'redirect' AND (contains(lower(anchor), 'th') OR contains(lower(source), 'th') OR contains(lower(target), 'th') OR contains(lower(coalesce(error_kind, '')), 'th'))")
def _(t: Tables):
    return ops.filter_links(_checked_links(t), "internal", "redirect", "TH", "anchor").select("page_id", "pos", "source", "target", "anchor")


@query("listing_pages", "B11", cte(c=PAGES_SQL, e="SELECT 'https://s.example/list/' || o_custkey AS url, o_custkey, o_orderkey FROM orders", g="SELECT o_custkey, count(DISTINCT o_orderkey) AS linked FROM e GROUP BY 1") +
"SELECT o_custkey, linked::BIGINT AS linked, (linked >= 5 AND (o_custkey % 900) / linked < 45) AS is_listing FROM g")
def _(t: Tables):
    page = F.concat(F.lit("https://s.example/list/"), F.col("o_custkey"))
    links = t.orders.select(page.alias("source"), F.concat(F.lit("https://s.example/list/d"), F.col("o_orderkey")).alias("target"))
    pages = t.orders.select("o_custkey", page.alias("url"), (F.col("o_custkey") % 900).alias("word_count")).distinct()
    return ops.listing_pages(pages, links).select("o_custkey", "linked", "is_listing")


@query("page_types", "B12", cte(c=PAGES_SQL, l=LINKS_SQL, p=_KEYED,
  out="SELECT site_id, source, count(DISTINCT target) AS n FROM (SELECT DISTINCT site_id, source, target FROM l) GROUP BY ALL") + f"""
SELECT page_id, CASE WHEN regexp_matches(bare, '^[a-z]+://[^/]+/?$') THEN 'homepage' ELSE 'article' END AS page_type,
 CASE WHEN regexp_matches(bare, '^[a-z]+://[^/]+/?$') THEN 3.0 ELSE 1.0 END::DOUBLE AS type_weight FROM p""")
def _(t: Tables):
    p = crawl_pages(t).withColumn("start_url", F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), F.lit("/")))
    return ops.page_types(p, page_links(t)).select("page_id", "page_type", "type_weight")


@query("skip_reasons", "B13", cte(**_BASE) + """
SELECT page_id, CASE WHEN request_error_kind = 'timeout' THEN 'render-timeout' WHEN request_error_kind IS NOT NULL THEN 'request-error' WHEN http_status NOT BETWEEN 200 AND 299 THEN 'non-topical-status'
  WHEN page_id % 3 = 0 THEN 'non-html' WHEN word_count < 200 THEN 'no-content' END AS reason FROM c""")
def _(t: Tables):
    kind = F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    return crawl_pages(t).select("page_id", status.skip_reason(F.col("request_error_kind"), F.col("http_status"), kind, F.col("word_count") >= 200).alias("reason"))


@query("score_bands", "B14", """
WITH s AS (SELECT c_custkey, floor((c_acctbal + 1000) / 110) AS score FROM customer)
SELECT c_custkey, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'moderate' WHEN score >= 40 THEN 'weak' ELSE 'critical' END AS focus,
 CASE WHEN score >= 75 THEN 'strong' WHEN score >= 60 THEN 'moderate' WHEN score >= 50 THEN 'borderline' WHEN score >= 40 THEN 'weak' ELSE 'off-topic' END AS page,
 CASE WHEN score < 40 THEN 'critical' WHEN score < 60 THEN 'high' WHEN score < 75 THEN 'medium' ELSE 'low' END AS priority FROM s""")
def _(t: Tables):
    score = F.floor((F.col("c_acctbal") + 1000) / 110)
    return t.customer.select("c_custkey", status.focus_band(score).alias("focus"), status.page_band(score).alias("page"), status.priority_band(score).alias("priority"))


@query("page_segments", "B15", """
WITH s AS (SELECT page_id, lower(regexp_extract(url, '://[^/]+/([^/?#]*)', 1)) AS first FROM pages)
SELECT page_id, CASE first WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' END AS segment FROM s""")
def _(t: Tables):
    return ops.segment_of(t.pages, [("english", "/en"), ("french", "/fr/"), ("german", "de"), ("late", "/en")]).select("page_id", "segment")


@query("trusted_hosts", "B16", """
WITH h AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'data' || s_suppkey || '.gov' WHEN 1 THEN 'uni' || s_suppkey || '.ac.uk' WHEN 2 THEN 'a.seed.example' WHEN 3 THEN 'notseed.example' WHEN 4 THEN 'x.bund.de' ELSE 'shop.com' END AS host FROM supplier)
SELECT s_suppkey, host, s_suppkey % 6 IN (0, 1, 2, 4) AS trusted FROM h""")
def _(t: Tables):
    k = F.col("s_suppkey")
    host = F.when(k % 6 == 0, F.concat(F.lit("data"), k, F.lit(".gov"))).when(k % 6 == 1, F.concat(F.lit("uni"), k, F.lit(".ac.uk"))).when(k % 6 == 2, "a.seed.example").when(k % 6 == 3, "notseed.example").when(k % 6 == 4, "x.bund.de").otherwise("shop.com")
    return t.supplier.select("s_suppkey", host.alias("host"), status.is_trusted_host(host, ("seed.example",)).alias("trusted"))


def _u(col):
    return F.concat(F.lit("https://www.shop.example/o/"), col, F.lit("/"))


@query("removal_quarantine", "B17", """
WITH removed AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), prot AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), need AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P'),
grp AS (SELECT o_custkey, min(o_orderkey) AS c FROM orders GROUP BY 1), mem AS (SELECT c, o_orderkey AS k FROM orders JOIN grp USING (o_custkey)),
first AS (SELECT k, CASE WHEN k IN (FROM prot) THEN 'protected-by-evidence' WHEN k IN (FROM need) THEN 'needs-data' ELSE 'remove' END AS outcome, NULL AS redirect_to FROM removed),
gone AS (SELECT k FROM first WHERE outcome = 'remove'),
al AS (SELECT k, outcome, CAST(NULL AS BIGINT) AS r FROM first
UNION ALL SELECT DISTINCT c, 'canonical-removed', NULL FROM mem WHERE c IN (FROM gone)
UNION ALL SELECT k, 'redirect', min(c) FROM mem WHERE c NOT IN (FROM gone) AND k <> c AND k NOT IN (FROM gone) AND k NOT IN (FROM prot) GROUP BY k)
SELECT 'https://shop.example/o/' || k AS url, outcome, 'https://shop.example/o/' || r AS redirect_to FROM al""")
def _(t: Tables):
    o = t.orders
    groups = o.join(o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("c")), "o_custkey").select(_u(F.col("c")).alias("canonical"), _u(F.col("o_orderkey")).alias("url"))
    return ops.removal_quarantine(
        t.lineitem.where("l_returnflag = 'R'").select(_u(F.col("l_orderkey")).alias("url")), groups,
        o.where("o_orderpriority = '1-URGENT'").select(_u(F.col("o_orderkey")).alias("url")), o.where("o_orderstatus = 'P'").select(_u(F.col("o_orderkey")).alias("url")),
    )


@query("suggestions_outside_quarantine", "B17", """
SELECT DISTINCT 'https://w.example/p/' || l_partkey AS source, 'https://w.example/s/' || l_suppkey AS target FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def _(t: Tables):
    at = lambda kind, c: F.concat(F.lit(f"https://w.example/{kind}/"), F.col(c))
    items = t.lineitem.select(at("p", "l_partkey").alias("source"), at("s", "l_suppkey").alias("target")).distinct()
    bad = t.part.where("p_size > 40").select(at("p", "p_partkey").alias("url")).union(t.supplier.where("s_acctbal < 0").select(at("s", "s_suppkey").alias("url")))
    return ops.drop_quarantined(items, bad.withColumn("outcome", F.lit("remove")))


@query("page_text_filter", "B18", cte(**_S) + "SELECT page_id FROM s WHERE contains(lower(url || ' t ' || http_status || ' ' || index_state), 'noindex')")
def _(t: Tables):
    rows = ops.with_index_state(crawl_pages(t)).withColumn("title", F.lit("t"))
    return ops.text_filter(rows, " NOINDEX ").select("page_id")


# A link graph whose targets are pages: each page links to its successors in number order.
_RING = "SELECT a.page_id, a.url AS source, (a.page_id * s.step + s.step) % (SELECT count(*) FROM pages) AS \"to\" FROM pages a, (VALUES (1), (2), (3)) s(step)"


def _ring_links(t: Tables):
    p = crawl_pages(t)
    steps = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    n = t.pages.agg(F.count("*")).scalar()
    src = p.select("page_id", "run_id", F.col("url").alias("source"), steps.alias("step")).withColumn("to", (F.col("page_id") * F.col("step") + F.col("step")) % n)
    return src.join(p.select(F.col("page_id").alias("to"), F.col("url").alias("target")), "to").withColumn("is_internal", F.lit(True)).withColumn("pos", F.col("step"))


@query("link_target_status", "C4", cte(c=PAGES_SQL, r=_RING) + "SELECT r.page_id, t.url AS target, t.http_status AS target_status FROM r JOIN c t ON t.page_id = r.to")
def _(t: Tables):
    return ops.link_target_status(_ring_links(t), crawl_pages(t).drop("site_id")).select("page_id", "target", "target_status")


@query("broken_target_findings", "C4", cte(c=PAGES_SQL, r=_RING) + "SELECT 'r1' AS run_id, r.source, count(DISTINCT t.url)::BIGINT AS broken_targets FROM r JOIN c t ON t.page_id = r.to WHERE t.http_status = 0 OR t.http_status >= 400 GROUP BY 1, 2")
def _(t: Tables):
    return ops.broken_target_findings(_ring_links(t), crawl_pages(t).drop("site_id"))


@query("canonical_target_status", "C5", cte(c=PAGES_SQL, p=_KEYED) + """
SELECT p.page_id, p.target, t.http_status AS target_status, CASE WHEN t.http_status = 0 OR t.http_status >= 400 THEN 'canonical-target-error' END AS finding
FROM (SELECT page_id, CASE page_id % 5 WHEN 1 THEN origin || canonical WHEN 0 THEN split_part(canonical, '#', 1) ELSE canonical END AS target FROM p WHERE canonical IS NOT NULL) p
LEFT JOIN c t ON t.url = p.target""")
def _(t: Tables):
    return ops.canonical_target_status(crawl_pages(t).drop("site_id")).select("page_id", "target", "target_status", "finding")


@query("pagination_reciprocity", "C6", """
WITH e AS (SELECT DISTINCT 'n' || l_suppkey AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'next' ELSE 'prev' END AS r, 'n' || (l_partkey % 120) AS t FROM lineitem),
k AS (SELECT DISTINCT 'n' || s_suppkey AS t FROM supplier)
SELECT 'https://x.example/' || e.s AS source, e.r AS relation, 'https://x.example/' || e.t AS target, CASE WHEN k.t IS NOT NULL THEN b.s IS NOT NULL END AS reciprocal
FROM e LEFT JOIN k ON k.t = e.t LEFT JOIN e b ON b.s = e.t AND b.t = e.s AND b.r = CASE e.r WHEN 'next' THEN 'prev' ELSE 'next' END""")
def _(t: Tables):
    at = lambda c: F.concat(F.lit("https://x.example/n"), c)
    rel = t.lineitem.select(at(F.col("l_suppkey")).alias("source"), F.when(F.col("l_linenumber") % 2 == 0, "NEXT").otherwise("prev").alias("relation"), at(F.col("l_partkey") % 120).alias("target"))
    return ops.relation_reciprocity(t.supplier.select(at(F.col("s_suppkey")).alias("url")), rel, {"next": "prev", "prev": "next"})


def _alternates(t: Tables):
    at = lambda c: F.concat(F.lit("https://x.example/n"), c)
    alt = t.lineitem.select(at(F.col("l_suppkey")).alias("source"), F.substring("l_returnflag", 1, 1).alias("language"), at(F.col("l_partkey") % 120).alias("target")).distinct()
    k = F.col("s_suppkey")
    pages = t.supplier.select(k.alias("page_id"), at(k).alias("url"), F.when(k % 4 == 0, 404).otherwise(200).alias("http_status"), F.when(k % 3 == 0, at(k)).when(k % 3 == 1, F.lit("/other")).alias("canonical"))
    return pages, alt


@query("alternate_targets", "C7", """
WITH a AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS language, l_partkey % 120 AS t FROM lineitem)
SELECT 'https://x.example/n' || a.s AS source, a.language, 'https://x.example/n' || a.t AS target, CASE WHEN k.s_suppkey IS NULL THEN NULL WHEN a.t % 4 = 0 THEN 404 ELSE 200 END::INTEGER AS target_status,
  CASE WHEN k.s_suppkey IS NOT NULL AND d.t IS NOT NULL THEN b.s IS NOT NULL END AS reciprocal,
  CASE WHEN k.s_suppkey IS NOT NULL THEN CASE a.t % 3 WHEN 0 THEN 'self-canonical' WHEN 1 THEN 'canonical-points-elsewhere' ELSE 'missing-canonical' END END AS alignment
FROM a LEFT JOIN supplier k ON k.s_suppkey = a.t LEFT JOIN (SELECT DISTINCT s AS t FROM a) d ON d.t = a.t LEFT JOIN (SELECT DISTINCT s, t FROM a) b ON b.s = a.t AND b.t = a.s""")
def _(t: Tables):
    return ops.alternate_targets(*_alternates(t))


@query("amp_targets", "C8", """
SELECT 'https://x.example/n' || p_partkey AS source, 'https://x.example/n' || (p_partkey % 150) AS target, CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_suppkey % 4 = 0 THEN 404 ELSE 200 END::INTEGER AS target_status,
  CASE WHEN s_suppkey IS NOT NULL THEN CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN p_partkey = s_suppkey THEN 'canonical-to-source' ELSE 'self-canonical' END WHEN 1 THEN 'canonical-points-elsewhere' ELSE 'missing-canonical' END END AS alignment
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150""")
def _(t: Tables):
    pages, _ = _alternates(t)
    at = lambda c: F.concat(F.lit("https://x.example/n"), c)
    return ops.amp_targets(pages, t.part.select(at(F.col("p_partkey")).alias("source"), at(F.col("p_partkey") % 150).alias("target")))


@query("robots_decisions", "C11 P23", """
WITH u AS (SELECT page_id, regexp_extract(url, '://[^/]+(.*)$', 1) AS p, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages),
q AS (SELECT page_id, split_part(p, '#', 1) AS p FROM u),
r AS (SELECT page_id, p, [CASE WHEN starts_with(p, '/en/') THEN {'w': 4, 'allow': false, 'rule': '/en/'} END, CASE WHEN starts_with(p, '/en/7') THEN {'w': 5, 'allow': true, 'rule': '/en/7'} END,
  CASE WHEN regexp_matches(p, '^/.*\\.html$') THEN {'w': 6, 'allow': false, 'rule': '/*.html$'} END, CASE WHEN regexp_matches(p, '^/.*page=') THEN {'w': 6, 'allow': true, 'rule': '/*page='} END, CASE WHEN regexp_matches(p, '^/.*/8') THEN {'w': 3, 'allow': false, 'rule': '/*/8'} END] AS c FROM q),
b AS (SELECT page_id, list_sort(list_filter(c, lambda x: x IS NOT NULL), 'DESC')[1] AS best FROM r)
SELECT page_id, best.rule AS rule, coalesce(best.allow, true) AS allowed FROM b""")
def _(t: Tables):
    body = "User-agent: x\nUser-agent: *\nDisallow: /en/ # part\nAllow: /en/7\nDisallow: /*.html$\nAllow: /*page=\nDisallow: /*/8\n\nUser-agent: other\nDisallow: /"
    files = t.pages.select(urls.host(F.col("url")).alias("host")).distinct().withColumn("text", F.lit(body))
    return ops.robots_decisions(t.pages, ops.robots_rules(files)).select("page_id", "rule", "allowed")


@query("robots_rule_rows", "P23", """
WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/]+)', 1)) AS host FROM pages)
SELECT host, agent, directive, path FROM h, (VALUES ('x', 'disallow', '/en/'), ('*', 'disallow', '/en/'), ('x', 'crawl-delay', '5'), ('*', 'crawl-delay', '5'), ('other', 'disallow', '/')) r(agent, directive, path)""")
def _(t: Tables):
    body = "User-agent: X\nUser-agent: *\nDisallow: /en/ # part\nDisallow:\nCrawl-delay: 5\n\nUser-agent: other\nDisallow: /"
    return ops.robots_rules(t.pages.select(urls.host(F.col("url")).alias("host")).distinct().withColumn("text", F.lit(body)))


@query("index_conflicts", "C18", cte(**_S, g=_KEYED.replace("FROM c", "FROM s"), y=f"SELECT *, {_GATE} AS k FROM g",
 z="SELECT k, max(CASE WHEN page_id % 2 = 0 THEN page_id % 6 END) AS clicks, max(CASE WHEN page_id % 3 = 0 THEN page_id % 4 END) AS domains, max(page_id % 120) AS inlinks, bool_or(page_id % 10 = 0) AS pil, bool_or(page_id % 4 = 1) AS smap FROM y GROUP BY 1",
 x="SELECT page_id, url, index_state, clicks, domains, inlinks, pil, smap FROM y JOIN z USING (k)") + """
SELECT page_id, url, clicks, domains, inlinks, unnest(list_filter([CASE WHEN index_state = 'noindex' AND pil THEN 'pillar-noindex' END, CASE WHEN index_state = 'noindex' AND (coalesce(clicks, 0) > 0 OR coalesce(domains, 0) > 0) THEN 'noindex-with-traffic' END,
  CASE WHEN index_state = 'noindex' AND smap THEN 'sitemap-noindex' END, CASE WHEN index_state = 'canonicalized' AND inlinks >= 50 AND page_id % 5 = 3 THEN 'inlinked-foreign-canonical' END], lambda x: x IS NOT NULL)) AS code FROM x""")
def _(t: Tables):
    p = crawl_pages(t)
    k = p.select("page_id", urls.url_key(F.col("url"), "gate").alias("url_key"))
    i = F.col("page_id")
    return ops.index_conflicts(
        p, k.select("url_key", (i % 120).alias("inlinks")), k.where(i % 2 == 0).select("url_key", (i % 6).alias("clicks")),
        k.where(i % 3 == 0).select("url_key", (i % 4).alias("domains")), k.where(i % 4 == 1), k.where(i % 10 == 0),
    ).select("page_id", "url", "clicks", "domains", "inlinks", "code")


@query("alias_resolution", "C25", """
SELECT 'https://a.example/' || l_partkey AS url_key, 'https://a.example/' || CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 50 ELSE l_partkey END AS resolved, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2""")
def _(t: Tables):
    k = F.col("p_partkey")
    alias = t.part.where(k % 3 != 1).select(F.concat(F.lit("https://a.example/"), k).alias("alias"), F.concat(F.when(k % 3 == 0, "https://a.example/").otherwise("https://b.example/"), k % 50).alias("target"))
    rows = t.lineitem.select(F.concat(F.lit("https://a.example/"), F.col("l_partkey")).alias("url_key"))
    return ops.resolve_aliases(rows, alias).groupBy("url_key", "resolved").agg(F.count("*").alias("n"))


# Structured data written from the catalogue: products that name a brand node, brands declared on some pages only.
def _triples(t: Tables):
    k = F.col("p_partkey")
    page = F.concat(F.lit("https://g.example/p/"), k)
    brand = F.regexp_replace("p_brand", "[^0-9]", "").cast("int")
    home = F.concat(F.lit("https://g.example/p/"), brand)
    entry = lambda path, prop, value: F.struct(F.lit(path).alias("path"), F.lit(prop).alias("property"), value.cast("string").alias("value"))
    declares = brand % 3 != 0
    triples = F.array_compact(F.array(
        entry("$", "@type", F.lit("Product")), entry("$", "brand", F.concat(home, F.lit("#brand"))), entry("$", "name", F.col("p_name")),
        F.when(declares & (k % 2 == 0), entry("$.b", "@id", F.concat(home, F.lit("#brand")))), F.when(declares & (k % 2 == 0), entry("$.b", "@type", F.when(k % 14 == 0, "Person").otherwise("Organization"))),
        F.when(declares & (k % 2 == 0), entry("$.b", "name", F.when(brand % 5 == 1, F.col("p_type")).otherwise(F.col("p_brand")))),
        F.when(k % 9 == 0, entry("$.o", "@type", F.lit("Organization"))), F.when(k % 9 == 0, entry("$.o", "name", F.col("p_type"))),
    ))
    return t.part.select(F.lit("r1").alias("run_id"), page.alias("page"), F.lit(0).alias("decl"), F.explode(triples).alias("t")).select("run_id", "page", "decl", "t.path", "t.property", "t.value")


_PART = "SELECT p_partkey AS k, p_name, p_brand, p_type, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS b FROM part"


@query("dangling_references", "C26", cte(p=_PART) + """
SELECT DISTINCT 'r1' AS run_id, 'https://g.example/p/' || k AS page, 'brand' AS property, 'https://g.example/p/' || b || '#brand' AS value FROM p
WHERE b IN (SELECT p_partkey FROM part) AND b NOT IN (SELECT b FROM p WHERE b % 3 <> 0 AND k % 2 = 0)""")
def _(t: Tables):
    pages = t.part.select(F.lit("r1").alias("run_id"), F.concat(F.lit("https://g.example/p/"), F.col("p_partkey")).alias("url"))
    return ops.dangling_references(_triples(t), pages)


@query("entity_registry", "D29", cte(p=_PART) + """
SELECT 'r1' AS run_id, 'https://g.example/p/' || b || '#brand' AS id, count(*)::BIGINT AS declarations, count(DISTINCT k)::BIGINT AS pages,
 array_to_string(list_sort(list_distinct(list(CASE WHEN k % 14 = 0 THEN 'person' ELSE 'organization' END))), ',') AS types, array_to_string(list_sort(list_distinct(list(lower(CASE WHEN b % 5 = 1 THEN p_type ELSE p_brand END)))), ',') AS names
FROM p WHERE b % 3 <> 0 AND k % 2 = 0 GROUP BY b""")
def _(t: Tables):
    return ops.entity_registry(ops.entity_nodes(_triples(t))).withColumns({"types": F.array_join("types", ","), "names": F.array_join("names", ",")})


@query("entity_conflicts", "D30", cte(p=_PART, d="SELECT 'https://g.example/p/' || b || '#brand' AS id, CASE WHEN k % 14 = 0 THEN 'person' ELSE 'organization' END AS ty, lower(CASE WHEN b % 5 = 1 THEN p_type ELSE p_brand END) AS nm FROM p WHERE b % 3 <> 0 AND k % 2 = 0") + """
SELECT 'r1' AS run_id, id, 'type-conflict' AS code FROM d GROUP BY id HAVING count(DISTINCT ty) > 1
UNION ALL SELECT 'r1', id, 'name-conflict' FROM d GROUP BY id HAVING count(DISTINCT nm) > 1
UNION ALL SELECT 'r1', 'organization:' || lower(p_type), 'name-without-id' FROM p WHERE k % 9 = 0 GROUP BY p_type HAVING count(*) > 1""")
def _(t: Tables):
    return ops.entity_conflicts(ops.entity_nodes(_triples(t)))


_FIND = """SELECT site_id, run_id, page_id, unnest(list_filter([CASE WHEN request_error_kind IS NOT NULL OR http_status = 0 THEN {'s': 'Critical', 'c': 'request-failed'} END, CASE WHEN http_status >= 500 THEN {'s': 'Critical', 'c': 'server-error'} END,
 CASE WHEN http_status BETWEEN 400 AND 499 THEN {'s': 'Critical', 'c': 'client-error'} END, CASE WHEN http_status BETWEEN 300 AND 399 THEN {'s': 'Warning', 'c': 'redirect'} END, CASE WHEN response_time_ms > 2000 THEN {'s': 'Warning', 'c': 'slow-response'} END], lambda x: x IS NOT NULL)) AS f FROM c"""


@query("status_findings", "P14", cte(c=PAGES_SQL, f=_FIND) + "SELECT site_id, run_id, page_id, f.s AS severity, f.c AS code FROM f")
def _(t: Tables):
    return ops.status_findings(crawl_pages(t))


@query("crawl_health_scores", "D4", cte(c=PAGES_SQL, f=_FIND, k="SELECT site_id, f.s AS s, f.c AS c, count(DISTINCT page_id) AS hit FROM f GROUP BY ALL",
 n="SELECT site_id, sum(CASE WHEN s = 'Critical' AND r <= 3 THEN hit ELSE 0 END) AS ch, sum(CASE WHEN s = 'Warning' AND r <= 3 THEN hit ELSE 0 END) AS wh FROM (SELECT *, row_number() OVER (PARTITION BY site_id, s ORDER BY hit DESC, c) AS r FROM k) GROUP BY 1",
 p="SELECT site_id, count(*) AS pages, count(*) FILTER (WHERE request_error_kind IS NULL) AS usable, count(*) FILTER (WHERE request_error_kind IS NULL AND page_id % 40 = 0) AS part FROM c GROUP BY 1") + """
SELECT p.site_id, greatest(20, least(CASE WHEN usable = 0 THEN 50 WHEN part > 0 THEN 90 ELSE 100 END, 100 - least(80, ceil(coalesce(ch, 0) / pages / 3 * 60 + coalesce(wh, 0) / pages / 3 * 30))))::BIGINT AS health_score,
 (SELECT count(*) FROM f WHERE f.site_id = p.site_id AND f.f.s = 'Critical')::BIGINT AS critical_count FROM p LEFT JOIN n USING (site_id)""")
def _(t: Tables):
    p = crawl_pages(t)
    found = ops.status_findings(p).withColumn("message", F.col("code"))
    rows = p.withColumn("usable", F.col("request_error_kind").isNull()).withColumn("partial", F.col("page_id") % 40 == 0)
    return ops.health_score(rows, found).select("site_id", "health_score", "critical_count")


@query("page_audit_scores", "N5", cte(c=PAGES_SQL, f=_FIND) + "SELECT site_id, run_id, page_id, CASE WHEN http_status >= 400 THEN 0 ELSE greatest(0, 100 - coalesce((SELECT sum(CASE f.f.s WHEN 'Critical' THEN 15 WHEN 'Warning' THEN 5 ELSE 1 END) FROM f WHERE f.page_id = c.page_id), 0)) END::BIGINT AS score FROM c")
def _(t: Tables):
    p = crawl_pages(t)
    return ops.page_audit_score(p, ops.status_findings(p))


@query("duplicate_titles", "D6", "SELECT lower(trim(p_name)) AS text_key, count(*)::BIGINT AS pages, min(p_partkey) AS first_page FROM part WHERE trim(p_name) <> '' GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    return ops.duplicate_texts(t.part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit(" "), F.upper("p_name")).alias("title")), "title")


@query("directory_rollup", "D8", cte(c=PAGES_SQL, d="SELECT *, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS origin, list_filter(string_split(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '://[^/]+(.*)$', 1), '/'), lambda x: x <> '') AS seg FROM c",
 x="SELECT *, unnest(list_transform(range(0, greatest(len(seg) - 1, 0) + 1), lambda i: '/' || array_to_string(list_transform(seg[:i], lambda s: s || '/'), ''))) AS directory FROM d") + """
SELECT site_id, run_id, origin, directory, count(*)::BIGINT AS pages, count(*) FILTER (WHERE request_error_kind IS NOT NULL OR http_status <= 0)::BIGINT AS request_errors,
 count(*) FILTER (WHERE request_error_kind IS NULL AND http_status BETWEEN 200 AND 299)::BIGINT AS status_2xx, count(*) FILTER (WHERE request_error_kind IS NULL AND http_status BETWEEN 300 AND 399)::BIGINT AS status_3xx,
 count(*) FILTER (WHERE request_error_kind IS NULL AND http_status BETWEEN 400 AND 499)::BIGINT AS status_4xx, count(*) FILTER (WHERE request_error_kind IS NULL AND http_status BETWEEN 500 AND 599)::BIGINT AS status_5xx,
 sum(word_count)::BIGINT AS words, round(avg(response_time_ms), 6) AS avg_response_ms FROM x GROUP BY ALL""")
def _(t: Tables):
    return ops.directory_rollup(crawl_pages(t)).withColumn("avg_response_ms", F.round("avg_response_ms", 6))


@query("inbound_sources", "D14", cte(e=EDGES_SQL) + "SELECT site_id, target, count(DISTINCT source)::BIGINT AS inbound FROM e WHERE source <> target GROUP BY ALL")
def _(t: Tables):
    return ops.inbound_sources(supply_edges(t))


@query("orphan_pages", "K6", cte(e=EDGES_SQL) + """
SELECT 's' || (p_partkey % 7) AS site_id, 'n' || p_partkey AS node FROM part WHERE p_size <> 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.site_id = 's' || (p_partkey % 7) AND e.target = 'n' || p_partkey AND e.source <> e.target)""")
def _(t: Tables):
    node = F.concat(F.lit("n"), F.col("p_partkey")).alias("node")
    nodes = t.part.select(F.concat(F.lit("s"), F.col("p_partkey") % 7).alias("site_id"), node)
    return ops.orphan_pages(nodes, supply_edges(t), t.part.where("p_size = 1").select(node))


@query("resource_inventory", "D26", """
WITH r AS (SELECT o_custkey AS resource, o_orderkey % 300 AS s FROM orders), k AS (SELECT s_suppkey AS s FROM supplier),
d AS (SELECT DISTINCT resource, s FROM r WHERE resource % 7 <> 0 UNION SELECT DISTINCT resource, NULL FROM r WHERE resource % 7 = 0),
g AS (SELECT resource, count(d.s) AS sources, count(k.s) AS known FROM d LEFT JOIN k ON k.s = d.s GROUP BY 1)
SELECT resource, sources::BIGINT AS sources, known::BIGINT AS known_sources, CASE WHEN sources = 0 THEN 'unknown' WHEN known = sources THEN 'referenced' WHEN known > 0 THEN 'partial' ELSE 'orphaned' END AS state FROM g""")
def _(t: Tables):
    at = lambda c: F.concat(F.lit("https://r.example/"), c)
    listed = t.orders.groupBy(F.col("o_custkey").alias("resource")).agg(F.collect_set(at(F.col("o_orderkey") % 300)).alias("u"))
    res = listed.select("resource", F.when(F.col("resource") % 7 != 0, F.col("u")).otherwise(F.array().cast("array<string>")).alias("source_urls"))
    return ops.resource_inventory(res, t.supplier.select(at(F.col("s_suppkey")).alias("url")))


_READY = """SELECT *, CASE WHEN page_id % 6 = 0 THEN '' ELSE 't' END AS title, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'd' END AS description, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'en' END AS language FROM c"""
_READY2 = """SELECT site_id, 'http-response' AS "check", count(*) FILTER (WHERE request_error_kind IS NOT NULL OR http_status = 0 OR http_status >= 400) AS errors, count(*) FILTER (WHERE http_status BETWEEN 300 AND 399) AS warnings, count(*) AS pages FROM a GROUP BY 1
UNION ALL SELECT site_id, 'metadata', count(*) FILTER (WHERE title = ''), count(*) FILTER (WHERE title <> '' AND (description IS NULL OR canonical IS NULL)), count(*) FROM a GROUP BY 1
UNION ALL SELECT site_id, 'content', count(*) FILTER (WHERE word_count <= 0), 0, count(*) FROM a GROUP BY 1
UNION ALL SELECT site_id, 'language', 0, count(*) FILTER (WHERE language IS NULL), count(*) FROM a GROUP BY 1"""


def _ready(t: Tables):
    i = F.col("page_id")
    rows = crawl_pages(t).withColumns({"title": F.when(i % 6 == 0, "").otherwise("t"), "description": F.when(i % 4 != 0, "d"), "language": F.when(i % 3 != 0, "en")})
    return ops.readiness_checks(rows.drop("run_id"))


@query("readiness_checks", "D43", cte(c=PAGES_SQL, a=_READY, r=_READY2) + "SELECT site_id, pages::BIGINT AS pages, \"check\", errors::BIGINT AS errors, warnings::BIGINT AS warnings, CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'pass' END AS state FROM r")
def _(t: Tables):
    return _ready(t)


@query("readiness_scores", "D43", cte(c=PAGES_SQL, a=_READY, r=_READY2) + "SELECT site_id, floor(avg(CASE WHEN errors > 0 THEN 0 WHEN warnings > 0 THEN 50 ELSE 100 END) + 0.5)::BIGINT AS score, count(*)::BIGINT AS known_checks FROM r GROUP BY 1")
def _(t: Tables):
    return ops.readiness_score(_ready(t))


@query("redirect_chains", "P15", """
WITH h AS (SELECT o_orderkey, list_transform(range(0, o_orderkey % 14 + 1), lambda i: CASE WHEN o_orderkey % 5 = 0 AND i = 3 THEN 'u0' ELSE 'u' || i END) AS hops FROM orders)
SELECT o_orderkey, (len(hops) - 1)::INTEGER AS redirects, hops[-1] AS final_url, CASE WHEN len(list_distinct(hops)) < len(hops) THEN 'loop' WHEN len(hops) > 10 THEN 'limit' WHEN len(hops) > 1 THEN 'redirected' ELSE 'direct' END AS reason FROM h""")
def _(t: Tables):
    k = F.col("o_orderkey")
    hops = F.transform(F.sequence(F.lit(0), (k % 14).cast("int")), lambda i: F.when((k % 5 == 0) & (i == 3), F.lit("u0")).otherwise(F.concat(F.lit("u"), i)))
    return ops.redirect_chains(t.orders.select("o_orderkey", hops.alias("hops")))


@query("security_header_findings", "P12", """
SELECT page_id, unnest(list_filter([CASE WHEN page_id % 2 = 0 THEN 'hsts-missing' WHEN page_id % 5 = 0 THEN 'hsts-short' END, CASE WHEN page_id % 3 <> 0 THEN 'frame-protection-missing' END, 'nosniff-missing',
 CASE WHEN page_id % 3 <> 0 THEN 'csp-missing' WHEN page_id % 9 = 0 THEN 'csp-unsafe' END, CASE WHEN page_id % 7 <> 0 THEN 'referrer-policy-missing' END, 'permissions-policy-missing'], lambda x: x IS NOT NULL)) AS code FROM pages""")
def _(t: Tables):
    i = F.col("page_id")
    headers = F.map_filter(F.create_map(
        F.lit("strict-transport-security"), F.when(i % 2 != 0, F.when(i % 5 == 0, "max-age=100").otherwise("max-age=31536000; preload")),
        F.lit("content-security-policy"), F.when(i % 3 == 0, F.when(i % 9 == 0, "frame-ancestors 'self'; script-src 'unsafe-inline'").otherwise("frame-ancestors 'self'")),
        F.lit("referrer-policy"), F.when(i % 7 == 0, "no-referrer"),
    ), lambda k, v: v.isNotNull())
    return ops.security_findings(t.pages.withColumn("headers", headers).select("page_id", "headers"))


@query("cookie_findings", "P13", """
SELECT event_id AS page_id, 'sid' AS name, unnest(list_filter([CASE WHEN event_id % 3 <> 0 THEN 'secure-missing' END, CASE WHEN event_id % 2 <> 0 THEN 'httponly-missing' END, CASE WHEN event_id % 5 <> 0 THEN 'samesite-missing' END, CASE WHEN event_id % 5 = 0 AND event_id % 3 <> 0 THEN 'samesite-none-insecure' END], lambda x: x IS NOT NULL)) AS code FROM events""")
def _(t: Tables):
    i = F.col("event_id")
    cookie = F.concat(F.lit("sid="), i, F.when(i % 3 == 0, "; Secure").otherwise(""), F.when(i % 2 == 0, "; HttpOnly").otherwise(""), F.when(i % 5 == 0, "; SameSite=None").otherwise(""))
    return ops.cookie_findings(t.events.select(i.alias("page_id"), F.array(cookie).alias("set_cookie")))


@query("mixed_content", "P13", cte(l=LINKS_SQL) + "SELECT page_id, 'http://cdn.example' || href AS target, CASE WHEN pos % 2 = 0 THEN 'mixed-active' ELSE 'mixed-passive' END AS code FROM l WHERE source LIKE 'https://%' AND pos % 3 <> 0")
def _(t: Tables):
    pos = F.col("pos")
    res = page_links(t).select("page_id", F.col("source").alias("page"), F.when(pos % 2 == 0, "script").otherwise("img").alias("kind"), F.concat(F.when(pos % 3 == 0, "https").otherwise("http"), F.lit("://cdn.example"), F.col("href")).alias("target"))
    return ops.mixed_content(res).select("page_id", "target", "code")


def _checks(t: Tables):
    p = crawl_pages(t).drop("site_id", "run_id")
    return ops.page_checks(p, {
        "status-ok": F.col("http_status").between(200, 299), "fast": F.when(F.col("http_status") > 0, F.col("response_time_ms") < 1000),
        "https": F.col("url").startswith("https://"), "robots-open": ~F.lower("meta_robots").contains("noindex"),
    })


_CHECKS = """SELECT page_id, unnest([{'c': 'status-ok', 'v': http_status BETWEEN 200 AND 299}, {'c': 'fast', 'v': CASE WHEN http_status > 0 THEN response_time_ms < 1000 END}, {'c': 'https', 'v': url LIKE 'https://%'}, {'c': 'robots-open', 'v': NOT contains(lower(meta_robots), 'noindex')}]) AS k FROM c"""


@query("page_checks", "P24", cte(c=PAGES_SQL, k=_CHECKS) + "SELECT page_id, k.c AS \"check\", CASE WHEN k.v IS NULL THEN 'unknown' WHEN k.v THEN 'pass' ELSE 'fail' END AS state FROM k")
def _(t: Tables):
    return _checks(t)


@query("page_check_rollup", "P24", cte(c=PAGES_SQL, k=_CHECKS) + "SELECT k.c AS \"check\", count(*) FILTER (WHERE k.v)::BIGINT AS pass, count(*) FILTER (WHERE NOT k.v)::BIGINT AS fail, count(*) FILTER (WHERE k.v IS NULL)::BIGINT AS unknown FROM k GROUP BY 1")
def _(t: Tables):
    return ops.check_rollup(_checks(t))


@query("topic_assignments", "C36", """
WITH a AS (SELECT c_custkey AS topic, CASE c_custkey % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'planned' ELSE 'needs-update' END AS lifecycle, DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS planned FROM customer),
u AS (SELECT DISTINCT o_custkey AS topic, o_orderkey % 250 AS s FROM orders),
g AS (SELECT a.topic, lifecycle, planned, count(k.s_suppkey) AS mapped, count(u.s) FILTER (WHERE k.s_suppkey IS NULL) AS stale, count(*) FILTER (WHERE k.s_suppkey % 4 = 0) AS unhealthy FROM a LEFT JOIN u USING (topic) LEFT JOIN supplier k ON k.s_suppkey = u.s GROUP BY ALL)
SELECT topic, mapped::BIGINT AS mapped, stale::BIGINT AS stale, array_to_string(list_filter([CASE WHEN mapped = 0 THEN 'unmapped-topic' END, CASE WHEN stale > 0 THEN 'stale-url-assignment' END, CASE WHEN lifecycle = 'published' AND unhealthy > 0 THEN 'topic-url-unhealthy' END,
 CASE WHEN lifecycle = 'needs-update' THEN 'needs-update' END, CASE WHEN planned < DATE '2024-01-10' AND lifecycle = 'planned' THEN 'overdue' END], lambda x: x IS NOT NULL), ',') AS codes FROM g""")
def _(t: Tables):
    at = lambda c: F.concat(F.lit("https://x.example/n"), c)
    k = F.col("c_custkey")
    used = t.orders.groupBy(F.col("o_custkey").alias("topic")).agg(F.collect_set(at(F.col("o_orderkey") % 250)).alias("urls"))
    topics = t.customer.select(k.alias("topic"), F.when(k % 3 == 0, "published").when(k % 3 == 1, "planned").otherwise("needs-update").alias("lifecycle"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int")).alias("planned"))
    pages = _alternates(t)[0]
    return ops.topic_assignments(topics.join(used, "topic", "left"), pages, "2024-01-10").select("topic", "mapped", "stale", F.array_join("codes", ",").alias("codes"))


def _with_json_ld(t: Tables):
    """The given pages with a script written into each from its number: whole, a graph, malformed, and a list."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('{"@type":"Product","name":"P'), n, F.lit('","offers":{"@type":"Offer","price":'), n, F.lit("}}")))
        .when(k % 4 == 1, F.concat(F.lit('{"@graph":[{"@type":["Article","https://schema.org/NewsArticle"],"@id":"#a'), n, F.lit('","author":{"@id":"/team#x"}},{"@type":"Organization","@id":"/team#x"}]}')))
        .when(k % 4 == 2, '{"@type": "Event",').otherwise('[{"@type":"FAQPage","mainEntity":[{"@type":"Question"},{"@type":"Question","name":"q"}]},{"@type":"Product","name":" "}]')
    )
    script = F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    return html.with_nodes(t.pages.select("page_id", F.concat(F.lit("https://p.example/"), n).alias("url"), F.concat(script, "html").alias("html")))


@query("json_ld_facts", "P10", """
SELECT page_id, path, property, value FROM pages, LATERAL (SELECT * FROM (VALUES
 (0, '$', '@type', 'Product'), (0, '$', 'name', 'P' || page_id), (0, '$', 'offers', NULL), (0, '$.offers', '@type', 'Offer'), (0, '$.offers', 'price', '' || page_id),
 (1, '$', '@graph', '#a' || page_id), (1, '$', '@graph', '/team#x'), (1, '$.@graph[0]', '@type', 'Article'), (1, '$.@graph[0]', '@type', 'https://schema.org/NewsArticle'), (1, '$.@graph[0]', '@id', '#a' || page_id),
 (1, '$.@graph[0]', 'author', '/team#x'), (1, '$.@graph[1]', '@type', 'Organization'), (1, '$.@graph[1]', '@id', '/team#x'), (1, '$.@graph[0].author', '@id', '/team#x'),
 (3, '$[0]', '@type', 'FAQPage'), (3, '$[0]', 'mainEntity', NULL), (3, '$[0]', 'mainEntity', NULL), (3, '$[1]', '@type', 'Product'), (3, '$[1]', 'name', ' '),
 (3, '$[0].mainEntity[0]', '@type', 'Question'), (3, '$[0].mainEntity[1]', '@type', 'Question'), (3, '$[0].mainEntity[1]', 'name', 'q')) v(k, path, property, value) WHERE k = page_id % 4)""")
def _(t: Tables):
    return jsonld.json_ld(_with_json_ld(t)).select("page_id", "path", "property", "value")


@query("profile_findings", "P11", """
SELECT page_id, path, code, severity FROM pages JOIN (VALUES
 (1, '$.@graph[0]', 'article-headline-recommended', 'info'), (1, '$.@graph[1]', 'schema-name-missing', 'warning'), (3, '$[0].mainEntity[0]', 'question-name-missing', 'warning'),
 (3, '$[1]', 'product-name-missing', 'warning'), (3, '$[1]', 'product-offer-review-missing', 'warning')) v(k, path, code, severity) ON k = page_id % 4""")
def _(t: Tables):
    return ops.profile_findings(jsonld.json_ld(_with_json_ld(t))).select("page_id", "path", "code", "severity")


@query("page_entities", "P10 D29 K14", """
SELECT 'https://p.example/' || page_id AS page, 'https://p.example/team#x' AS id, 2::BIGINT AS nodes, 'organization' AS types FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT 'https://p.example/' || page_id, 'https://p.example/' || page_id || '#a' || page_id, 1, 'article,https://schema.org/newsarticle' FROM pages WHERE page_id % 4 = 1""")
def _(t: Tables):
    nodes = ops.entity_nodes(jsonld.json_ld(_with_json_ld(t))).where("id IS NOT NULL")
    return nodes.groupBy("page", "id").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ",").alias("types"))
