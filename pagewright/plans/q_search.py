"""Search-performance and traffic analytics over order lines as query x page facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import search as ops
from pagewright.plans.inputs import SEARCH_SQL, cte, search_rows
from pagewright.plans.registry import Tables, query

_Q = "SELECT query, sum(clicks) AS clicks, sum(impressions) AS impressions, floor(sum(position * impressions) / sum(impressions) * 100 + 0.5) / 100 AS position FROM f GROUP BY 1"
_QP = "SELECT query, page, sum(clicks) AS clicks, sum(impressions) AS impressions, floor(sum(position * impressions) / sum(impressions) * 100 + 0.5) / 100 AS position FROM f GROUP BY 1, 2"
_F = dict(f=SEARCH_SQL)


def _queries(t: Tables):
    return ops.merge_url_rows(search_rows(t), ["query"])


def _query_pages(t: Tables):
    return ops.merge_url_rows(search_rows(t), ["query", "page"])


@query("merged_url_rows", "D10 A5", cte(**_F) + "SELECT page, sum(clicks) AS clicks, sum(impressions) AS impressions, round(sum(clicks) / sum(impressions), 6) AS ctr, floor(sum(position * impressions) / sum(impressions) * 100 + 0.5) / 100 AS position FROM f GROUP BY 1")
def _(t: Tables):
    return ops.merge_url_rows(search_rows(t), ["page"]).withColumn("ctr", F.round("ctr", 6))


@query("near_top_ten_queries", "B9", cte(**_F, q=_QP) + "SELECT query, page, clicks, impressions, position FROM q WHERE position > 10 AND position <= 20 AND impressions >= 100 AND clicks <= impressions AND position > 0")
def _(t: Tables):
    return ops.near_top_ten(_query_pages(t)).drop("ctr")


@query("striking_distance_queries", "B10", cte(**_F, q=_QP) + "SELECT query, page, clicks, impressions, position FROM q WHERE position BETWEEN 4 AND 20 AND impressions >= 150")
def _(t: Tables):
    return ops.striking_distance(_query_pages(t), 150).drop("ctr")


_FLT = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN '' WHEN 2 THEN 'image' END AS search_type, CASE WHEN o_custkey % 3 = 0 THEN 'MOBILE' END AS device, CASE o_custkey % 4 WHEN 0 THEN ' POL ' WHEN 1 THEN 'pol' WHEN 2 THEN ' ' END AS country FROM orders"""


@query("report_filter_equality", "B8", cte(a=_FLT) + """
SELECT o_orderkey, (coalesce(search_type, '') = 'web') AND device IS NULL AND coalesce(trim(country), '') IN ('pol', 'POL') AS same,
 coalesce(search_type, '') IN ('', 'web') AND device IS NULL AND coalesce(trim(country), '') = '' AS full_scope FROM a""")
def _(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    left = {
        "search_type": F.when(k % 4 == 0, "web").when(k % 4 == 1, "").when(k % 4 == 2, "image"), "device": F.when(c % 3 == 0, "MOBILE"),
        "country": F.when(c % 4 == 0, " POL ").when(c % 4 == 1, "pol").when(c % 4 == 2, " "),
    }
    right = {"search_type": F.lit("web"), "device": F.lit(""), "country": F.lit("Pol")}
    return t.orders.select("o_orderkey", ops.same_filters(left, right).alias("same"), ops.is_full_scope(**left).alias("full_scope"))


_PER = """SELECT query, page, CASE WHEN date < DATE '1997-01-01' THEN 'a' ELSE 'b' END AS period, sum(clicks) AS clicks, sum(impressions) AS impressions FROM f GROUP BY ALL"""


def _periods(t: Tables, keys):
    rows = search_rows(t).withColumn("period", F.when(F.col("date") < F.lit("1997-01-01").cast("date"), "a").otherwise("b"))
    sums = rows.groupBy(*keys, "period").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return sums.where("period = 'a'"), sums.where("period = 'b'")


@query("period_comparison", "C12", cte(**_F, p=_PER) + """
SELECT b.query, b.page, a.clicks AS base_clicks, b.clicks AS now_clicks, b.clicks - a.clicks AS clicks_delta, round(CASE WHEN a.clicks > 0 THEN (b.clicks - a.clicks) * 100 / a.clicks END, 6) AS clicks_pct,
 b.impressions - a.impressions AS impressions_delta, round((b.impressions - a.impressions) * 100 / a.impressions, 6) AS impressions_pct,
 a.impressions >= 100 AND (coalesce(CASE WHEN a.clicks > 0 THEN (b.clicks - a.clicks) * 100 / a.clicks END <= -20, false) OR (b.impressions - a.impressions) * 100 / a.impressions <= -20) AS potential_decline
FROM p a JOIN p b ON a.query = b.query AND a.page = b.page AND a.period = 'a' AND b.period = 'b'""")
def _(t: Tables):
    rows = ops.compare_periods(*_periods(t, ["query", "page"]), ["query", "page"])
    return rows.withColumn("clicks_pct", F.round("clicks_pct", 6)).withColumn("impressions_pct", F.round("impressions_pct", 6))


@query("search_decline_alert", "O6", cte(**_F, p=_PER) + """
SELECT count(*)::BIGINT AS declining FROM p a JOIN p b ON a.query = b.query AND a.page = b.page AND a.period = 'a' AND b.period = 'b'
WHERE a.impressions >= 100 AND (coalesce(CASE WHEN a.clicks > 0 THEN (b.clicks - a.clicks) * 100 / a.clicks END <= -20, false) OR (b.impressions - a.impressions) * 100 / a.impressions <= -20)""")
def _(t: Tables):
    return ops.compare_periods(*_periods(t, ["query", "page"]), ["query", "page"]).agg(F.count_if("potential_decline").alias("declining"))


@query("unmatched_period_keys", "G1", cte(**_F, p=_PER) + "SELECT query, page FROM p WHERE period = 'b' AND (query, page) NOT IN (SELECT (query, page) FROM p WHERE period = 'a')")
def _(t: Tables):
    a, b = _periods(t, ["query", "page"])
    return ops.unmatched_keys(b, a, ["query", "page"])


@query("period_comparability", "C12", """
WITH s AS (SELECT o_orderkey AS id, o_custkey % 2 AS site, CAST(o_orderdate AS DATE) AS d, 28 - CASE WHEN o_orderkey % 9 = 0 THEN 3 ELSE 0 END AS n FROM orders),
p AS (SELECT a.id AS a_id, b.id AS b_id, a.site <> b.site AS ds, a.d + a.n - 1 AS ae, b.d AS bs, a.n AS an, b.n AS bn FROM s a JOIN s b ON b.id = a.id + 1)
SELECT a_id, b_id, CASE WHEN ds THEN 'different-property' WHEN ae >= bs THEN 'overlapping' WHEN an <> bn THEN 'different-durations' END AS reason FROM p""")
def _(t: Tables):
    def side(p, shift):
        start = F.to_date("o_orderdate")
        days = F.when(F.col("o_orderkey") % 9 == 0, 24).otherwise(27)
        return t.orders.select(
            (F.col("o_orderkey") + shift).alias("j"), F.col("o_orderkey").alias(f"{p}_id"), (F.col("o_custkey") % 2).alias(f"{p}_site"), start.alias(f"{p}_start"),
            F.date_add(start, days).alias(f"{p}_end"), *[F.lit("").alias(f"{p}_{n}") for n in ("search_type", "device", "country")],
        )

    return ops.comparable_periods(side("a", 1).join(side("b", 0), "j")).select("a_id", "b_id", "reason")


@query("impression_shares", "E2", cte(**_F, q=_QP) + "SELECT query, page, impressions, round(impressions * 100 / sum(impressions) OVER (PARTITION BY query), 6) AS share FROM q")
def _(t: Tables):
    return ops.impression_share(_query_pages(t)).select("query", "page", "impressions", F.round("share", 6).alias("share"))


@query("query_cannibalization", "D9", cte(**_F, q=_QP, s="SELECT *, impressions * 100 / sum(impressions) OVER (PARTITION BY query) AS share FROM q", k="SELECT * FROM s WHERE impressions >= 20 AND share >= 3") +
"SELECT query, page, impressions, round(share, 6) AS share, count(*) OVER (PARTITION BY query)::BIGINT AS pages FROM k QUALIFY count(*) OVER (PARTITION BY query) >= 2")
def _(t: Tables):
    return ops.query_cannibalization(_query_pages(t), min_share=3).select("query", "page", "impressions", F.round("share", 6).alias("share"), "pages")


@query("ctr_outliers", "E3", cte(**_F, q=_QP, v="SELECT * FROM q WHERE clicks <= impressions AND position > 0 AND impressions > 0",
 w="SELECT *, sum(impressions) OVER a AS ai, sum(clicks) OVER a AS ac, count(*) OVER a AS an, sum(impressions) OVER o AS oi, sum(clicks) OVER o AS oc, count(*) OVER o AS n FROM v WINDOW a AS (ORDER BY position RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), o AS (PARTITION BY query ORDER BY position RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)") + """
SELECT query, page, (an - n)::BIGINT AS peer_count, ai - oi AS peer_impressions, round((ac - oc) * 100 / (ai - oi), 6) AS peer_ctr, round(impressions * ((ac - oc) * 100 / (ai - oi) - clicks * 100 / impressions) / 100, 6) AS expected_click_gap
FROM w WHERE impressions >= 100 AND an - n >= 3 AND ai - oi >= 300 AND ac > oc AND clicks * 100 / impressions < (ac - oc) * 100 / (ai - oi) * 0.5""")
def _(t: Tables):
    rows = ops.ctr_outliers(_query_pages(t))
    return rows.select("query", "page", "peer_count", "peer_impressions", F.round("peer_ctr", 6).alias("peer_ctr"), F.round("expected_click_gap", 6).alias("expected_click_gap"))


@query("ranked_results_dedupe", "E4 A8", """
WITH r AS (SELECT l_orderkey % 3000 AS list, 'r.example/' || (l_partkey % 40) AS url_key, l_linenumber + l_suppkey AS rank FROM lineitem), b AS (SELECT list, url_key, min(rank) AS rank FROM r GROUP BY 1, 2)
SELECT list, url_key, rank, row_number() OVER (PARTITION BY list ORDER BY rank, url_key)::BIGINT AS position FROM b""")
def _(t: Tables):
    url = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "https://www.r.example/").otherwise("http://r.example/"), F.col("l_partkey") % 40, F.when(F.col("l_linenumber") % 3 == 0, "/?utm_source=x").otherwise(""))
    rows = t.lineitem.select((F.col("l_orderkey") % 3000).alias("list"), url.alias("url"), (F.col("l_linenumber") + F.col("l_suppkey")).alias("rank"))
    return ops.dedupe_ranked(rows).select("list", "url_key", "rank", "position")


_CAP = """SELECT 's' || (l_suppkey % 5) AS series, CAST(l_shipdate AS DATE) AS date, CAST(l_shipdate AS DATE) + l_linenumber AS captured_at, l_orderkey * 10 + l_linenumber AS snapshot_id, l_quantity AS clicks FROM lineitem"""


def _captures(t: Tables):
    return t.lineitem.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("series"), F.to_date("l_shipdate").alias("date"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("captured_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("snapshot_id"), F.col("l_quantity").alias("clicks"),
    )


@query("daily_series_newest", "E5 E6", cte(c=_CAP) + "SELECT series, date, max(snapshot_id) AS snapshot_id FROM (SELECT *, max(captured_at) OVER (PARTITION BY series, date) AS m FROM c) WHERE captured_at = m GROUP BY 1, 2")
def _(t: Tables):
    return ops.daily_series(_captures(t), ["series"]).select("series", "date", "snapshot_id")


@query("daily_series_gaps", "E5", cte(c=_CAP) + "SELECT s.series, d::DATE AS date FROM (SELECT DISTINCT series FROM c) s, generate_series(DATE '1992-01-01', DATE '1999-12-31', INTERVAL 1 DAY) g(d) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.series = s.series AND c.date = d::DATE)")
def _(t: Tables):
    return ops.missing_dates(_captures(t), "1992-01-01", "1999-12-31", ["series"])


@query("surface_forms", "E14", """
WITH w AS (SELECT unnest(regexp_extract_all(text, '([\\p{L}\\p{N}]+)', 1)) AS form FROM documents), c AS (SELECT lower(form) AS key, form, count(*) AS n FROM w GROUP BY ALL)
SELECT key, arg_min(form, (-n, length(form), form)) AS form, sum(n)::BIGINT AS uses FROM c GROUP BY 1""")
def _(t: Tables):
    w = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("form"))
    return ops.surface_forms(w.select(F.lower("form").alias("key"), "form"))


@query("imported_queries", "G12", """
WITH e AS (SELECT p_name AS text, p_size % 4 AS scope, p_partkey AS ts FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_name AS text, p_size % 5 AS scope, (p_partkey * 7) % 1500 AS ts FROM part WHERE p_partkey % 2 = 1),
u AS (SELECT lower(text) AS key, scope, ts, 0 AS n FROM e UNION ALL SELECT lower(text), scope, ts, 1 FROM i),
g AS (SELECT key, scope, max(ts * 2 + n) AS best, count(*) FILTER (WHERE n = 0) AS o, count(*) FILTER (WHERE n = 1) AS w FROM u GROUP BY 1, 2)
SELECT key, scope, (best // 2)::BIGINT AS retrieved_at, CASE WHEN w = 0 THEN 'kept' WHEN o = 0 THEN 'added' WHEN best % 2 = 1 THEN 'updated' ELSE 'duplicate' END AS outcome, (w - CASE WHEN o = 0 THEN 1 ELSE 0 END)::BIGINT AS repeats FROM g""")
def _(t: Tables):
    k = F.col("p_partkey")
    old = t.part.where(k % 2 == 0).select(F.upper("p_name").alias("text"), (F.col("p_size") % 4).alias("scope"), k.alias("retrieved_at"))
    new = t.part.where(k % 2 == 1).select(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("text"), (F.col("p_size") % 5).alias("scope"), (k * 7 % 1500).alias("retrieved_at"))
    return ops.import_queries(old, new).drop("text")


@query("group_query_conflicts", "C28", cte(**_F, m="SELECT s % 12 AS g, 'https://shop.example/p/' || (s % 12) AS canonical, 'https://shop.example/p/' || s AS page FROM generate_series(0, 59) x(s)",
 a="SELECT g, canonical, query, page, sum(clicks) AS c, sum(impressions) AS i FROM f JOIN m USING (page) GROUP BY ALL", k="SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY g, query) > 1",
 t="SELECT g, canonical, page, sum(c) AS c, sum(i) AS i FROM k GROUP BY ALL") + "SELECT g AS \"group\", canonical, arg_min(page, (-c, -i, page)) AS leader, arg_min(page, (-c, -i, page)) <> canonical AS conflict FROM t GROUP BY 1, 2")
def _(t: Tables):
    s = F.col("s_suppkey")
    at = lambda c: F.concat(F.lit("https://shop.example/p/"), c)
    members = t.supplier.select((s % 60).alias("s")).distinct().select((F.col("s") % 12).alias("group"), at(F.col("s") % 12).alias("canonical"), F.concat(at(F.col("s")), F.lit("/")).alias("url"))
    return ops.group_click_leaders(ops.group_query_evidence(members, search_rows(t)))


@query("property_matches", "C24", """
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/]+)', 1)) AS host, regexp_extract(url, '^([a-z]+)', 1) AS scheme, rtrim(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '://[^/]+(.*)$', 1), '/') || '/' AS path FROM pages),
c AS (SELECT url, unnest(list_filter([CASE WHEN host LIKE '%.example.com' THEN {'s': 511, 'p': 'sc-domain:example.com'} END, CASE WHEN host LIKE '%.example.net' THEN {'s': 511, 'p': 'sc-domain:Example.net'} END,
  CASE WHEN scheme = 'https' AND host LIKE 'blog.%' AND path LIKE '/en/%' THEN {'s': CASE WHEN path = '/en/' THEN 1000 ELSE 604 END, 'p': 'https://' || host || '/en'} END], lambda x: x IS NOT NULL)) AS m FROM u)
SELECT url, max(m).p AS property, max(m).s::BIGINT AS score FROM c GROUP BY 1""")
def _(t: Tables):
    h = urls.host(F.col("url"))
    props = t.pages.select(F.when(h.startswith("blog."), F.concat(F.lit("https://"), h, F.lit("/en"))).when(h.endswith(".com"), "sc-domain:example.com").when(h.endswith(".net"), "sc-domain:Example.net").alias("property")).where("property IS NOT NULL").distinct()
    extra = t.region.select(F.when(F.col("r_regionkey") % 2 == 0, "sc-domain:example.com").otherwise("sc-domain:Example.net").alias("property")).distinct()
    return ops.property_match(t.pages.select("url"), props.union(extra).distinct())


@query("interventions_asof", "C23", """
WITH s AS (SELECT o_orderkey AS id, o_custkey % 40 AS site, CAST(o_orderdate AS DATE) AS st, CAST(o_orderdate AS DATE) + CAST(6 + o_orderkey % 2 AS INTEGER) AS en, o_totalprice AS cap, round(o_totalprice / 1000) AS clicks FROM orders),
i AS (SELECT c_custkey AS id, c_custkey % 40 AS site, DATE '1993-01-01' + CAST(c_custkey * 13 % 2300 AS INTEGER) AS d FROM customer),
b AS (SELECT i.id, i.site, i.d, (SELECT {'id': s.id, 'st': s.st, 'en': s.en, 'c': s.clicks} FROM s WHERE s.site = i.site AND s.en < i.d ORDER BY s.en DESC, s.id DESC LIMIT 1) AS x, (SELECT {'id': s.id, 'st': s.st, 'en': s.en, 'c': s.clicks} FROM s WHERE s.site = i.site AND s.st >= i.d ORDER BY s.st, s.id DESC LIMIT 1) AS y FROM i)
SELECT id, site, d AS date, x.id AS before_id, y.id AS after_id, CASE WHEN x IS NULL THEN 'no-baseline' WHEN y IS NULL THEN 'no-follow-up' WHEN abs((x.en - x.st) - (y.en - y.st)) / least(x.en - x.st + 1, y.en - y.st + 1) > 0.1 THEN 'period-length-mismatch' WHEN x.c < 30 THEN 'low-volume' END AS reason,
 round(CASE WHEN x.c > 0 THEN (y.c - x.c) / x.c END, 6) AS clicks_change FROM b""")
def _(t: Tables):
    start = F.to_date("o_orderdate")
    snaps = t.orders.select(
        F.col("o_orderkey").alias("snapshot_id"), (F.col("o_custkey") % 40).alias("site"), start.alias("start_date"), F.date_add(start, (6 + F.col("o_orderkey") % 2).cast("int")).alias("end_date"),
        F.timestamp_seconds(F.lit(0)).alias("captured_at"), F.round(F.col("o_totalprice") / 1000).alias("clicks"), F.lit(1.0).alias("impressions"),
    )
    c = F.col("c_custkey")
    changes = t.customer.select(c.alias("id"), (c % 40).alias("site"), F.date_add(F.lit("1993-01-01").cast("date"), (c * 13 % 2300).cast("int")).alias("date"))
    return ops.interventions_asof(changes, snaps).withColumn("clicks_change", F.round("clicks_change", 6))


@query("rest_of_site_metrics", "D11", cte(**_F, p="SELECT 'q' AS k, page, sum(clicks) AS c, sum(impressions) AS i, floor(sum(position * impressions) / sum(impressions) * 100 + 0.5) / 100 AS pos FROM f GROUP BY 2", s="SELECT sum(clicks) AS c, sum(impressions) AS i, floor(sum(position * impressions) / sum(impressions) * 100 + 0.5) / 100 AS pos FROM f") +
"SELECT page, s.c - p.c AS clicks, s.i - p.i AS impressions, round((s.pos * s.i - p.pos * p.i) / (s.i - p.i), 4) AS position FROM p, s")
def _(t: Tables):
    rows = search_rows(t)
    page = ops.merge_url_rows(rows, ["page"])
    site = ops.merge_url_rows(rows.withColumn("site", F.lit("s")), ["site"])
    each = page.select("page", F.lit("s").alias("site")).join(site, "site")
    return ops.rest_of_site(each, page, ["page"]).withColumn("position", F.round("position", 4))


_GA = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'other.example' ELSE 'shop.example' END AS host_name, '/p/' || (s_suppkey % 80) AS landing_page, CAST(s_suppkey * 3 AS DOUBLE) AS sessions, CASE WHEN s_suppkey % 7 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS start_date FROM supplier"


def _landing(t: Tables):
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("k"), F.when(k % 5 == 0, "other.example").otherwise("Shop.example.").alias("host_name"), F.concat(F.lit("/p/"), k % 80, F.when(k % 2 == 0, "/").otherwise("")).alias("landing_page"),
        (k * 3).cast("double").alias("sessions"), F.when(k % 7 == 0, F.lit("2024-02-01")).otherwise("2024-01-01").cast("date").alias("start_date"), F.lit("2024-01-31").cast("date").alias("end_date"),
    )


@query("traffic_evidence_join", "C1 A6", cte(**_F, g=_GA, p="SELECT page, sum(clicks) AS clicks FROM f GROUP BY 1", i="SELECT 'https://shop.example/p/' || p_partkey AS url, p_size AS n FROM part") +
"SELECT g.k, CASE WHEN host_name = 'shop.example' AND start_date = DATE '2024-01-01' THEN p.clicks END AS search_clicks, CASE WHEN host_name = 'shop.example' THEN i.n END AS crawl_issue_count FROM g LEFT JOIN p ON p.page = 'https://shop.example' || landing_page LEFT JOIN i ON i.url = 'https://shop.example' || landing_page")
def _(t: Tables):
    facts = ops.merge_url_rows(search_rows(t), ["page"]).withColumn("start_date", F.lit("2024-01-01").cast("date")).withColumn("end_date", F.lit("2024-01-31").cast("date"))
    issues = t.part.select(F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey")).alias("url"), F.col("p_size").alias("issues_count"))
    rows = ops.join_traffic_evidence(_landing(t), facts, issues, "https://shop.example/")
    return rows.select("k", F.col("search.clicks").alias("search_clicks"), "crawl_issue_count")


@query("url_telemetry", "C2 A7 D13", cte(**_F, g=_GA, p="SELECT page AS u, sum(clicks) AS clicks FROM f GROUP BY 1", s="SELECT 'https://shop.example' || landing_page AS u, sum(sessions) AS sessions FROM g WHERE host_name = 'shop.example' GROUP BY 1",
 b="SELECT 'https://shop.example/p/' || (l_partkey % 150) AS u, count(DISTINCT l_suppkey % 30) AS domains FROM lineitem GROUP BY 1", c="SELECT 'https://shop.example/p/' || p_partkey AS u FROM part",
 k="SELECT u FROM c UNION SELECT u FROM p UNION SELECT u FROM s UNION SELECT u FROM b") + """
SELECT u AS url_key, coalesce(clicks, 0) AS search_clicks, 'measured' AS search_state, sessions AS analytics_sessions, CASE WHEN sessions IS NULL THEN 'missing' ELSE 'sampled' END AS analytics_state, CAST(domains AS DOUBLE) AS backlinks_domains, CASE WHEN domains IS NULL THEN 'missing' ELSE 'sampled' END AS backlinks_state
FROM k LEFT JOIN p USING (u) LEFT JOIN s USING (u) LEFT JOIN b USING (u)""")
def _(t: Tables):
    from pagewright.operators import backlinks

    key = lambda c: urls.url_key(c, "identity").alias("url_key")
    at = lambda c: F.concat(F.lit("https://www.shop.example/p/"), c)
    facts = ops.merge_url_rows(search_rows(t).select(key(F.col("page")), "clicks", "impressions", "position"), ["url_key"])
    visits = _landing(t).where("host_name = 'Shop.example.'").groupBy(key(F.concat(F.lit("https://shop.example"), "landing_page"))).agg(F.sum("sessions").alias("sessions"))
    links = t.lineitem.select(F.concat(F.lit("https://d"), F.col("l_suppkey") % 30, F.lit(".example/x")).alias("source_url"), at(F.col("l_partkey") % 150).alias("target_url"))
    domains = backlinks.referring_domains(links)
    return ops.url_telemetry(
        t.part.select(key(at(F.col("p_partkey")))),
        {"search": (facts, ["clicks"], True), "analytics": (visits, ["sessions"], False), "backlinks": (domains, ["domains"], False)},
    )


@query("node_traffic_states", "C3", cte(**_F, p="SELECT page AS u, sum(clicks) AS c, sum(impressions) AS i FROM f GROUP BY 1",
 n="SELECT s_suppkey AS node, ['https://shop.example/p/' || (s_suppkey % 75 + CASE WHEN s_suppkey % 4 = 0 THEN 100 ELSE 0 END), CASE WHEN s_suppkey % 6 = 0 THEN 'https://shop.example/p/0' ELSE 'https://shop.example/a/' || s_suppkey END] AS u, s_suppkey % 9 = 0 AS away FROM supplier",
 x="SELECT node, away, unnest(u) AS u, generate_subscripts(u, 1) AS pos FROM n WHERE NOT away", y="SELECT u, count(DISTINCT node) AS claims FROM x GROUP BY 1",
 z="SELECT node, max(claims) AS claims, count(i) AS found, arg_min(c, pos) FILTER (WHERE i IS NOT NULL) AS clicks FROM x JOIN y USING (u) LEFT JOIN p USING (u) GROUP BY 1") + """
SELECT n.node, CASE WHEN away THEN 'out-of-scope' WHEN claims > 1 THEN 'ambiguous' WHEN found > 0 THEN 'gsc' ELSE 'truncated' END AS state, CASE WHEN NOT away AND claims = 1 AND found > 0 THEN clicks END AS clicks FROM n LEFT JOIN z USING (node)""")
def _(t: Tables):
    k = F.col("s_suppkey")
    at = lambda p, c: F.concat(F.lit(f"https://shop.example/{p}/"), c)
    two = F.array(at("p", k % 75 + F.when(k % 4 == 0, 100).otherwise(0)), F.when(k % 6 == 0, at("p", F.lit(0))).otherwise(at("a", k)))
    away = F.array(F.concat(F.lit("https://away.example/"), k))
    nodes = t.supplier.select(k.alias("node"), F.when(k % 9 == 0, away).otherwise(two).alias("urls"))
    return ops.node_traffic(nodes, search_rows(t), "https://shop.example/", True).select("node", "state", "clicks")
