"""Stand-in inputs: domain tables that Spark derives from the given tables, and the same as SQL for the oracle.

Each ``NAME_SQL`` is a CTE body over the driver's views, written independently of the Spark derivation's helpers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewright.plans.registry import Tables


def cte(**bodies: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in bodies.items()) + "\n"


# --- crawled pages -------------------------------------------------------------------------------------------

PAGES_SQL = """
SELECT page_id, url, html, split_part(split_part(url, '://', 2), '/', 1) AS site_id, 'r1' AS run_id,
  CAST(CASE page_id % 17 WHEN 3 THEN 404 WHEN 5 THEN 410 WHEN 7 THEN 500 WHEN 9 THEN 301 WHEN 11 THEN 0 ELSE 200 END AS INTEGER) AS http_status,
  CASE page_id % 7 WHEN 0 THEN 'noindex, follow' WHEN 3 THEN 'INDEX,FOLLOW' WHEN 5 THEN 'none' END AS meta_robots,
  CASE WHEN page_id % 13 = 4 THEN 'noindex' END AS x_robots_tag,
  CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/canonical/' || (page_id % 10) WHEN 3 THEN 'https://elsewhere.example/' END AS canonical,
  CAST(length(html) % 4000 AS BIGINT) AS response_time_ms, CAST(page_id % 5 AS INTEGER) AS depth,
  CAST(length(html) // 6 AS BIGINT) AS word_count,
  CASE page_id % 19 WHEN 2 THEN 'dns' WHEN 6 THEN 'timeout' END AS request_error_kind
FROM pages"""


def crawl_pages(t: Tables) -> DataFrame:
    """Pages with the response facts a crawl stores, derived from the page number and text."""
    p, n = F.col("page_id"), F.length("html")

    def pick(mod: int, cases: dict, default=None):
        out = None
        for k, v in cases.items():
            v = v if not isinstance(v, (str, int)) else F.lit(v)
            out = F.when(p % mod == k, v) if out is None else out.when(p % mod == k, v)
        return out if default is None else out.otherwise(default)

    return t.pages.select(
        "page_id", "url", "html",
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("site_id"),
        F.lit("r1").alias("run_id"),
        pick(17, {3: 404, 5: 410, 7: 500, 9: 301, 11: 0}, 200).cast("int").alias("http_status"),
        pick(7, {0: "noindex, follow", 3: "INDEX,FOLLOW", 5: "none"}).alias("meta_robots"),
        pick(13, {4: "noindex"}).alias("x_robots_tag"),
        pick(5, {0: F.col("url"), 1: F.concat(F.lit("/canonical/"), (p % 10).cast("string")), 3: "https://elsewhere.example/"}).alias("canonical"),
        (n % 4000).cast("long").alias("response_time_ms"),
        (p % 5).cast("int").alias("depth"),
        F.floor(n / 6).cast("long").alias("word_count"),
        pick(19, {2: "dns", 6: "timeout"}).alias("request_error_kind"),
    )


# --- links ---------------------------------------------------------------------------------------------------

LINKS_SQL = """
SELECT page_id, site_id, source, CAST(pos AS INTEGER) AS pos, href, anchor, origin || href AS target
FROM (
  SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS site_id, url AS source, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS origin,
    generate_subscripts(hrefs, 1) AS pos, unnest(hrefs) AS href, unnest(anchors) AS anchor
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs,
               regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS anchors FROM pages))"""


def page_links(t: Tables) -> DataFrame:
    """One row per link of a page: source, target, anchor, zone."""
    from pagewright.operators import extract

    return extract.links(extract.parse(t.pages.withColumn("site_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))))


# A denser link graph than the nav links give: customers and parts as pages of one site per nation.
EDGES_SQL = """
SELECT DISTINCT 's' || (l_suppkey % 7) AS site_id, 'n' || l_suppkey AS source, 'n' || (l_partkey % 397) AS target
FROM lineitem"""


def supply_edges(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("site_id"),
        F.concat(F.lit("n"), F.col("l_suppkey")).alias("source"),
        F.concat(F.lit("n"), F.col("l_partkey") % 397).alias("target"),
    ).distinct()


# --- access log ----------------------------------------------------------------------------------------------

HITS_SQL = """
SELECT event_id, date_trunc('second', ts) AS "at", '66.249.' || (user_id % 64) || '.' || (event_id % 256) AS ip,
  '/' || event_type || '/' || (user_id % 40) AS path,
  CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 302 WHEN 'purchase' THEN 201 ELSE CASE WHEN event_id % 9 = 0 THEN 404 ELSE 200 END END AS INTEGER) AS status,
  CASE WHEN event_id % 11 <> 0 THEN event_id * 37 % 50000 END AS bytes,
  CASE user_id % 6 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)'
    WHEN 2 THEN 'GPTBot/1.2' WHEN 3 THEN 'PerplexityBot/1.0' ELSE 'Mozilla/5.0 (X11; Linux)' END AS user_agent,
  CASE WHEN event_id % 4 <> 0 THEN (event_id % 3000) END AS latency_ms,
  CASE user_id % 6 WHEN 0 THEN 'googlebot' WHEN 1 THEN 'bingbot' WHEN 2 THEN 'gptbot' WHEN 3 THEN 'perplexitybot' END AS family
FROM events"""


def log_lines(t: Tables) -> DataFrame:
    """Access-log text lines written from the events, as a server would write them."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    status = F.when(kind == "error", 500).when(kind == "signup", 302).when(kind == "purchase", 201).when(e % 9 == 0, 404).otherwise(200)
    agent = (
        F.when(u % 6 == 0, "Mozilla/5.0 (compatible; Googlebot/2.1)").when(u % 6 == 1, "Mozilla/5.0 (compatible; bingbot/2.0)")
        .when(u % 6 == 2, "GPTBot/1.2").when(u % 6 == 3, "PerplexityBot/1.0").otherwise("Mozilla/5.0 (X11; Linux)")
    )
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    size = F.when(e % 11 != 0, (e * 37 % 50000).cast("string")).otherwise("-")
    latency = F.when(e % 4 != 0, F.concat(F.lit(" "), F.format_string("%.3f", (e % 3000) / 1000.0))).otherwise("")
    return t.events.select(
        F.concat(
            F.lit("66.249."), u % 64, F.lit("."), e % 256, F.lit(" - - ["), stamp, F.lit(' +0000] "GET /'), kind, F.lit("/"),
            u % 40, F.lit("?k="), e % 5, F.lit(' HTTP/1.1" '), status, F.lit(" "), size, F.lit(' "-" "'), agent, F.lit('"'), latency,
        ).alias("value")
    )


def log_hits(t: Tables) -> DataFrame:
    from pagewright.sources import logs

    return logs.parse_lines(log_lines(t)).where("at is not null")


# --- search performance --------------------------------------------------------------------------------------

SEARCH_SQL = """
SELECT 'q' || (l_partkey % 500) AS query, 'https://shop.example/p/' || (l_suppkey % 60) AS page, CAST(l_shipdate AS DATE) AS date,
  l_quantity AS impressions, CAST(floor(l_quantity * l_discount) AS DOUBLE) AS clicks, 1 + l_linenumber * 3 + round(l_tax * 100) AS position
FROM lineitem"""


def search_rows(t: Tables) -> DataFrame:
    """query x page x day facts from order lines: quantity as impressions, discount share as clicks."""
    return t.lineitem.select(
        F.concat(F.lit("q"), F.col("l_partkey") % 500).alias("query"),
        F.concat(F.lit("https://shop.example/p/"), F.col("l_suppkey") % 60).alias("page"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("impressions"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("double").alias("clicks"),
        (1 + F.col("l_linenumber") * 3 + F.round(F.col("l_tax") * 100)).cast("double").alias("position"),
    )


# --- document terms ------------------------------------------------------------------------------------------

TERMS_SQL = """
SELECT doc_id, lang, source, term, CAST(count(*) AS BIGINT) AS n
FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS term FROM documents)
GROUP BY ALL"""


def doc_terms(t: Tables) -> DataFrame:
    """(doc, term, count) of all words."""
    from pagewright.functions import text

    return (
        t.documents.select("doc_id", "lang", "source", F.explode(text.words(F.col("text"))).alias("term"))
        .groupBy("doc_id", "lang", "source", "term").agg(F.count("*").alias("n"))
    )


def packed_terms(t: Tables) -> DataFrame:
    """The rows of :func:`doc_terms` as (site, page, term, tf), packed in blocks; a document without a source has no site.

    A text moves once, to the others of its site.
    """
    from pagewright.functions import text
    from pagewright.operators import termblocks

    docs = t.documents.where("source IS NOT NULL AND text IS NOT NULL").select(F.col("source").alias("site"), F.col("doc_id").alias("page"), "lang", "text")
    near = docs.repartitionByRange("site", "page").sortWithinPartitions("site", "page", "lang")
    return termblocks.pack(near.select("site", "page", "lang", text.words(F.col("text")).alias("words")), "site", ["page", "lang"])


# --- daily series --------------------------------------------------------------------------------------------

SERIES_SQL = """
SELECT c_mktsegment AS series, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def daily_series(t: Tables) -> DataFrame:
    """Orders per market segment and day."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("series"), F.to_date("o_orderdate").alias("date"))
        .agg(F.count("*").cast("double").alias("value"))
    )
