"""Stored runs, feeds, sitemaps, exports and landed logs over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright.plans.inputs import HITS_SQL, cte, log_hits
from pagewright.plans.registry import Tables, query
from pagewright.session import ensure_checkpoint_dir
from pagewright.sources import feeds, runs
from pagewright.streaming import first_seen, landing


def _folder(t: Tables, name: str) -> str:
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_K = "p_partkey AS k, 'https://s' || (p_partkey % 7) || '.example/p/' || p_partkey AS url, 's' || (p_partkey % 7) AS site_id, 'r' || (p_partkey % 3) AS run_id"


def _json_rows(t: Tables):
    """A JSON payload for each part: typed fields, nested ones, wrong types, fields without a column, and broken texts."""
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://s"), k % 7, F.lit(".example/p/"), k)
    payload = F.to_json(F.struct(
        F.when(k % 31 != 0, url).alias("url"), F.concat(url, F.lit("?a=1")).alias("final_url"), F.when(k % 5 == 0, "bad").otherwise((200 + k % 4).cast("string")).alias("http_status"),
        (k * 3 % 4000).alias("response_time_ms"), F.when(k % 6 != 0, F.concat(F.when(k % 4 == 0, "=").otherwise(""), "p_name")).alias("title"), F.col("p_brand").alias("x_brand"),
        F.when(k % 8 == 0, True).when(k % 8 == 1, False).alias("body_truncated"), F.when(k % 3 == 0, F.array(F.lit("Product"), "p_type")).alias("schema_types"), F.col("p_size").alias("word_count"),
        F.when(k % 2 == 0, F.array(F.struct(F.lit(301).alias("http_status"), url.alias("from_url"), F.lit("/x").alias("to_url"), F.when(k % 4 == 0, k).alias("response_time_ms")))).alias("redirect_chain"),
        F.when(k % 3 == 1, F.array(
            F.struct(F.lit("error").alias("severity"), F.lit("-meta").alias("category"), F.concat(F.lit("missing "), k % 9).alias("message")),
            F.struct(F.lit("notice").alias("severity"), F.lit("text").alias("category"), F.col("p_type").alias("message")),
        )).alias("issues"),
        F.when(k % 5 == 2, F.array(F.struct(F.lit("de").alias("language"), F.lit("/de").alias("target_url"), (k % 2 == 0).alias("target_checked_in_run"), (k % 3 * 200).alias("target_http_status"), F.when(k % 7 != 0, k % 7 == 1).alias("reciprocal_in_run")))).alias("hreflangs"),
    ))
    broken = F.when(k % 29 == 0, F.substring(payload, 1, 20)).when(k % 37 == 0, "[1, 2]").otherwise(payload)
    return t.part.select(F.concat(F.lit("s"), k % 7).alias("site_id"), F.concat(F.lit("r"), k % 3).alias("run_id"), broken.alias("payload"))


_OK = "k % 31 <> 0 AND k % 29 <> 0 AND k % 37 <> 0"


@query("crawl_page_rows", "A13", f"""
WITH p AS (SELECT {_K}, p_brand, p_name, p_size FROM part)
SELECT site_id, run_id, url, CASE WHEN k % 5 <> 0 THEN (200 + k % 4)::INTEGER END AS http_status, (k * 3 % 4000)::BIGINT AS response_time_ms,
  CASE WHEN k % 6 <> 0 THEN CASE WHEN k % 4 = 0 THEN '=' ELSE '' END || p_name END AS title, CASE k % 8 WHEN 0 THEN true WHEN 1 THEN false END AS body_truncated,
  p_size::BIGINT AS word_count, CASE WHEN k % 2 = 0 THEN 1 END::INTEGER AS hops, CASE WHEN k % 2 = 0 THEN 301 END::INTEGER AS first_hop, p_brand AS brand
FROM p WHERE {_OK} AND site_id = 's2' AND run_id = 'r1'""")
def _(t: Tables):
    # Written by site and run, one partition read back; a field without a column comes out of the variant.
    path = _folder(t, "crawl-pages")
    pages = runs.pages_from_json(_json_rows(t))[0]
    runs.save_run(pages, path)
    rows = runs.load_pages(t.spark, path, pages, "s2", "r1")
    hops = F.when(F.col("redirect_chain").isNotNull(), F.size("redirect_chain"))
    return rows.select(
        "site_id", "run_id", "url", "http_status", "response_time_ms", "title", "body_truncated", "word_count", hops.alias("hops"),
        F.get("redirect_chain", F.lit(0))["http_status"].alias("first_hop"), F.try_variant_get("payload", "$.x_brand", "string").alias("brand"),
    )


@query("rejected_page_rows", "A13", f"WITH p AS (SELECT {_K} FROM part) SELECT site_id, run_id, count(*)::BIGINT AS rejected FROM p WHERE NOT ({_OK}) GROUP BY 1, 2")
def _(t: Tables):
    return runs.pages_from_json(_json_rows(t))[1].groupBy("site_id", "run_id").agg(F.count("*").alias("rejected"))


@query("replaced_runs", "A16", f"""
WITH p AS (SELECT {_K} FROM part),
now AS (SELECT site_id, run_id, k FROM p WHERE {_OK} AND NOT (site_id = 's1' AND run_id = 'r0') AND site_id <> 's4'
  UNION ALL SELECT site_id, run_id, k FROM p WHERE {_OK} AND site_id = 's1' AND run_id = 'r0' AND k % 2 = 0
  UNION ALL SELECT site_id, 'r9', k FROM p WHERE {_OK} AND site_id = 's4' AND run_id = 'r2')
SELECT site_id, run_id, count(*)::BIGINT AS pages, sum(k * 3 % 4000)::BIGINT AS ms FROM now GROUP BY 1, 2""")
def _(t: Tables):
    # All runs are stored; one is stored again with half its pages; the history of one site gives way to a single new run.
    path = _folder(t, "runs")
    pages = runs.pages_from_json(_json_rows(t))[0]
    runs.save_run(pages, path)
    runs.save_run(pages.where("site_id = 's1' AND run_id = 'r0' AND CAST(element_at(split(url, '/'), -1) AS bigint) % 2 = 0"), path)
    runs.replace_history(t.spark, pages.where("site_id = 's4' AND run_id = 'r2'").withColumn("run_id", F.lit("r9")), path, "s4")
    return runs.load_pages(t.spark, path, pages).groupBy("site_id", "run_id").agg(F.count("*").alias("pages"), F.sum("response_time_ms").alias("ms"))


@query("flat_page_export", "A20", f"""
WITH p AS (SELECT {_K}, p_name, p_type FROM part)
SELECT url, CASE WHEN k % 5 <> 0 THEN (200 + k % 4)::VARCHAR ELSE '' END AS http_status, CASE WHEN k % 6 = 0 THEN '' WHEN k % 4 = 0 THEN '''=' || p_name ELSE p_name END AS title,
  CASE k % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS body_truncated, CASE WHEN k % 3 = 0 THEN 'Product | ' || p_type ELSE '' END AS schema_types,
  CASE WHEN k % 2 = 0 THEN '301: ' || url || ' -> /x (' || CASE WHEN k % 4 = 0 THEN k || ' ms' ELSE 'timing unavailable' END || ')' ELSE '' END AS redirect_chain,
  CASE WHEN k % 5 = 2 THEN 'de: /de (' || CASE WHEN k % 2 <> 0 THEN 'not checked' WHEN k % 3 = 0 THEN 'no response' ELSE (k % 3 * 200)::VARCHAR END || '; ' ||
    CASE WHEN k % 7 = 0 THEN 'reciprocity unverified' WHEN k % 7 = 1 THEN 'reciprocal' ELSE 'not reciprocal' END || '; canonical unverified)' ELSE '' END AS hreflangs,
  CASE WHEN k % 3 = 1 THEN '2' ELSE '0' END AS issues_count, CASE WHEN k % 3 = 1 THEN 'error: missing ' || (k % 9) || ' | notice: ' || p_type ELSE '' END AS issues
FROM p WHERE {_OK}""")
def _(t: Tables):
    rows = runs.pages_export(runs.pages_from_json(_json_rows(t))[0])
    return rows.select("url", "http_status", "title", "body_truncated", "schema_types", "redirect_chain", "hreflangs", "issues_count", "issues")


@query("single_page_export", "A22", f"""
WITH p AS (SELECT {_K}, p_name, p_type FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 29 <> 0 AND p_partkey % 37 <> 0),
r AS (
  SELECT url, k, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS nr,
    unnest(['Field', 'URL', 'HTTP status', 'Response time (ms)', 'Title', 'Description', 'Canonical', 'H1', 'Images', 'Links', '', 'Type']) AS a,
    unnest(['Value', url || '?a=1', CASE WHEN k % 5 <> 0 THEN (200 + k % 4)::VARCHAR ELSE '' END, (k * 3 % 4000)::VARCHAR, CASE WHEN k % 6 = 0 THEN '' WHEN k % 4 = 0 THEN '''=' || p_name ELSE p_name END, '', '', '', '0', '0', '', 'Severity']) AS b,
    unnest(['', '', '', '', '', '', '', '', '', '', '', 'Category']) AS c, unnest(['', '', '', '', '', '', '', '', '', '', '', 'Message']) AS d, unnest(['', '', '', '', '', '', '', '', '', '', '', 'Recommendation']) AS e FROM p
  UNION ALL SELECT url, k, 12, 'Issue', 'error', '''-meta', 'missing ' || (k % 9), '' FROM p WHERE k % 3 = 1
  UNION ALL SELECT url, k, 13, 'Issue', 'notice', 'text', p_type, '' FROM p WHERE k % 3 = 1)
SELECT url, nr::INTEGER AS nr, a, b, c, d, e FROM r""")
def _(t: Tables):
    return runs.audit_export(runs.pages_from_json(_json_rows(t))[0]).drop("site_id", "run_id")


@query("gap_export", "A22", """
WITH l AS (SELECT l_suppkey AS s, l_linenumber AS n, count(*) AS links, max(l_quantity) AS rank FROM lineitem GROUP BY 1, 2)
SELECT 'own.example' AS target, 's' || s || '.example' AS referring_domain, coalesce(max(links) FILTER (n = 1)::VARCHAR, '') AS "c1 backlinks", coalesce(max(rank) FILTER (n = 1)::VARCHAR, '') AS "c1 rank",
  coalesce(max(links) FILTER (n = 7 AND s % 3 = 0)::VARCHAR, '') AS "c7 backlinks", coalesce(max(rank) FILTER (n = 7 AND s % 3 = 0)::VARCHAR, '') AS "c7 rank", CASE WHEN s % 4 = 0 THEN '' ELSE (s % 100)::VARCHAR END AS spam_score FROM l GROUP BY s""")
def _(t: Tables):
    per = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("backlinks"), F.max("l_quantity").alias("rank")).where("l_linenumber <> 7 OR l_suppkey % 3 = 0")
    gaps = per.groupBy("l_suppkey").agg(F.collect_list(F.struct(F.concat(F.lit("c"), "l_linenumber").alias("domain"), "backlinks", "rank")).alias("competitor_backlinks"))
    s = F.col("l_suppkey")
    rows = gaps.select(F.lit("own.example").alias("target"), F.concat(F.lit("s"), s, F.lit(".example")).alias("referring_domain"), "competitor_backlinks", F.when(s % 4 != 0, s % 100).alias("max_competitor_spam_score"))
    return runs.gap_export(rows, ["c1", "c7"])


@query("rss_ranked_results", "A9", """
SELECT 'k' || ps AS keyword, rank::INTEGER AS rank, url, title FROM (
  SELECT p_size AS ps, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rank, p_partkey AS k, 'https://r.example/' || p_partkey || '?a=1&b=2' AS url, p_name AS title FROM part)
WHERE k % 10 <> 3 AND ps % 9 <> 0 AND ps % 11 <> 0""")
def _(t: Tables):
    k, z = F.col("p_partkey"), F.col("p_size")
    link = F.when(k % 10 == 3, "not an address").otherwise(F.concat(F.lit(" https://r.example/"), k, F.lit("?a=1&amp;b=2")))
    item = F.concat(F.lit("<item><title>"), "p_name", F.lit("</title><link>"), link, F.lit("</link><guid>g</guid></item>"))
    per = t.part.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))).alias("items"))
    body = F.concat(F.lit("<rss version='2.0'><channel><title>t</title>"), F.array_join(F.transform("items", lambda x: x["i"]), "\n"), F.lit("</channel></rss>"))
    text = F.when(z % 9 == 0, F.concat(F.lit("<!DOCTYPE rss>"), body)).when(z % 11 == 0, "<html></html>").otherwise(F.concat(F.lit("<?xml version='1.0'?>\n"), body))
    return feeds.rss_results(per.select(F.concat(F.lit("k"), z).alias("keyword"), text.alias("text")))[0]


@query("trend_rows", "A11", """
SELECT c_name AS keyword, CASE c_custkey % 4 WHEN 0 THEN c_custkey || 'K+' WHEN 1 THEN '1.5M' WHEN 2 THEN '2,000+' ELSE 'many' END AS traffic,
  CASE c_custkey % 4 WHEN 0 THEN c_custkey * 1000 WHEN 1 THEN 1500000 WHEN 2 THEN 2000 END::BIGINT AS volume, c_custkey % 3 <> 0 AS has_start FROM customer""")
def _(t: Tables):
    path, k = _folder(t, "trends"), F.col("c_custkey")
    label = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("K+"))).when(k % 4 == 1, "1.5M").when(k % 4 == 2, "2,000+").otherwise("many")
    start = F.when(k % 3 == 0, "soon").otherwise("2024-05-01 10:00:00")
    t.customer.select(F.col("c_name").alias("Trends"), label.alias("Search Volume"), start.alias("Started-At"), F.lit('a "quoted"\nline').alias("Breakdown")).write.option("header", True).option("escape", '"').csv(path)
    return feeds.trend_rows(t.spark, path).select("keyword", "traffic", "volume", F.col("started").isNotNull().alias("has_start"))


_MAPS = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT 'root' AS parent, 'seg' || (c_custkey % 5) AS child FROM customer
  UNION SELECT DISTINCT 'seg' || (c_custkey % 5), 'list' || (c_custkey % 40) FROM customer WHERE c_custkey % 5 <> 4
  UNION SELECT DISTINCT 'seg' || (c_custkey % 5), 'root' FROM customer UNION SELECT 'root', 'gone'),
walk(sitemap, depth) AS (SELECT 'root', 0 UNION SELECT e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.sitemap WHERE w.depth < 6),
reached AS (SELECT sitemap, min(depth) AS depth FROM walk GROUP BY 1)
"""


def _sitemap_files(t: Tables):
    """A root index of five indexes, which name lists and the root again; the lists name customers, some of other hosts and paths."""
    k = F.col("c_custkey")
    at = lambda name: F.concat(F.lit("<sitemap><loc> https://m.example/"), name, F.lit(".xml\n</loc></sitemap>"))
    entry = t.customer.select(
        F.explode(F.array(
            F.struct(F.lit("root").alias("f"), F.lit(True).alias("index"), at(F.concat(F.lit("seg"), k % 5)).alias("x")),
            F.struct(F.lit("root").alias("f"), F.lit(True).alias("index"), F.concat(at(F.lit("gone")), F.lit("<sitemap><loc>https://else.example/s.xml</loc></sitemap>")).alias("x")),
            F.struct(F.concat(F.lit("seg"), k % 5).alias("f"), F.lit(True).alias("index"), F.concat(at(F.lit("root")), F.when(k % 5 != 4, at(F.concat(F.lit("list"), k % 40))).otherwise("")).alias("x")),
            F.struct(F.concat(F.lit("list"), k % 40).alias("f"), F.lit(False).alias("index"), F.concat(
                F.lit("<url><loc>"), F.when(k % 7 == 0, "https://else.example/shop/").when(k % 11 == 0, "https://m.example/other/").otherwise("<![CDATA[https://m.example/shop/"), k, F.when((k % 7 != 0) & (k % 11 != 0), "?a=1&b=2]]>").otherwise("?a=1&amp;b=2"), F.lit("</loc><lastmod>2024-01-01</lastmod></url>")).alias("x")),
        )).alias("e")
    ).select("e.*")
    files = entry.groupBy("f", "index").agg(F.array_join(F.array_sort(F.collect_set("x")), "").alias("x"))
    text = F.when(F.col("index"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")))
    return files.select(F.concat(F.lit("https://m.example/"), "f", F.lit(".xml")).alias("file"), text.alias("text"))


def _discovered(t: Tables):
    return feeds.discovered_urls(_sitemap_files(t), t.spark.range(1).select(F.lit("https://m.example/root.xml").alias("file")), "m.example", "/shop/")


@query("sitemap_files", "A14", _MAPS + "SELECT 'https://m.example/' || sitemap || '.xml' AS sitemap, depth::INTEGER AS depth, sitemap <> 'gone' AS loaded FROM reached")
def _(t: Tables):
    return _discovered(t)[1]


@query("sitemap_addresses", "A14", _MAPS + """SELECT 'https://m.example/shop/' || c_custkey || '?a=1&b=2' AS url, 1::BIGINT AS sitemaps FROM customer
WHERE 'list' || (c_custkey % 40) IN (SELECT sitemap FROM reached) AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0""")
def _(t: Tables):
    return _discovered(t)[0]


@query("late_log_merge", "I1 I4", cte(h=HITS_SQL) + """
SELECT "at"::DATE AS day, path, family, 'claimed' AS verdict, count(*)::BIGINT AS hits, count(*) FILTER (WHERE status // 100 = 2)::BIGINT AS status_2xx, count(*) FILTER (WHERE status // 100 = 3)::BIGINT AS status_3xx,
  count(*) FILTER (WHERE status // 100 = 4)::BIGINT AS status_4xx, count(*) FILTER (WHERE status // 100 = 5)::BIGINT AS status_5xx, sum(coalesce(latency_ms, 0))::DOUBLE AS latency_sum_ms, count(latency_ms)::BIGINT AS latency_count,
  sum(coalesce(bytes, 0))::BIGINT AS bytes, epoch_ms(min("at")) AS first_ms, epoch_ms(max("at")) AS last_ms FROM h WHERE family IS NOT NULL GROUP BY 1, 2, 3""")
def _(t: Tables):
    # Three batches, the second and third with lines of days that the first has seen already.
    hits = log_hits(t).where("family IS NOT NULL").withColumn("day", F.to_date("at")).withColumn("verdict", F.lit("claimed"))
    parts = [landing.partial_counts(hits.where(F.crc32("value") % 3 == k)) for k in range(3)]
    merged = landing.merged_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return merged.withColumn("latency_sum_ms", F.round("latency_sum_ms", 3)).withColumn("first_ms", F.unix_millis("first_at")).withColumn("last_ms", F.unix_millis("last_at")).drop("first_at", "last_at")


@query("replayed_log_files", "I3", """
WITH f AS (SELECT user_id % 50 AS f, count(*) AS lines FROM events GROUP BY 1)
SELECT 'day' || f || '.log' AS file, lines::BIGINT AS lines FROM f WHERE f % 5 <> 0""")
def _(t: Tables):
    # Every second file lands again under another name with its lines in another order; those of every fifth were imported before.
    rows = t.events.select(F.concat_ws(" ", "event_id", "ts", "event_type").alias("value"), (F.col("user_id") % 50).alias("f"))
    name = lambda end: F.concat(F.lit("day"), "f", F.lit(end))
    copies = F.when(F.col("f") % 2 == 0, F.array(name(".log"), name(".log.1.gz"))).otherwise(F.array(name(".log")))
    digests = landing.file_digests(rows.select("value", F.explode(copies).alias("file")))
    return landing.fresh_files(digests, digests.where(F.regexp_extract("file", r"(\d+)", 1).cast("int") % 5 == 0)).select("file", "lines")


@query("new_address_sights", "I7", """
WITH s AS (SELECT event_type AS project, user_id || '/' || (event_id % 97) AS url, ts AS seen FROM events WHERE event_type <> 'error'),
p AS (SELECT event_type AS project, min(ts) + INTERVAL 12 HOUR AS started FROM events GROUP BY 1),
f AS (SELECT project, url, min(seen) AS first FROM s GROUP BY 1, 2)
SELECT s.project, s.url, epoch_us(seen) AS at_us, CASE WHEN first > started THEN epoch_us(first) END AS first_us, first > started AND seen <= first + INTERVAL 24 HOUR AS is_new FROM s JOIN f USING (project, url) JOIN p USING (project)""")
def _(t: Tables):
    sights = t.events.where("event_type <> 'error'").select(F.col("event_type").alias("project"), F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string")).alias("url"), F.col("ts").cast("timestamp").alias("at"))
    projects = t.events.groupBy(F.col("event_type").alias("project")).agg((F.min("ts").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("started"))
    rows = first_seen.first_seen_table(sights, projects)
    return rows.select("project", "url", F.unix_micros("at").alias("at_us"), F.unix_micros("first_at").alias("first_us"), "is_new")
