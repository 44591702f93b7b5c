"""Access-log and event analytics over lines written from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import logs as ops
from pagewright.plans.inputs import HITS_SQL, cte, log_hits, log_lines
from pagewright.plans.registry import Tables, query
from pagewright.session import cut_lineage
from pagewright.sources import logs as src

_V = """SELECT h.*, CASE WHEN family IS NULL THEN NULL WHEN family IN ('gptbot', 'perplexitybot') THEN 'claimed' WHEN family = 'googlebot' AND user_id_part < 32 THEN 'verified' WHEN family = 'bingbot' AND user_id_part >= 60 THEN 'verified' ELSE 'spoofed' END AS verdict
FROM (SELECT *, CAST(split_part(ip, '.', 3) AS INTEGER) AS user_id_part FROM h) h"""
_HV = dict(h=HITS_SQL, v=_V)


def _bounds(t: Tables):
    # Published documents, one per crawler that publishes ranges; the text is the same for any amount of log rows.
    docs = t.region.select(
        F.when(F.col("r_regionkey") % 2 == 0, "googlebot").otherwise("bingbot").alias("family"),
        F.when(F.col("r_regionkey") % 2 == 0, '{"creationTime":"x","prefixes":[{"ipv4Prefix":"66.249.0.0/19"},{"ipv6Prefix":"2001:db8::/32"},{"ipv4Prefix":"1.2.3/8"}]}')
        .otherwise('{"creationTime":"x","prefixes":[{"ipv4Prefix":" 66.249.60.0/22"},{"ipv4Prefix":"9.9.9.9/33"}]}').alias("text"),
    ).distinct()
    return src.published_ranges(docs)


def _verified(t: Tables):
    hits = cut_lineage(log_hits(t))  # parsed once, read for the addresses and for the visits
    return ops.with_verdict(hits, ops.verify_by_range(hits, _bounds(t)))


@query("parsed_log_lines", "A1 A3 H8", cte(h=HITS_SQL) + 'SELECT "at", ip, path, status, bytes, user_agent, CAST(latency_ms AS DOUBLE) AS latency_ms, family FROM h')
def _(t: Tables):
    hits = log_hits(t)
    return hits.select(F.to_timestamp_ntz(F.date_format("at", "yyyy-MM-dd HH:mm:ss")).alias("at"), "ip", "path", "status", "bytes", "user_agent", F.round("latency_ms", 3).alias("latency_ms"), "family")


@query("malformed_log_lines", "A1 A3", "SELECT event_id % 5 AS kind, count(*)::BIGINT AS lines, count(*) FILTER (WHERE event_id % 5 <> 0)::BIGINT AS malformed FROM events GROUP BY 1")
def _(t: Tables):
    # Four kinds of damage next to intact lines: bad month, no quotes, day 45, empty.
    e = F.col("event_id")
    good = F.concat(F.lit('1.2.3.4 - - [05/Jan/2024:10:00:00 +0100] "GET /a?b=1 HTTP/1.1" 200 12 "-" "x"'), F.when(e % 2 == 0, " 0.5").otherwise(""))
    value = (
        F.when(e % 5 == 0, good).when(e % 5 == 1, F.replace(good, F.lit("Jan"), F.lit("Xyz"))).when(e % 5 == 2, F.replace(good, F.lit('"'), F.lit("")))
        .when(e % 5 == 3, F.replace(good, F.lit("[05"), F.lit("[45"))).otherwise("")
    )
    rows = src.parse_lines(t.events.select((e % 5).alias("kind"), value.alias("value")))
    return rows.groupBy("kind").agg(F.count("*").alias("lines"), F.count_if(F.col("at").isNull()).alias("malformed"))


@query("published_range_bounds", "A4", """
WITH s AS (SELECT DISTINCT CASE s_suppkey % 2 WHEN 0 THEN 'googlebot' ELSE 'bingbot' END AS family, s_suppkey % 200 AS k, s_nationkey AS n, 20 + s_suppkey % 9 AS bits FROM supplier),
b AS (SELECT family, '10.' || k || '.' || n || '.77/' || bits AS cidr, 10 * 16777216 + k * 65536 + n * 256 + 77 AS a, 1 << (32 - bits) AS width FROM s)
SELECT family, cidr, (a - a % width)::BIGINT AS lo, (a - a % width + width - 1)::BIGINT AS hi FROM b UNION ALL SELECT DISTINCT family, '2001:db8:' || k || '::/48', NULL, NULL FROM s""")
def _(t: Tables):
    # A published document for each supplier, with an IPv4 and an IPv6 range and one that is malformed.
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit('{"creationTime":"x","prefixes":[{"ipv4Prefix":"10.'), k % 200, F.lit("."), "s_nationkey", F.lit(".77/"), 20 + k % 9, F.lit('"},{"ipv6Prefix":"2001:db8:'), k % 200,
        F.lit('::/48"},{"ipv4Prefix":"10.1.2/8"}]}'),
    )
    ranges = src.published_ranges(t.supplier.select(F.when(k % 2 == 0, "googlebot").otherwise("bingbot").alias("family"), text.alias("text")))
    return ranges.select("family", "cidr", "lo", "hi")


@query("crawler_ipv6_verdicts", "A4 C9 D3 J4", """
WITH v AS (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN '2001:db8:' || (user_id % 90) || '::' || (event_id % 10) WHEN 1 THEN '2001:DB9::' || (event_id % 10) WHEN 2 THEN '2001:db8::zz' || (user_id % 9) ELSE '66.249.3.' || (event_id % 256) END AS ip, event_id % 4 AS k, event_id % 3 AS f FROM events)
SELECT ip, CASE f WHEN 0 THEN 'googlebot' WHEN 1 THEN 'bingbot' ELSE 'gptbot' END AS family, CASE WHEN f = 2 OR k = 2 THEN 'claimed' WHEN f = 0 AND k IN (0, 3) THEN 'verified' ELSE 'spoofed' END AS verdict, CASE WHEN f = 2 OR k = 2 THEN 'none' ELSE 'published-ranges' END AS method FROM v""")
def _(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    ip = (
        F.when(e % 4 == 0, F.concat(F.lit("2001:db8:"), u % 90, F.lit("::"), e % 10)).when(e % 4 == 1, F.concat(F.lit("2001:DB9::"), e % 10))
        .when(e % 4 == 2, F.concat(F.lit("2001:db8::zz"), u % 9)).otherwise(F.concat(F.lit("66.249.3."), e % 256))
    )
    family = F.when(e % 3 == 0, "googlebot").when(e % 3 == 1, "bingbot").otherwise("gptbot")
    return ops.verify_by_range(t.events.select(ip.alias("ip"), family.alias("family")), _bounds(t))


@query("crawler_range_verdicts", "C9 J4", cte(**_HV) + "SELECT DISTINCT ip, family, verdict, CASE WHEN verdict = 'claimed' THEN 'none' ELSE 'published-ranges' END AS method FROM v WHERE family IS NOT NULL")
def _(t: Tables):
    return ops.verify_by_range(log_hits(t), _bounds(t))


@query("crawler_host_verdicts", "C10 J4", cte(h=HITS_SQL, i="SELECT DISTINCT ip, family, CAST(split_part(ip, '.', 4) AS INTEGER) AS d FROM h WHERE family IS NOT NULL") + """
SELECT ip, family, CASE WHEN family NOT IN ('googlebot', 'bingbot') OR d % 4 = 0 THEN 'claimed' WHEN family = 'googlebot' AND d % 4 = 1 AND d % 3 <> 0 THEN 'verified' WHEN family = 'bingbot' AND d % 4 = 2 AND d % 3 <> 0 THEN 'verified' ELSE 'spoofed' END AS verdict,
 CASE WHEN family NOT IN ('googlebot', 'bingbot') OR d % 4 = 0 THEN 'none' ELSE 'reverse-forward-dns' END AS method FROM i""")
def _(t: Tables):
    hits = log_hits(t)
    d = F.element_at(F.split("ip", r"\."), 4).cast("int")
    host = F.when(d % 4 == 1, "Crawl-1.googlebot.com.").when(d % 4 == 2, "a.search.msn.com").when(d % 4 == 3, "evil.example")
    answers = hits.select("ip").distinct().where(d % 4 != 0).select("ip", host.alias("host"), F.when(d % 3 != 0, F.array("ip")).otherwise(F.array(F.lit("1.1.1.1"))).alias("forward_ips"))
    return ops.verify_by_host(hits, answers)


@query("verification_summary", "D3", cte(**_HV) + "SELECT CASE WHEN verdict = 'claimed' THEN 'none' ELSE 'published-ranges' END AS method, verdict, count(DISTINCT ip || '|' || family)::BIGINT AS checks FROM v WHERE family IS NOT NULL GROUP BY 1, 2")
def _(t: Tables):
    return ops.verification_summary(ops.verify_by_range(log_hits(t), _bounds(t)))


_GAPPED = 'SELECT *, epoch_ms("at") - lag(epoch_ms("at")) OVER (PARTITION BY path, family, verdict ORDER BY "at") AS gap FROM v WHERE family IS NOT NULL'


@query("crawler_visit_gaps", "E1", cte(**_HV, g=_GAPPED) + "SELECT path, family, verdict, gap AS gap_ms, count(*)::BIGINT AS n FROM g GROUP BY ALL")
def _(t: Tables):
    return ops.visit_gaps(_verified(t)).groupBy("path", "family", "verdict", "gap_ms").agg(F.count("*").alias("n"))


@query("crawler_path_aggregates", "D1", cte(**_HV, g=_GAPPED) + """
SELECT path, family, verdict, count(*)::BIGINT AS hits, count(*) FILTER (WHERE status // 100 = 2)::BIGINT AS status_2xx, count(*) FILTER (WHERE status // 100 = 3)::BIGINT AS status_3xx, count(*) FILTER (WHERE status // 100 = 4)::BIGINT AS status_4xx, count(*) FILTER (WHERE status // 100 = 5)::BIGINT AS status_5xx,
 sum(coalesce(latency_ms, 0))::DOUBLE AS latency_sum_ms, count(latency_ms)::BIGINT AS latency_count, sum(coalesce(bytes, 0))::BIGINT AS bytes, max(gap)::BIGINT AS max_gap_ms, coalesce(sum(gap), 0)::BIGINT AS gap_sum_ms, (count(*) - 1)::BIGINT AS gap_count FROM g GROUP BY ALL""")
def _(t: Tables):
    return ops.bot_aggregate(_verified(t)).withColumn("latency_sum_ms", F.round("latency_sum_ms", 3)).drop("first_at", "last_at")


@query("log_day_coverage", "D2", cte(h=HITS_SQL) + 'SELECT count(DISTINCT CAST("at" AS DATE)) FILTER (WHERE CAST("at" AS DATE) >= (SELECT max(CAST("at" AS DATE)) FROM h) - 13)::BIGINT AS coverage_days, 14::BIGINT AS period_days FROM h')
def _(t: Tables):
    return ops.log_coverage(log_hits(t), 14)


@query("log_missing_days", "I2", "SELECT d::DATE AS day FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY)) AS d) WHERE d::DATE NOT IN (SELECT ts::DATE FROM events WHERE value > 4 AND event_type = 'error' AND user_id < 3)")
def _(t: Tables):
    # Sparse visits leave days empty; the first and last day of the whole log are its ends.
    whole = t.events.withColumnRenamed("ts", "at")
    return ops.missing_days(whole.where("value > 4 AND event_type = 'error' AND user_id < 3"), whole)


_SCORES = "SELECT '/' || k || '/' || n AS path, CAST((n * 7) % 100 AS DOUBLE) AS score FROM (VALUES ('view'), ('click'), ('other')) k(k), generate_series(0, 39) g(n)"
_AGG = "SELECT path, count(*) AS hits FROM v WHERE verdict = 'verified' GROUP BY 1"


def _scores(t: Tables):
    kind = F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("other")))
    n = t.events.select((F.col("user_id") % 40).alias("n")).distinct()
    return n.select("n", kind.alias("k")).select(F.concat(F.lit("/"), "k", F.lit("/"), "n").alias("path"), ((F.col("n") * 7) % 100).cast("double").alias("score"))


@query("crawl_efficiency_matrix", "C19 J5", cte(**_HV, s=_SCORES, a=_AGG) + """
SELECT path, score, coalesce(hits, 0)::BIGINT AS hits, CASE WHEN score IS NULL THEN 'inconclusive' WHEN score < 45 AND coalesce(hits, 0) > 25 THEN 'waste' WHEN coalesce(hits, 0) < 2 THEN 'starvation' ELSE 'ok' END AS verdict FROM s FULL JOIN a USING (path)""")
def _(t: Tables):
    v = _verified(t)
    return ops.crawl_matrix(_scores(t), ops.bot_aggregate(v), ops.log_coverage(v))


@query("log_visit_evidence", "C20", cte(**_HV, s=_SCORES, a="SELECT path, count(*) AS hits FROM v WHERE verdict = 'verified' AND family = 'googlebot' GROUP BY 1") + "SELECT s.path, coalesce(hits, 0)::BIGINT AS bot_hits, 'measured' AS state FROM s LEFT JOIN a USING (path)")
def _(t: Tables):
    v = _verified(t)
    pages = _scores(t).select(F.concat("path", F.lit("/")).alias("path"))
    return ops.visit_evidence(pages, ops.bot_aggregate(v), ops.log_coverage(v)).select("path", "bot_hits", "state")


@query("matrix_threshold_calibration", "D37", """
WITH c AS (SELECT CAST(user_id * 3 % 100 AS DOUBLE) AS score, (event_id * 7) % 60 AS hits, CASE WHEN user_id * 3 % 100 < 40 AND (event_id * 7) % 60 > 15 THEN 'waste' WHEN (event_id * 7) % 60 < 3 THEN 'starvation' ELSE 'ok' END AS verdict FROM events),
k AS (SELECT score, hits, verdict, count(*) AS n FROM c GROUP BY ALL),
g AS (SELECT w, h, s, abs(w - 45) + abs(h - 25) + abs(s - 2) AS d FROM generate_series(30, 60, 5) a(w), generate_series(5, 50, 5) b(h), generate_series(1, 5) e(s)),
r AS (SELECT w, h, s, d, sum(CASE WHEN CASE WHEN score < w AND hits > h THEN 'waste' WHEN hits < s THEN 'starvation' ELSE 'ok' END <> verdict THEN n ELSE 0 END) AS errors, sum(n) AS cases FROM k, g GROUP BY ALL)
SELECT w::BIGINT AS waste_max_score, h::BIGINT AS waste_min_hits, s::BIGINT AS starvation_max_hits, errors::BIGINT AS errors, cases::BIGINT AS cases FROM r ORDER BY r.errors, d, w, h, s LIMIT 1""")
def _(t: Tables):
    score, hits = (F.col("user_id") * 3 % 100).cast("double"), F.col("event_id") * 7 % 60
    label = F.when((score < 40) & (hits > 15), "waste").when(hits < 3, "starvation").otherwise("ok")
    return ops.calibrate_matrix(t.events.select(score.alias("score"), hits.alias("hits"), label.alias("verdict")))


@query("first_seen_urls", "E16", """
WITH s AS (SELECT event_type AS project, user_id || '/' || (event_id % 97) AS url, min(ts) AS first_at FROM events GROUP BY 1, 2), b AS (SELECT event_type AS project, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1)
SELECT project, url, first_at FROM s JOIN b USING (project) WHERE first_at > a AND first_at >= z - INTERVAL 24 HOUR""")
def _(t: Tables):
    seen = t.events.select(F.col("event_type").alias("project"), F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string")).alias("url"), F.col("ts").alias("at"))
    return ops.first_seen_recent(seen)


@query("hash_chain_breaks", "E15", """
WITH c AS (SELECT o_custkey AS log, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey FROM orders),
x AS (SELECT log, seq, o_orderkey % 53 = 0 AS torn FROM c)
SELECT log, min(seq) FILTER (WHERE torn)::BIGINT AS broken_at, count(*)::BIGINT AS entries FROM x GROUP BY 1""")
def _(t: Tables):
    from pyspark.sql import Window as W

    rows = t.orders.select(
        F.col("o_custkey").alias("log"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("seq"), "o_orderkey",
        F.concat(F.lit("order "), "o_orderkey").alias("payload"),
    )
    return _chain(rows)


def _chain(base):
    """Write a valid chain by folding each log in order, then tear chosen entries."""
    per = base.groupBy("log").agg(F.array_sort(F.collect_list(F.struct("seq", "payload", "o_orderkey"))).alias("e"))
    kind = "array<struct<seq:bigint,payload:string,o_orderkey:bigint,prev_hash:string,hash:string>>"

    def step(acc, x):
        prev = F.coalesce(F.get(acc, F.size(acc) - 1)["hash"], F.lit(""))
        digest = F.sha2(F.concat_ws("|", prev, x["seq"].cast("string"), x["payload"]), 256)
        return F.concat(acc, F.array(F.struct(x["seq"].alias("seq"), x["payload"].alias("payload"), x["o_orderkey"].alias("o_orderkey"), prev.alias("prev_hash"), digest.alias("hash"))))

    rows = per.select("log", F.explode(F.aggregate("e", F.array().cast(kind), step)).alias("x")).select("log", "x.*")
    torn = rows.withColumn("payload", F.when(F.col("o_orderkey") % 53 == 0, "changed").otherwise(F.col("payload")))
    return ops.hash_chain_break(torn)
