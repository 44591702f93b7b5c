"""Experiments, run differences, histories and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import experiments as ex, history as ops
from pagewright.plans.registry import Tables, query

_SER = "SELECT l_linenumber AS series, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"
_EXP = "SELECT s * 10 + k AS exp, s AS test, s % 7 + 1 AS control, DATE '1995-01-01' + CAST(k * 211 + s * 17 AS INTEGER) AS start FROM (SELECT DISTINCT l_linenumber AS s FROM lineitem) a, generate_series(0, 6) g(k)"
_ROWS = """SELECT e.exp, e.start, d.date, t.value AS y, c.value AS x, d.date >= e.start AS post FROM e, generate_series(-90, 89) g(o), (SELECT 1) one, LATERAL (SELECT e.start + CAST(g.o AS INTEGER) AS date) d
LEFT JOIN s t ON t.series = e.test AND t.date = d.date LEFT JOIN s c ON c.series = e.control AND c.date = d.date WHERE d.date BETWEEN (SELECT min(date) FROM s WHERE series = e.test) AND (SELECT max(date) FROM s WHERE series = e.test)"""


def _series(t: Tables):
    return t.lineitem.groupBy(F.col("l_linenumber").alias("series"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value"))


def _experiments(t: Tables):
    s = F.col("s")
    base = t.lineitem.select(F.col("l_linenumber").alias("s")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return base.select((s * 10 + F.col("k")).alias("exp"), s.alias("test"), (s % 7 + 1).alias("control"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("k") * 211 + s * 17).alias("start"))


def _effect_sql(source: str, p: str) -> str:
    return f"""
{p}k AS (SELECT * FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
{p}f AS (SELECT exp, count(*) FILTER (WHERE NOT post) AS n, count(*) FILTER (WHERE post) AS m, regr_slope(CASE WHEN NOT post THEN y END, CASE WHEN NOT post THEN x END) AS b, regr_intercept(CASE WHEN NOT post THEN y END, CASE WHEN NOT post THEN x END) AS a,
  regr_r2(CASE WHEN NOT post THEN y END, CASE WHEN NOT post THEN x END) AS r2, avg(CASE WHEN NOT post THEN x END) AS xm FROM {p}k GROUP BY 1),
{p}r AS (SELECT k.exp, k.date, k.post, k.x, y - (a + b * x) AS e, a + b * x AS hat FROM {p}k k JOIN {p}f USING (exp)),
{p}g AS (SELECT exp, sum(e * e) AS sse, sum((x - xm) ** 2) AS sxx, sum(e * l) / sum(e * e) AS rho FROM (SELECT *, lag(e) OVER (PARTITION BY exp ORDER BY date) AS l FROM {p}r WHERE NOT post) JOIN {p}f USING (exp) GROUP BY 1),
{p}h AS (SELECT exp, sum(e) AS est, sum(x - xm) AS sp, sum(hat) AS hat FROM {p}r JOIN {p}f USING (exp) WHERE post GROUP BY 1),
{p}e AS (SELECT exp, n, m, r2, b, est, hat, least(0.9, greatest(0, rho)) AS rho, sqrt(sse / (n - 2) * (m + m * m / n + sp * sp / sxx) * (1 + least(0.9, greatest(0, rho))) / (1 - least(0.9, greatest(0, rho)))) AS sd,
  1.959964 + (1.959964 ** 3 + 1.959964) / (4 * greatest(1, n - 2)) + (5 * 1.959964 ** 5 + 16 * 1.959964 ** 3 + 3 * 1.959964) / (96 * greatest(1, n - 2) ** 2) AS t FROM {p}f JOIN {p}g USING (exp) JOIN {p}h USING (exp))"""


_IMPACT = f"""WITH s AS ({_SER}), e AS ({_EXP}), w AS ({_ROWS}), {_effect_sql("w", "m_").strip()},
half AS (SELECT exp, date, x, y, row_number() OVER (PARTITION BY exp ORDER BY date) > floor(count(*) OVER (PARTITION BY exp) / 2) AS post FROM w WHERE NOT post AND x IS NOT NULL AND y IS NOT NULL), {_effect_sql("half", "p_").strip()},
tot AS (SELECT exp, count(*) FILTER (WHERE NOT post) AS pt, count(*) FILTER (WHERE post) AS qt FROM w GROUP BY 1),
z AS (SELECT m.*, (p.est - p.t * p.sd > 0 OR p.est + p.t * p.sd < 0) AS pd, pt, qt FROM m_e m LEFT JOIN p_e p USING (exp) JOIN tot USING (exp)),
y AS (SELECT *, list_filter([CASE WHEN n < 28 THEN 'short-pre-period' END, CASE WHEN m < 7 THEN 'short-post-period' END, CASE WHEN (pt - n) / pt > 0.1 OR (qt - m) / qt > 0.1 THEN 'missing-days' END], lambda x: x IS NOT NULL) AS a1,
  list_filter([CASE WHEN r2 < 0.0001 THEN 'poor-prefit' END, CASE WHEN pd THEN 'placebo-failed' END], lambda x: x IS NOT NULL) AS a2 FROM z)
SELECT exp, n::BIGINT AS n, m::BIGINT AS m, round(r2, 6) AS r2, round(rho, 6) AS rho, array_to_string(CASE WHEN len(a1) > 0 THEN a1 ELSE a2 END, ',') AS reasons, round(CASE WHEN len(a1) + len(a2) = 0 THEN est END, 4) AS estimate,
 round(CASE WHEN len(a1) + len(a2) = 0 THEN est - t * sd END, 4) AS lower, round(CASE WHEN len(a1) + len(a2) = 0 THEN est + t * sd END, 4) AS upper FROM y"""

_RULES = ex.CausalRules(min_r2=0.0001)


@query("regression_impact", "O2 C33", _IMPACT)
def _(t: Tables):
    rows = ex.align_series(_experiments(t), _series(t), _RULES)
    out = ex.regression_impact(rows, _RULES)
    return out.select("exp", "n", "m", F.round("r2", 6).alias("r2"), F.round("rho", 6).alias("rho"), F.array_join("reasons", ",").alias("reasons"), *[F.round(c, 4).alias(c) for c in ("estimate", "lower", "upper")])


@query("control_selection", "O1", f"""
WITH s AS ({_SER}), e AS ({_EXP}), c AS (SELECT exp, test, k AS control, start FROM e, generate_series(1, 7) g(k) WHERE k <> test),
p AS (SELECT c.exp, c.control, regr_r2(a.value, b.value) AS r2, count(*) AS n FROM c JOIN s a ON a.series = c.test AND a.date BETWEEN c.start - 90 AND c.start - 1 JOIN s b ON b.series = c.control AND b.date = a.date GROUP BY 1, 2)
SELECT exp, arg_min(control, (-round(r2, 9), -n, control))::INTEGER AS control, round(arg_min(r2, (-round(r2, 9), -n, control)), 6) AS r2 FROM p GROUP BY 1""")
def _(t: Tables):
    every = _experiments(t).drop("control").withColumn("control", F.explode(F.sequence(F.lit(1), F.lit(7)))).where("control <> test")
    return ex.choose_control(every, _series(t)).select("exp", "control", F.round("r2", 6).alias("r2"))


_TRIED = "w0 AS (" + _ROWS + "), w AS (SELECT exp * 100 + o AS exp, date, x, y, date >= start - o AS post FROM w0, (VALUES (14), (21)) v(o) WHERE NOT post)"


@query("impact_backtest", "O4", _IMPACT.replace(f"w AS ({_ROWS})", _TRIED).split("\nSELECT exp, n::BIGINT")[0] + """
, g AS (SELECT exp // 100 AS exp, est - t * sd > 0 OR est + t * sd < 0 AS wrong FROM y WHERE len(a1) + len(a2) = 0)
SELECT e.exp, count(wrong)::BIGINT AS runs, count(*) FILTER (wrong)::BIGINT AS false_positives, CASE WHEN count(wrong) = 0 THEN 'not-estimable' WHEN count(*) FILTER (wrong) > 0 THEN 'failed' ELSE 'passed' END AS status FROM e LEFT JOIN g USING (exp) GROUP BY 1""")
def _(t: Tables):
    rows = ex.align_series(_experiments(t), _series(t), _RULES)
    return ex.backtest(rows, _experiments(t).select("exp", "start"), rules=_RULES)


@query("structural_impact", "O3")
def _(t: Tables):
    rows = ex.align_series(_experiments(t), _series(t), _RULES)
    return ex.structural_impact(rows).select("exp", *[F.round(c, 3).alias(c) for c in ("estimate", "lower", "upper", "probability")], "days")


@query("market_normalised_impact", "O5", f"""
WITH s AS ({_SER}), e AS ({_EXP}), w AS ({_ROWS}), mk AS (SELECT date, sum(value) AS level FROM s GROUP BY 1), v AS (SELECT w.*, level FROM w LEFT JOIN mk USING (date) WHERE x IS NOT NULL AND y IS NOT NULL),
b AS (SELECT exp, avg(level) FILTER (WHERE NOT post) AS base FROM v GROUP BY 1), u AS (SELECT exp, date, post, y / (level / base) AS y, x / (level / base) AS x FROM v JOIN b USING (exp)),
f AS (SELECT exp, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS sd FROM u WHERE NOT post GROUP BY 1),
g AS (SELECT exp, n, sd, avg(y - (a + b * x)) AS eff, count(*) AS m, count(*) FILTER (WHERE date BETWEEN DATE '1996-03-05' AND DATE '1996-03-20') AS ud FROM u JOIN f USING (exp) WHERE post GROUP BY 1, 2, 3)
SELECT exp, round(eff, 6) AS effect, ud::BIGINT AS update_days, CASE WHEN ud > 0 THEN 'inconclusive' WHEN NOT (eff - 1.959964 * sd / sqrt(m) > 0 OR eff + 1.959964 * sd / sqrt(m) < 0) THEN 'no-effect' WHEN eff > 0 THEN 'positive' ELSE 'negative' END AS verdict FROM g WHERE n >= 14""")
def _(t: Tables):
    s = _series(t)
    market = s.groupBy("date").agg(F.sum("value").alias("market"))
    rows = ex.align_series(_experiments(t), s, _RULES).join(market, "date", "left").where("x IS NOT NULL AND y IS NOT NULL")
    windows = t.region.select(F.lit("1996-03-05").cast("date").alias("first"), F.lit("1996-03-20").cast("date").alias("last")).distinct()
    return ex.market_impact(rows, windows).select("exp", F.round("effect", 6).alias("effect"), "update_days", "verdict")


@query("holm_adjusted_tests", "E11", """
WITH p AS (SELECT o_custkey % 50 AS family, o_orderkey AS test, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 37 % 4001) / 40000.0::DOUBLE END AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS r, count(*) OVER (PARTITION BY family) AS m FROM p WHERE p IS NOT NULL),
a AS (SELECT family, test, max(least(1, (m - r + 1) * p)) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS adj FROM r)
SELECT family, test, p, round(adj, 6) AS adjusted, coalesce(adj < 0.05, false) AS significant FROM p LEFT JOIN a USING (family, test)""")
def _(t: Tables):
    p = F.when(F.col("o_orderkey") % 17 != 0, (F.col("o_orderkey") * 37 % 4001) / 40000.0)
    return ex.holm(t.orders.select((F.col("o_custkey") % 50).alias("family"), F.col("o_orderkey").alias("test"), p.alias("p"))).withColumn("adjusted", F.round("adjusted", 6))


@query("series_autocorrelation", "E12", f"""
WITH s AS ({_SER}), m AS (SELECT year(date) AS y, series, date, value - avg(value) OVER (PARTITION BY year(date), series) AS d FROM s), l AS (SELECT *, lag(d) OVER (PARTITION BY y, series ORDER BY date) AS p FROM m)
SELECT series, y::INTEGER AS year, round(CASE WHEN count(*) < 3 OR sum(d * d) = 0 THEN 0 ELSE least(0.9, greatest(0, sum(d * p) / sum(d * d))) END, 6) AS rho FROM l GROUP BY 1, 2""")
def _(t: Tables):
    return ex.autocorrelation(_series(t).withColumn("year", F.year("date")), ["series", "year"], "value", "date").withColumn("rho", F.round("rho", 6))


# Two runs of one site: suppliers' parts before and after a date.
_RUN = lambda flag: f"SELECT l_partkey * 10 + l_linenumber AS key, max(l_orderkey % 9)::BIGINT AS depth, CASE WHEN sum(l_tax) > 0.1 THEN max(l_returnflag) END AS title, CAST(min(l_suppkey) % 3 * 100 + 200 AS INTEGER) AS http_status FROM lineitem WHERE l_suppkey % 3 <> {flag} GROUP BY 1"


def _run(t: Tables, flag: int):
    return t.lineitem.where(F.col("l_suppkey") % 3 != flag).groupBy((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("key")).agg(
        F.max(F.col("l_orderkey") % 9).alias("depth"), F.when(F.sum("l_tax") > 0.1, F.max("l_returnflag")).alias("title"), (F.min("l_suppkey") % 3 * 100 + 200).cast("int").alias("http_status")
    )


_DIFF = f"""WITH a AS ({_RUN(0)}), b AS ({_RUN(1)}), d AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS kind,
 CASE WHEN a.key IS NULL OR b.key IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.depth IS DISTINCT FROM b.depth THEN 'depth' END, CASE WHEN a.title IS DISTINCT FROM b.title THEN 'title' END, CASE WHEN a.http_status IS DISTINCT FROM b.http_status THEN 'http_status' END], lambda x: x IS NOT NULL), ',') END AS fields
 FROM a FULL JOIN b ON a.key = b.key)"""


def _diff(t: Tables):
    return ops.crawl_diff(_run(t, 1), _run(t, 0), ["depth", "title", "http_status"])


@query("crawl_diff", "C13", _DIFF + " SELECT key, kind, fields FROM d WHERE kind <> 'changed' OR fields <> ''")
def _(t: Tables):
    return _diff(t).withColumn("fields", F.array_join("fields", ","))


@query("crawl_change_alert", "O8", _DIFF + " SELECT count(*)::BIGINT AS changes, 'crawl' AS alert FROM d WHERE kind <> 'changed' OR fields <> '' HAVING count(*) >= 10")
def _(t: Tables):
    return ops.change_alert(_diff(t), 10, "crawl")


@query("diff_key_collisions", "C14", "SELECT regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://[^/]+', '') AS key, count(DISTINCT url)::BIGINT AS urls, min(url) AS first_url FROM pages GROUP BY 1 HAVING count(DISTINCT url) > 1")
def _(t: Tables):
    from pagewright.functions import urls

    return ops.key_collisions(t.pages.select("url", urls.parts(F.col("url")).path.alias("key")))


@query("run_term_changes", "C15", """
WITH b AS (SELECT DISTINCT l_suppkey AS page, l_partkey % 300 AS term FROM lineitem WHERE l_suppkey % 9 <> 1), a AS (SELECT DISTINCT l_suppkey AS page, l_partkey % 300 AS term FROM lineitem WHERE l_suppkey % 9 <> 2 AND l_linenumber < 7),
f AS (SELECT coalesce(a.page, b.page) AS page, a.page IS NOT NULL AS n, b.page IS NOT NULL AS o FROM a FULL JOIN b ON a.page = b.page AND a.term = b.term)
SELECT page, CASE WHEN NOT bool_or(o) THEN 'url-added' WHEN NOT bool_or(n) THEN 'url-not-observed' ELSE 'content-terms-changed' END AS code, count(*) FILTER (WHERE NOT o)::BIGINT AS added, count(*) FILTER (WHERE NOT n)::BIGINT AS missing FROM f GROUP BY 1 HAVING NOT bool_and(n AND o)""")
def _(t: Tables):
    row = lambda df: df.select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 300).alias("term"))
    return ops.term_changes(row(t.lineitem.where("l_suppkey % 9 <> 1")), row(t.lineitem.where("l_suppkey % 9 <> 2 AND l_linenumber < 7")))


@query("run_link_changes", "C16", """
WITH b AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 60 AS target FROM lineitem WHERE l_linenumber = 1), a AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 60 AS target FROM lineitem WHERE l_linenumber = 2)
SELECT *, 'added' AS code FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'not-observed' FROM (FROM b EXCEPT FROM a)""")
def _(t: Tables):
    row = lambda n: t.lineitem.where(F.col("l_linenumber") == n).select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 60).alias("target"))
    return ops.edge_changes(row(1), row(2), ["source", "target"])


@query("run_topic_coverage_changes", "C17", """
WITH s AS (SELECT DISTINCT o_custkey % 80 AS topic, o_orderkey AS page FROM orders), o AS (SELECT DISTINCT l_orderkey AS page FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT l_orderkey AS page FROM lineitem WHERE l_returnflag = 'R')
SELECT topic, count(*) FILTER (WHERE page IN (FROM n) AND page NOT IN (FROM o))::BIGINT AS gained, count(*) FILTER (WHERE page IN (FROM o) AND page NOT IN (FROM n))::BIGINT AS lost FROM s GROUP BY 1 HAVING gained + lost > 0""")
def _(t: Tables):
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("page"))
    return ops.topic_coverage_changes(t.orders.select((F.col("o_custkey") % 80).alias("topic"), F.col("o_orderkey").alias("page")), side("A"), side("R"))


@query("run_comparability", "C34", """
WITH r AS (SELECT o_orderkey AS run, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 3 END AS project, o_custkey % 2 AS config, o_orderstatus = 'F' AS cancelled, o_orderkey % 6 = 0 AS truncated FROM orders), p AS (SELECT a.run AS a_run, b.run AS b_run, a.project AS ap, b.project AS bp, a.config <> b.config AS dc, a.cancelled AS ac, b.cancelled AS bc, a.truncated OR b.truncated AS tr FROM r a JOIN r b ON b.run = a.run + 1),
q AS (SELECT *, list_filter([CASE WHEN ap <> bp THEN 'different-project' END, CASE WHEN ap IS NULL OR bp IS NULL THEN 'project-unverified' END, CASE WHEN dc THEN 'different-scope' END, CASE WHEN ac THEN 'baseline-incomplete' END, CASE WHEN bc THEN 'current-incomplete' END], lambda x: x IS NOT NULL) AS r FROM p)
SELECT a_run, b_run, array_to_string(r, ',') AS reasons, CASE WHEN len(r) > 0 THEN 'blocked' WHEN tr THEN 'partial' ELSE 'comparable' END AS status FROM q""")
def _(t: Tables):
    def side(p, shift):
        c = F.col("o_custkey")
        cfg = F.to_json(F.create_map(F.lit("depth"), (c % 2).cast("string")))
        return t.orders.select(
            (F.col("o_orderkey") + shift).alias("j"), F.col("o_orderkey").alias(f"{p}_run"), F.when(c % 10 != 0, c % 3).alias(f"{p}_project"), cfg.alias(f"{p}_config"),
            F.col("o_orderdate").alias(f"{p}_completed"), (F.col("o_orderstatus") == "F").alias(f"{p}_cancelled"), (F.col("o_orderkey") % 6 == 0).alias(f"{p}_truncated"),
        )

    return ops.run_comparability(side("a", 1).join(side("b", 0), "j")).select("a_run", "b_run", F.array_join("reasons", ",").alias("reasons"), "status")


_HIST = "SELECT o_custkey AS project, CASE WHEN o_custkey % 2 = 0 THEN 'p' ELSE 'q' END AS profile, o_orderkey % 2 AS version, o_orderkey AS run, o_orderdate AS ts, CASE WHEN o_orderkey % 13 <> 0 THEN round(o_totalprice / 5003, 1) END AS score FROM orders"


def _hist(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("project"), F.when(F.col("o_custkey") % 2 == 0, "p").otherwise("q").alias("profile"), (k % 2).alias("version"), k.alias("run"), F.col("o_orderdate").alias("at"),
        F.when(k % 13 != 0, F.round(F.col("o_totalprice") / 5003, 1)).alias("score"),
    )


@query("score_trends", "E7", f"""WITH h AS ({_HIST}), l AS (SELECT *, lag(score) OVER w AS previous, lag(run) OVER w AS lr FROM h WINDOW w AS (PARTITION BY project, profile, version ORDER BY ts, run))
SELECT project, run, round(score - previous, 1) AS delta, CASE WHEN lr IS NULL THEN 'first' WHEN previous IS NULL OR score IS NULL THEN 'unavailable' END AS reason FROM l""")
def _(t: Tables):
    return ops.score_trend(_hist(t)).select("project", "run", "delta", "reason")


@query("score_drop_alerts", "E8", f"""WITH h AS ({_HIST}), l AS (SELECT *, lag(score) OVER (PARTITION BY project, profile, version ORDER BY ts, run) AS previous FROM h) SELECT project, run, previous, score, -round(score - previous, 1) AS drop FROM l WHERE -round(score - previous, 1) > 30""")
def _(t: Tables):
    return ops.score_drops(ops.score_trend(_hist(t)), 30).select("project", "run", "previous", "score", "drop")


@query("task_regression_alerts", "E8", """
WITH d AS (SELECT l_suppkey AS project, l_orderkey * 10 + l_linenumber AS task, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'verified' END AS status, round(l_quantity - 25.5, 1) AS delta FROM lineitem)
SELECT project, count(*)::BIGINT AS tasks, arg_min(task, (delta, task)) AS worst_task, min(delta) AS worst FROM d WHERE status = 'failed' AND delta < 0 GROUP BY 1 HAVING -min(delta) >= 5""")
def _(t: Tables):
    d = t.lineitem.select(
        F.col("l_suppkey").alias("project"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("verified").alias("status"), F.round(F.col("l_quantity") - 25.5, 1).alias("delta")
    )
    return ops.task_regressions(d, 5)


@query("task_metric_deltas", "E17", "SELECT o_orderkey AS task, CASE WHEN o_custkey % 3 = 0 THEN 'verified' ELSE 'failed' END AS status, round(o_totalprice / 1000, 1) AS delta FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 <> 2 AND o_custkey % 7 <> 0")
def _(t: Tables):
    k, c = F.col("o_orderkey").alias("task"), F.col("o_custkey")
    before = t.orders.select(k, F.when(F.col("o_orderstatus") == "F", "implemented").otherwise("open").alias("status"))
    after = t.orders.select(k, F.when(c % 3 == 0, "verified").when(c % 3 == 1, "failed").otherwise("implemented").alias("status"), F.when(c % 7 != 0, F.round(F.col("o_totalprice") / 1000, 1)).alias("delta"))
    return ops.metric_deltas(before, after)


@query("history_annotations", "E9", """
WITH h AS (SELECT o_custkey AS project, o_orderkey AS run, o_orderdate AS ts, round(o_totalprice / 5003, 1) AS score, o_orderpriority AS core, o_orderstatus AS cfg FROM orders), l AS (SELECT *, lag(score) OVER w AS ps, lag(core) OVER w AS pc, lag(cfg) OVER w AS pf FROM h WINDOW w AS (PARTITION BY project ORDER BY ts, run))
SELECT project, run, round(score - ps, 1) AS delta, unnest(list_filter([CASE WHEN ps - score >= 5 THEN 'score-drop' END, CASE WHEN pc <> core THEN 'core-topic-changed' END, CASE WHEN pf <> cfg THEN 'configuration-break' END], lambda x: x IS NOT NULL)) AS code FROM l""")
def _(t: Tables):
    h = t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("at"), F.round(F.col("o_totalprice") / 5003, 1).alias("score"), F.col("o_orderpriority").alias("core"), F.col("o_orderstatus").alias("config"))
    return ops.history_annotations(h)


@query("top_set_changes", "G2", """
WITH b AS (SELECT DISTINCT l_suppkey AS q, l_partkey % 150 AS u FROM lineitem WHERE l_linenumber % 2 = 1), a AS (SELECT DISTINCT l_suppkey AS q, l_partkey % 150 AS u FROM lineitem WHERE l_linenumber % 2 = 0), f AS (SELECT coalesce(a.q, b.q) AS query, a.u IS NULL AS gone, b.u IS NULL AS fresh FROM a FULL JOIN b ON a.q = b.q AND a.u = b.u)
SELECT query, count(*) FILTER (WHERE fresh)::BIGINT AS added, count(*) FILTER (WHERE gone)::BIGINT AS removed FROM f GROUP BY 1""")
def _(t: Tables):
    row = lambda n: t.lineitem.where(F.col("l_linenumber") % 2 == n).select(F.col("l_suppkey").alias("query"), (F.col("l_partkey") % 150).alias("url"))
    return ops.set_change(row(1), row(0), ["query"], "url")


@query("entity_changes", "G3", """
WITH w AS MATERIALIZED (SELECT source, doc_id, unnest(regexp_extract_all(text, '([\\p{L}]{5,})', 1)) AS entity FROM documents), b AS MATERIALIZED (SELECT source, replace(strip_accents(lower(entity)), 'ß', 'ss') AS k, max(entity) AS entity FROM w WHERE doc_id % 2 = 0 GROUP BY 1, 2), a AS MATERIALIZED (SELECT source, replace(strip_accents(lower(entity)), 'ß', 'ss') AS k, max(entity) AS entity FROM w WHERE doc_id % 2 = 1 GROUP BY 1, 2)
SELECT a.source, a.entity, 'new' AS code FROM a LEFT JOIN b USING (source, k) WHERE b.entity IS NULL UNION ALL SELECT b.source, b.entity, 'lost' FROM b LEFT JOIN a USING (source, k) WHERE a.entity IS NULL""")
def _(t: Tables):
    w = t.documents.select("source", "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]{5,})"), F.lit(1))).alias("entity"))
    return ops.entity_changes(w.where("doc_id % 2 = 0"), w.where("doc_id % 2 = 1"), ["source"])


@query("decay_states", "E10", """
WITH h AS (SELECT o_custkey AS query, o_orderkey AS ts, (o_totalprice % 100) / 500 AS shift, o_orderkey % 5 AS ent, o_orderpriority AS intent FROM orders), f AS (SELECT query, count(*) AS samples, arg_min(intent, ts) AS fi FROM h GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ts DESC) AS r FROM h), m AS (SELECT l.query, samples, r, array_to_string(list_filter([CASE WHEN shift >= 0.1 THEN 'centroid' END, CASE WHEN ent >= 3 THEN 'entities' END, CASE WHEN intent <> fi THEN 'intent' END], lambda x: x IS NOT NULL), '+') AS re FROM l JOIN f USING (query) WHERE r <= 2)
SELECT query, samples::BIGINT AS samples, max(re) FILTER (WHERE r = 1) AS reasons, CASE WHEN samples < 3 THEN 'too-few-samples' WHEN max(re) FILTER (WHERE r = 1) = '' THEN 'stable' WHEN NOT bool_and(re <> '') THEN 'not-persistent' ELSE 'alert' END AS state FROM m GROUP BY m.query, m.samples""")
def _(t: Tables):
    h = t.orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("at"), ((F.col("o_totalprice") % 100) / 500).alias("shift"), (F.col("o_orderkey") % 5).alias("entity_changes"), F.col("o_orderpriority").alias("intent"), F.lit("list").alias("format"))
    return ops.decay_states(h)


@query("speed_regressions", "O7", """
WITH c AS (SELECT o_custkey AS url, o_orderdate AS ts, min(o_totalprice / 4999.7) AS perf, max(o_totalprice / 101.3) AS lcp FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(ts) OVER w AS pt, lag(perf) OVER w AS pp, lag(lcp) OVER w AS pl FROM c WINDOW w AS (PARTITION BY url ORDER BY ts)),
x AS (SELECT * FROM l WHERE date_diff('day', pt, ts) BETWEEN 1 AND 200)
SELECT url, 'performance' AS metric, round(perf - pp, 4) AS delta FROM x WHERE perf - pp <= -5 UNION ALL SELECT url, 'lcp_ms', round(lcp - pl, 4) FROM x WHERE lcp > pl * 1.2""")
def _(t: Tables):
    c = t.orders.groupBy(F.col("o_custkey").alias("url"), F.col("o_orderdate").alias("at")).agg(F.min(F.col("o_totalprice") / 4999.7).alias("performance"), F.max(F.col("o_totalprice") / 101.3).alias("lcp_ms"))
    c = c.withColumns({"strategy": F.lit("mobile"), "scope": F.lit("url"), "tbt_ms": F.lit(10.0)})
    return ops.speed_regressions(c, max_days=200).select("url", "metric", F.round("delta", 4).alias("delta"))


@query("authority_alerts", "O9", """
WITH r AS (SELECT o_custkey % 60 AS project, CAST(o_orderdate AS DATE) AS d, max(o_totalprice / 5003) AS score FROM orders GROUP BY 1, 2), a AS (SELECT *, lag(score) OVER (PARTITION BY project ORDER BY d) AS b FROM r),
c AS (SELECT o_custkey % 60 AS project, o_orderpriority AS pillar, o_orderstatus AS domain, CAST(o_orderdate AS DATE) AS d, max(o_totalprice / 5003) AS cov FROM orders GROUP BY 1, 2, 3, 4), e AS (SELECT *, lag(cov) OVER (PARTITION BY project, pillar, domain ORDER BY d) AS b FROM c)
SELECT project, 'score-drop' AS code, '' AS detail, round(score - b, 1) AS delta FROM a WHERE b - score > 60 UNION ALL SELECT project, 'competitor-expansion', pillar || '/' || domain, round(cov - b, 1) FROM e WHERE cov - b >= 70""")
def _(t: Tables):
    p, d, v = (F.col("o_custkey") % 60).alias("project"), F.to_date("o_orderdate").alias("at"), F.max(F.col("o_totalprice") / 5003)
    reports = t.orders.groupBy(p, d).agg(v.alias("score"))
    comp = t.orders.groupBy(p, F.col("o_orderpriority").alias("pillar"), F.col("o_orderstatus").alias("domain"), d).agg(v.alias("coverage"))
    return ops.authority_alerts(reports, comp, 60, 70).drop("at")


@query("alert_fingerprints", "I6", """
SELECT event_type || '|u' || (user_id % 20) || '|a=' || (event_id % 3) || '&k=x' AS fingerprint, min(ts) AS first_at, count(*)::BIGINT AS repeats FROM events GROUP BY event_type, user_id % 20, event_id % 3, ts::DATE""")
def _(t: Tables):
    alerts = t.events.select(
        F.col("event_type").alias("type"), F.concat(F.lit(" u"), F.col("user_id") % 20, F.lit(" ")).alias("source"), F.create_map(F.lit("k"), F.lit("x"), F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("evidence"), F.col("event_id").alias("run"), F.col("ts").alias("at")
    )
    return ops.alert_fingerprints(alerts, "daily").drop("part")


@query("task_verification", "C32", """
WITH t AS (SELECT p_partkey AS task, CASE p_partkey % 5 WHEN 0 THEN 'add-link' WHEN 1 THEN 'redirect' WHEN 2 THEN 'remove' WHEN 3 THEN 'entities' ELSE 'index' END AS type, p_partkey % 130 AS url, p_partkey % 7 AS target FROM part),
p AS (SELECT s_suppkey AS url, CASE s_suppkey % 6 WHEN 0 THEN 301 WHEN 1 THEN 410 WHEN 2 THEN 0 ELSE 200 END AS st, s_suppkey % 7 AS rt, s_suppkey % 4 = 0 AS tr, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 10) / 10.0 END AS es, s_suppkey % 8 = 3 AS ok FROM supplier), l AS (SELECT DISTINCT l_suppkey AS url, l_partkey % 50 AS target FROM lineitem)
SELECT task, type, CASE WHEN p.url IS NULL OR st = 0 THEN 'unknown' WHEN type = 'add-link' THEN CASE WHEN l.url IS NOT NULL THEN 'done' WHEN tr THEN 'unknown' ELSE 'open' END WHEN type = 'redirect' THEN CASE WHEN st = 301 AND rt = t.target THEN 'done' ELSE 'open' END
 WHEN type = 'remove' THEN CASE WHEN st = 410 THEN 'done' ELSE 'open' END WHEN type = 'entities' THEN CASE WHEN es IS NULL THEN 'unknown' WHEN es >= 0.5 THEN 'done' ELSE 'open' END ELSE CASE WHEN ok THEN 'done' ELSE 'open' END END AS result
FROM t LEFT JOIN p ON p.url = t.url LEFT JOIN l ON l.url = t.url AND l.target = t.target""")
def _(t: Tables):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "add-link").when(k % 5 == 1, "redirect").when(k % 5 == 2, "remove").when(k % 5 == 3, "entities").otherwise("index")
    tasks = t.part.select(k.alias("task"), kind.alias("type"), (k % 130).alias("url"), (k % 7).alias("target"))
    pages = t.supplier.select(
        s.alias("url"), F.when(s % 6 == 0, 301).when(s % 6 == 1, 410).when(s % 6 == 2, 0).otherwise(200).alias("http_status"), (s % 7).alias("redirect_target"), (s % 4 == 0).alias("truncated"),
        F.when(s % 8 == 3, "indexable").otherwise("noindex").alias("index_state"), F.when(s % 5 != 0, (s % 10) / 10.0).alias("entity_share"),
    )
    links = t.lineitem.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"))
    return ops.verify_tasks(tasks, pages, links)
