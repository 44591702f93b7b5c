"""Link-graph analytics over edges taken from order lines and page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import backlinks, graph as ops
from pagewright.plans.inputs import cte
from pagewright.plans.registry import Tables, query
from pagewright.session import cut_lineage

#: Rules of the rank queries: ranks settle to more digits than are compared.
_RULES = ops.RankRules(tolerance=1e-10)


def _rank_sql(edges: str, p: str = "", nodes: str = "SELECT site_id, source AS node FROM e{p} UNION SELECT site_id, target FROM e{p}") -> dict[str, str]:
    """Ranks as the sum of 100 passes along the links, made to sum to 1."""
    return {
        f"e{p}": edges, f"w{p}": f"SELECT site_id, source, target, sum(weight) AS weight FROM e{p} GROUP BY ALL",
        f"nodes{p}": nodes.format(p=p), f"n{p}": f"SELECT site_id, count(*) AS n FROM nodes{p} GROUP BY 1",
        f"sh{p}": f"SELECT site_id, source, target, weight / sum(weight) OVER (PARTITION BY site_id, source) AS share FROM w{p}",
        f"t{p}(site_id, node, k, v)": f"SELECT site_id, node, 0, 1.0::DOUBLE / n FROM nodes{p} JOIN n{p} USING (site_id) UNION ALL "
        f"SELECT s.site_id, s.target, k + 1, sum(0.85 * v * share) FROM t{p} t JOIN sh{p} s ON s.site_id = t.site_id AND s.source = t.node WHERE k < 100 GROUP BY s.site_id, s.target, k",
        f"r{p}": f"SELECT site_id, node, x / sum(x) OVER (PARTITION BY site_id) AS rank FROM (SELECT site_id, node, sum(v) AS x FROM t{p} GROUP BY 1, 2)",
    }


def _loops(**bodies: str) -> str:
    return cte(**bodies).replace("WITH ", "WITH RECURSIVE ", 1)


_W = "SELECT 's' || (l_suppkey % 7) AS site_id, 'n' || l_suppkey AS source, 'n' || (l_partkey % 397) AS target, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2, 3"


def _weighted(t: Tables):
    key = lambda c: F.concat(F.lit("n"), c)
    return t.lineitem.groupBy(
        F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("site_id"), key(F.col("l_suppkey")).alias("source"), key(F.col("l_partkey") % 397).alias("target")
    ).agg(F.count("*").cast("double").alias("weight"))


def _nodes(edges):
    return edges.select("site_id", F.col("source").alias("node")).union(edges.select("site_id", F.col("target").alias("node"))).distinct()


@query("weighted_page_rank", "K1", _loops(**_rank_sql(_W)) + "SELECT site_id, node, round(rank, 9) AS rank, true AS converged FROM r")
def _(t: Tables):
    e = _weighted(t)
    return ops.page_rank(_nodes(e), e, _RULES).select("site_id", "node", F.round("rank", 9).alias("rank"), "converged")


_SIM = """SELECT site_id, source, target, weight, CASE WHEN hash_s % 3 <> 0 THEN hash_t % 20 / 20.0 END AS similarity, CASE WHEN hash_s % 4 = 1 THEN hash_t % 10 / 10.0 END AS context_similarity
FROM (SELECT *, CAST(substr(source, 2) AS INTEGER) AS hash_s, CAST(substr(target, 2) AS INTEGER) AS hash_t FROM b) WHERE source <> target"""
_SIMW = "SELECT site_id, source, target, weight * CASE WHEN similarity IS NOT NULL THEN greatest(0.05, similarity) ELSE 1 END * CASE WHEN context_similarity IS NOT NULL THEN greatest(0.05, context_similarity) ELSE 1 END AS weight FROM m"


def _similar(t: Tables):
    num = lambda c: F.substring(c, 2, 10).cast("int")
    e = _weighted(t)
    return e.withColumn("similarity", F.when(num("source") % 3 != 0, num("target") % 20 / 20.0)).withColumn("context_similarity", F.when(num("source") % 4 == 1, num("target") % 10 / 10.0))


def _report_sql(base: str, p: str) -> dict[str, str]:
    """The report over the edge table ``base``."""
    nodes = f"SELECT site_id, source AS node FROM {base} UNION SELECT site_id, target FROM {base}"
    return {
        f"m{p}": _SIM.replace("FROM b)", f"FROM {base})"), **_rank_sql(_SIMW.replace("FROM m", f"FROM m{p}"), p, nodes),
        f"o{p}": f"SELECT site_id, source AS node, count(*) AS out_degree, sum(weight) AS total, sum(CASE WHEN similarity < 0.05 THEN weight ELSE 0 END) AS leaking FROM m{p} GROUP BY 1, 2",
        f"i{p}": f"SELECT site_id, target AS node, count(DISTINCT source) AS in_degree FROM m{p} GROUP BY 1, 2",
        f"report{p}": f"""SELECT r.site_id, r.node, r.rank, max(r.rank) OVER (PARTITION BY r.site_id) AS top, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(out_degree, 0)::BIGINT AS out_degree,
 out_degree IS NULL AS dead_end, r.rank < 0.5 / n.n AS under_linked, coalesce(leaking / total >= 0.5, false) AS leak FROM r{p} r JOIN n{p} n USING (site_id) LEFT JOIN o{p} USING (site_id, node) LEFT JOIN i{p} USING (site_id, node)""",
    }


@query("link_rank_report", "K2 J2", _loops(b=_W, **_report_sql("b", "0")) + "SELECT * EXCLUDE (rank, top), floor(rank / top * 1000 + 0.5) / 10 AS score FROM report0")
def _(t: Tables):
    e = _similar(t)
    return ops.link_rank_report(_nodes(e), e, _RULES).drop("rank")


@query("rank_change", "K5", _loops(b=_W, b2="SELECT * FROM b WHERE target NOT IN ('n0', 'n50') AND source <> 'n3'", **_report_sql("b", "0"), **_report_sql("b2", "1"),
 z="SELECT site_id, max(rank) AS top FROM report0 GROUP BY 1") + """
SELECT site_id, node, s0 AS before, s1 AS after, round(s1 - s0, 1) AS delta,
 array_to_string(list_filter([CASE WHEN x.dead_end <> y.dead_end THEN if(y.dead_end, '+', '-') || 'dead_end' END, CASE WHEN x.under_linked <> y.under_linked THEN if(y.under_linked, '+', '-') || 'under_linked' END,
  CASE WHEN x.leak <> y.leak THEN if(y.leak, '+', '-') || 'leak' END], lambda f: f IS NOT NULL), ',') AS flag_changes
FROM (SELECT *, floor(rank / top * 1000 + 0.5) / 10 AS s0 FROM report0) x FULL JOIN (SELECT report1.*, floor(rank / z.top * 1000 + 0.5) / 10 AS s1 FROM report1 JOIN z USING (site_id)) y USING (site_id, node)""")
def _(t: Tables):
    # The later graph lacks the links to two pages and those of one source.
    e = _similar(t)
    after = e.where("target NOT IN ('n0', 'n50') AND source <> 'n3'")
    first = cut_lineage(ops.link_rank_report(_nodes(e), e, _RULES))
    second = ops.link_rank_report(_nodes(after), after, _RULES, start=first)
    return ops.rank_change(first, second).withColumn("flag_changes", F.array_join("flag_changes", ","))


@query("zone_weighted_edges", "K3", """
SELECT 's' || (l_suppkey % 7) AS site_id, 'n' || l_suppkey AS source, 'n' || (l_partkey % 397) AS target, count(*)::BIGINT AS links,
 round(sum(CASE l_linenumber WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.35 WHEN 4 THEN 0.25 WHEN 5 THEN 0.05 ELSE 1.0 END)::DOUBLE, 6) AS weight, count(*) FILTER (WHERE l_linenumber NOT BETWEEN 1 AND 5)::BIGINT AS unweighted_links
FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey <> l_partkey % 397 GROUP BY 1, 2, 3""")
def _(t: Tables):
    ln = F.col("l_linenumber")
    zone = F.when(ln == 1, "above_fold").when(ln == 2, "below_fold").when(ln == 3, "widget").when(ln == 4, "nav_breadcrumb").when(ln == 5, "sidebar_footer").when(ln == 6, "main")
    key = lambda c: F.concat(F.lit("n"), c)
    links = t.lineitem.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("site_id"), key(F.col("l_suppkey")).alias("source"), key(F.col("l_partkey") % 397).alias("target"), zone.alias("zone"),
        F.when(F.col("l_returnflag") == "R", "external NoFollow").alias("rel"),
    )
    return ops.zone_edges(links).withColumn("weight", F.round("weight", 6))


_CTX = """SELECT c.conv_id, c.turn, list_distinct(regexp_extract_all(lower(c.text || ' ' || n.text), '([\\p{L}\\p{N}]+)', 1)) AS w, list_distinct(regexp_extract_all(lower(b.text), '([\\p{L}\\p{N}]+)', 1)) AS k
FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 JOIN benchmark b ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark)"""


@query("link_context_similarity", "K4", cte(x=_CTX) + "SELECT conv_id, turn, round(len(list_intersect(w, k)) / sqrt(len(w) * len(k)), 6) AS context_similarity FROM x WHERE len(w) > 0 AND len(k) > 0")
def _(t: Tables):
    from pagewright.functions import text

    c = t.conversations.select("conv_id", "turn", F.col("text").alias("before"))
    nxt = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("anchor"))
    topic = t.benchmark.select("item_id", F.array_distinct(text.words(F.col("text"))).alias("target_terms"))
    rows = c.join(nxt, ["conv_id", "turn"]).join(topic, F.col("conv_id") % t.benchmark.agg(F.count("*")).scalar() == F.col("item_id")).withColumn("after", F.lit(None).cast("string"))
    return ops.context_similarity(rows).select("conv_id", "turn", F.round("context_similarity", 6).alias("context_similarity"))


_PAIRS = "SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + o_orderkey % 3) % 4000 AS b FROM orders"


@query("connected_groups", "K7", _loops(x=f"SELECT a, b FROM ({_PAIRS}) UNION SELECT b, a FROM ({_PAIRS})", **{"r(node, k, seen)": """SELECT DISTINCT a, 0, a FROM x
  UNION ALL SELECT node, k + 1, min(least(seen, coalesce(other, seen))) FROM (SELECT r.node, r.k, r.seen, o.seen AS other FROM r LEFT JOIN x ON x.a = r.node LEFT JOIN r o ON o.node = x.b) WHERE k < 60 GROUP BY node, k"""}) + """
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def _(t: Tables):
    a = F.col("o_custkey")
    pairs = t.orders.select(a.alias("a"), ((a * 7 + F.col("o_orderkey") % 3) % 4000).alias("b")).distinct()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    return ops.components(nodes, pairs)


_ALT = "SELECT DISTINCT l_suppkey AS s, CASE l_linenumber WHEN 1 THEN 'en' WHEN 2 THEN 'x-default' WHEN 3 THEN 'en_GB' WHEN 4 THEN 'de' ELSE 'pl-PL' END AS language, (l_suppkey + l_linenumber * 20 * (l_suppkey % 2)) % 140 AS t FROM lineitem"


@query("alternate_clusters", "K8", cte(a=_ALT, p="SELECT DISTINCT s FROM a",
 k="SELECT s, bool_or(language = 'x-default') AS d, bool_or(s = t) AS o, count(*) FILTER (WHERE language = 'en_GB') AS iv, count(*) FILTER (WHERE t % 10 = 3) AS na, count(*) FILTER (WHERE t >= 100) AS nc FROM a GROUP BY 1") + """
SELECT 'p' || s AS node, array_to_string(list_filter([CASE WHEN NOT d THEN 'missing-x-default' END, CASE WHEN NOT o THEN 'missing-self' END, CASE WHEN iv > 0 THEN 'invalid-code' END, CASE WHEN na > 0 THEN 'missing-reciprocal' END, CASE WHEN nc > 0 THEN 'target-not-crawled' END], lambda x: x IS NOT NULL), ',') AS codes FROM k""")
def _(t: Tables):
    s, ln = F.col("l_suppkey"), F.col("l_linenumber")
    target = (s + ln * 20 * (s % 2)) % 140
    lang = F.when(ln == 1, "en").when(ln == 2, "x-default").when(ln == 3, "en_GB").when(ln == 4, "de").otherwise("pl-PL")
    alt = t.lineitem.select(F.concat(F.lit("p"), s).alias("source"), lang.alias("language"), F.concat(F.lit("p"), target).alias("target"), F.when(target < 100, target % 10 != 3).alias("reciprocal")).distinct()
    pages = t.supplier.select(F.concat(F.lit("p"), F.col("s_suppkey")).alias("url"))
    return ops.alternate_clusters(pages, alt).select("node", F.array_join("codes", ",").alias("codes"))


# Documents of a site: suppliers are hubs, parts content; order lines link them, part types are topics.
_DOCS = "SELECT 'h' || s_suppkey AS doc, 'hub' AS role, s_suppkey % 4 AS section, s_suppkey % 3 AS depth FROM supplier UNION ALL SELECT 'c' || p_partkey, 'content', p_partkey % 5, 2 FROM part"
_DLINKS = "SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'h' || l_suppkey ELSE 'c' || l_partkey END AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'c' || l_partkey ELSE 'h' || (l_suppkey % 9) END AS target FROM lineitem"
_AREAS = """SELECT d.doc, d.section, arg_min(h.doc, (m.members, -h.depth, h.doc)) AS hub FROM docs d LEFT JOIN dl ON dl.target = d.doc LEFT JOIN docs h ON h.doc = dl.source AND h.role = 'hub' AND h.section = d.section
LEFT JOIN m ON m.doc = h.doc WHERE d.role = 'content' GROUP BY 1, 2"""
_MEM = "SELECT h.doc, count(*) AS members FROM docs h JOIN dl ON dl.source = h.doc JOIN docs c ON c.doc = dl.target AND c.role = 'content' AND c.section = h.section WHERE h.role = 'hub' GROUP BY 1"
_SITE = dict(docs=_DOCS, dl=_DLINKS, m=_MEM, areas=_AREAS, topics="SELECT 'c' || p_partkey AS doc, p_type || '-' || (p_size % 10) AS topic FROM part")


def _site(t: Tables):
    hub = t.supplier.select(F.concat(F.lit("h"), "s_suppkey").alias("doc"), F.lit("hub").alias("role"), (F.col("s_suppkey") % 4).alias("section"), (F.col("s_suppkey") % 3).alias("depth"))
    content = t.part.select(F.concat(F.lit("c"), "p_partkey").alias("doc"), F.lit("content").alias("role"), (F.col("p_partkey") % 5).alias("section"), F.lit(2).cast("long").alias("depth"))
    even = F.col("l_linenumber") % 2 == 0
    links = t.lineitem.select(
        F.when(even, F.concat(F.lit("h"), "l_suppkey")).otherwise(F.concat(F.lit("c"), "l_partkey")).alias("source"),
        F.when(even, F.concat(F.lit("c"), "l_partkey")).otherwise(F.concat(F.lit("h"), F.col("l_suppkey") % 9)).alias("target"),
    ).distinct()
    topics = t.part.select(F.concat(F.lit("c"), "p_partkey").alias("doc"), F.concat_ws("-", "p_type", (F.col("p_size") % 10).cast("string")).alias("topic"))
    return hub.unionByName(content), links, topics


@query("hub_areas", "K9", cte(**_SITE) + "SELECT doc, section, hub FROM areas")
def _(t: Tables):
    docs, links, _ = _site(t)
    return ops.hub_areas(docs, links)


@query("hub_verdicts", "K10", cte(**_SITE, nb="SELECT hub, doc FROM areas WHERE hub IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dl WHERE dl.source = areas.doc AND dl.target = areas.hub)",
 ul="SELECT DISTINCT a.hub, d.doc FROM areas a JOIN topics x ON x.doc = a.doc JOIN topics y ON y.topic = x.topic JOIN areas d ON d.doc = y.doc AND d.section = a.section WHERE a.hub IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dl WHERE dl.source = a.hub AND dl.target = d.doc)") + """
SELECT hub, doc, 'hub-missing-backlink' AS code FROM nb UNION ALL SELECT hub, doc, 'hub-missing-member-link' FROM ul UNION ALL SELECT DISTINCT hub, NULL, 'area-healthy' FROM areas WHERE hub IS NOT NULL AND hub NOT IN (SELECT hub FROM nb UNION SELECT hub FROM ul)""")
def _(t: Tables):
    docs, links, topics = _site(t)
    return ops.hub_verdicts(ops.hub_areas(docs, links), links, topics)


@query("topic_verdicts", "K11", cte(**_SITE, tl="SELECT DISTINCT 'c' || p_partkey AS source, 'c' || ((p_partkey * 31 + p_size) % 2000) AS target FROM part UNION SELECT DISTINCT 'c' || l_partkey, 'c' || (l_orderkey % 2000) FROM lineitem",
 ins="SELECT DISTINCT x.topic, least(source, target) AS a, greatest(source, target) AS b FROM tl JOIN topics x ON x.doc = source JOIN topics y ON y.doc = target AND y.topic = x.topic WHERE source <> target",
 rc="SELECT topic, max(n) AS w FROM (SELECT x.topic, source, count(DISTINCT target) AS n FROM tl JOIN topics x ON x.doc = source JOIN topics y ON y.doc = target AND y.topic = x.topic WHERE source <> target GROUP BY 1, 2) GROUP BY 1",
 g="SELECT topic, count(*) AS members, count(DISTINCT hub) AS areas, count(*) FILTER (WHERE hub IS NULL) AS wh FROM topics LEFT JOIN areas USING (doc) GROUP BY 1",
 f="SELECT topic, members, members * (members - 1) // 2 - (SELECT count(*) FROM ins WHERE ins.topic = g.topic) AS un, areas, wh, coalesce((SELECT w FROM rc WHERE rc.topic = g.topic), 0) AS w FROM g") + """
SELECT topic, members::BIGINT AS members, un::BIGINT AS unlinked_pairs, array_to_string(list_filter([CASE WHEN (areas >= 2 OR wh > 0) AND w < members - 1 THEN 'topic-no-hub' END, CASE WHEN un > 0 THEN 'topic-members-unlinked' END, CASE WHEN members = 2 THEN 'topic-thin' END], lambda x: x IS NOT NULL), ',') AS codes FROM f""")
def _(t: Tables):
    docs, links, topics = _site(t)
    c = lambda x: F.concat(F.lit("c"), x)
    inner = t.part.select(c(F.col("p_partkey")).alias("source"), c((F.col("p_partkey") * 31 + F.col("p_size")) % 2000).alias("target")).union(
        t.lineitem.select(c(F.col("l_partkey")), c(F.col("l_orderkey") % 2000))
    )
    return ops.topic_verdicts(topics, inner, ops.hub_areas(docs, links)).withColumn("codes", F.array_join("codes", ","))


@query("document_verdicts", "K12", cte(**_SITE, x="SELECT d.doc, count(s.doc) AS n, bool_and(s.role = 'hub') AS h FROM docs d LEFT JOIN dl ON dl.target = d.doc AND dl.source <> d.doc LEFT JOIN docs s ON s.doc = dl.source WHERE d.role = 'content' GROUP BY 1") +
"SELECT doc, CASE WHEN n = 0 THEN 'orphan' ELSE 'isolated' END AS code FROM x WHERE n = 0 OR h")
def _(t: Tables):
    docs, links, _ = _site(t)
    return ops.document_verdicts(docs, links)


@query("silo_connectivity", "K13", """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 100 AS t FROM lineitem WHERE l_suppkey <> l_partkey % 100),
ib AS (SELECT t AS page, count(*) AS n FROM e GROUP BY 1), mem AS (SELECT s_suppkey % 12 AS g, s_suppkey AS page, s_acctbal AS rel, coalesce(n, 0) AS n FROM supplier LEFT JOIN ib ON ib.page = s_suppkey),
pl AS (SELECT g, arg_min(page, (-n, -rel, page)) AS pillar, count(*) - 1 AS sat FROM mem GROUP BY 1),
x AS (SELECT m.g, m.page, pillar, sat, EXISTS (SELECT 1 FROM e WHERE s = m.page AND t = pillar)::INT AS tp, EXISTS (SELECT 1 FROM e WHERE s = pillar AND t = m.page)::INT AS fp,
 (SELECT count(*) FROM e JOIN mem k ON k.page = e.t AND k.g = m.g WHERE e.s = m.page AND e.t <> pillar) AS peers FROM mem m JOIN pl USING (g) WHERE m.page <> pillar)
SELECT g AS "group", pillar, round(avg(CASE WHEN sat > 1 THEN 0.5 * tp + 0.3 * fp + 0.2 * least(1, peers / least(2, sat - 1)) ELSE (0.5 * tp + 0.3 * fp) / 0.8 END), 6) AS connectivity, count(*)::BIGINT AS satellites FROM x GROUP BY 1, 2""")
def _(t: Tables):
    members = t.supplier.select((F.col("s_suppkey") % 12).alias("group"), F.col("s_suppkey").alias("page"), F.col("s_acctbal").alias("relevance"))
    links = t.lineitem.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100).alias("target"))
    return ops.silo_audit(members, links).withColumn("connectivity", F.round("connectivity", 6))


@query("funnel_transitions", "K15 D24", """
WITH st AS (SELECT s_suppkey AS page, CASE s_nationkey % 4 WHEN 0 THEN 'awareness' WHEN 1 THEN 'consideration' WHEN 2 THEN 'decision' END AS stage FROM supplier)
SELECT a.stage AS from_stage, b.stage AS to_stage, count(*)::BIGINT AS links FROM lineitem JOIN st a ON a.page = l_suppkey JOIN st b ON b.page = l_partkey % 130 WHERE a.stage IS NOT NULL AND b.stage IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables):
    k = F.col("s_nationkey") % 4
    stages = t.supplier.select(F.col("s_suppkey").alias("page"), F.when(k == 0, "awareness").when(k == 1, "consideration").when(k == 2, "decision").alias("stage")).where("stage IS NOT NULL")
    return ops.funnel_transitions(stages, t.lineitem.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 130).alias("target")))


@query("structured_data_islands", "K14", """
WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS id FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS a, (l_linenumber + l_partkey) % 7 + 1 AS b FROM lineitem),
q AS (SELECT page, a, b FROM p SEMI JOIN n ON n.page = p.page AND n.id = p.b), x AS (SELECT page, a, b FROM q UNION SELECT page, b, a FROM q),
r(page, id, seen) AS (SELECT page, id, id FROM n UNION SELECT r.page, r.id, x.b FROM r JOIN x ON x.page = r.page AND x.a = r.seen), c AS (SELECT page, id, min(seen) AS m FROM r GROUP BY 1, 2)
SELECT 'o' || page AS page, count(DISTINCT m)::BIGINT AS islands, count(*)::BIGINT AS nodes FROM c GROUP BY 1""")
def _(t: Tables):
    page = F.concat(F.lit("o"), F.col("l_orderkey"))
    nodes = t.lineitem.select(page.alias("page"), F.col("l_linenumber").cast("string").alias("id")).distinct()
    refs = t.lineitem.select(page.alias("page"), F.col("l_linenumber").cast("string").alias("a"), ((F.col("l_linenumber") + F.col("l_partkey")) % 7 + 1).cast("string").alias("b")).distinct()
    return ops.page_islands(nodes, refs)


@query("entity_evidence_edges", "K16", """
WITH f AS (SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1), lambda x: replace(strip_accents(x), 'ß', 'ss')))) AS k FROM benchmark),
w AS (SELECT item_id, k FROM f WHERE length(regexp_replace(k, '[^\\p{L}]', '', 'g')) >= 2 AND k NOT IN ('a','about','after','all','also','an','and','any','are','as','at','be','because','been','before','but','by','can','could','do','for','from','had','has','have','he','her','his','how','if','in','into','is','it','its','more','most','no','not','of','on','one','only','or','other','our','out','over','she','so','some','such','than','that','the','their','them','then','there','these','they','this','those','to','under','up','was','we','were','what','when','where','which','while','who','will','with','would','you','your')), n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS k FROM documents)
SELECT item_id AS fact, doc_id AS page, round(count(*) / max(n), 6) AS share, count(*) = max(n) AS observed FROM w JOIN n USING (item_id) JOIN d USING (k) GROUP BY 1, 2 HAVING count(*) / max(n) >= 0.25""")
def _(t: Tables):
    from pagewright.functions import text

    facts = t.benchmark.select(F.col("item_id").alias("fact"), "text", F.lit("").alias("lang"))
    terms = t.documents.select(F.col("doc_id").alias("page"), F.explode(text.words(F.col("text"))).alias("term"))
    return ops.entity_evidence(facts, terms).withColumn("share", F.round("share", 6))


_BL = """SELECT 'https://w' || (l_suppkey % 50) || '.d' || (l_suppkey % 80) || '.example/p' || (l_orderkey % 11) AS source_url, 'd' || (l_suppkey % 80) || '.example' AS domain, 'https://own.example/' || (l_partkey % 90) AS target_url, CASE WHEN l_suppkey % 3 = 0 THEN 'Brand ' ELSE 'a' || (l_partkey % 9) END AS anchor_text, l_tax > 0.02 AS follow FROM lineitem"""


def _backlinks(t: Tables):
    s = F.col("l_suppkey")
    return t.lineitem.select(
        F.concat(F.lit("https://w"), s % 50, F.lit(".d"), s % 80, F.lit(".example/p"), F.col("l_orderkey") % 11).alias("source_url"), F.concat(F.lit("https://own.example/"), F.col("l_partkey") % 90).alias("target_url"),
        F.when(s % 3 == 0, "Brand ").otherwise(F.concat(F.lit("a"), F.col("l_partkey") % 9)).alias("anchor_text"), (F.col("l_tax") > 0.02).alias("is_dofollow"),
    )


@query("link_profile_domains", "D12 A12", cte(b=_BL) + """
SELECT domain, count(*)::BIGINT AS links, count(*) FILTER (WHERE follow)::BIGINT AS follow, count(*) FILTER (WHERE NOT follow)::BIGINT AS nofollow, count(DISTINCT source_url)::BIGINT AS pages, count(DISTINCT target_url)::BIGINT AS targets, count(DISTINCT lower(trim(anchor_text)))::BIGINT AS anchors,
 CASE WHEN count(DISTINCT source_url) >= 5 AND count(DISTINCT lower(trim(anchor_text))) <= 2 THEN 'sitewide' WHEN count(*) > 1 THEN 'repeated' ELSE 'single' END AS pattern FROM b GROUP BY 1""")
def _(t: Tables):
    return backlinks.link_profile(_backlinks(t))


@query("referring_domain_counts", "D13", cte(b=_BL) + "SELECT target_url AS url_key, count(DISTINCT split_part(source_url, '/', 3))::BIGINT AS domains FROM b GROUP BY 1")
def _(t: Tables):
    return backlinks.referring_domains(_backlinks(t))


_GAP = "SELECT c_custkey AS d, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS own, c_acctbal / 100 AS spam FROM customer"


@query("backlink_gap_targets", "C27 A12", cte(g=_GAP) + """
SELECT 'r' || d AS referring_domain, count(DISTINCT o_orderkey % 6)::BIGINT AS competitors, sum(o_orderkey % 5)::BIGINT AS links, round(count(DISTINCT o_orderkey % 6) / 6, 6) AS relevance, round(least(1, max(o_totalprice / 4999.7) / 100), 6) AS authority,
 round(0.6 * count(DISTINCT o_orderkey % 6) / 6 + 0.4 * least(1, max(o_totalprice / 4999.7) / 100), 6) AS priority FROM g JOIN orders ON o_custkey = d WHERE own = 0 AND spam < 60 GROUP BY d""")
def _(t: Tables):
    comp = F.struct(F.concat(F.lit("c"), F.col("o_orderkey") % 6).alias("domain"), (F.col("o_orderkey") % 5).alias("backlinks"), (F.col("o_totalprice") / 4999.7).alias("rank"))
    listed = t.orders.groupBy("o_custkey").agg(F.collect_list(comp).alias("competitors"))
    c = F.col("c_custkey")
    opp = t.customer.join(listed, F.col("o_custkey") == c).select(
        F.concat(F.lit("r"), c).alias("referring_domain"), F.when(c % 4 == 0, 2).otherwise(0).alias("target_backlinks"), "competitors", (F.col("c_acctbal") / 100).alias("max_spam")
    )
    rows = backlinks.gap_targets(opp, 6)
    return rows.select("referring_domain", "competitors", "links", *[F.round(x, 6).alias(x) for x in ("relevance", "authority", "priority")])


@query("best_link_values", "D31", """
WITH l AS (SELECT vec_id % 5 AS profile, 'd' || (vec_id % 60) AS domain, CASE WHEN vec_id % 13 <> 0 THEN (vec_id * 7) % 120 END AS authority, vec_id % 4 <> 0 AS follow, embedding::DOUBLE[] AS v FROM embeddings),
t AS (SELECT embedding::DOUBLE[] AS c FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT profile, domain, follow, CASE WHEN follow THEN least(1, authority / 100) * greatest(0, list_cosine_similarity(v, c)) END AS value FROM l, t),
g AS (SELECT profile, domain, max(value) AS best, count(*) FILTER (WHERE follow AND value IS NULL) AS un, count(*) FILTER (WHERE follow) AS fo FROM s GROUP BY 1, 2)
SELECT profile, round(sum(best), 6) AS value, count(best)::BIGINT AS scored_domains, count(*)::BIGINT AS domains, sum(un)::BIGINT AS unscored_links, sum(fo)::BIGINT AS followed_links FROM g GROUP BY 1""")
def _(t: Tables):
    v = F.col("vec_id")
    topic = t.embeddings.agg(F.min_by("embedding", "vec_id")).scalar()
    links = t.embeddings.select(
        (v % 5).alias("profile"), F.concat(F.lit("https://www.d"), v % 60, F.lit(".example/a")).alias("source_url"), F.when(v % 13 != 0, (v * 7) % 120).cast("double").alias("authority"),
        (v % 4 != 0).alias("follow"), F.col("embedding").alias("vector"), topic.alias("topic"),
    )
    return backlinks.best_link_value(links, F.col("topic")).withColumn("value", F.round("value", 6))
