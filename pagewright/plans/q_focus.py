"""Term statistics, focus, scores and decisions over documents (a source is a site, a document a page)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import extract, focus as ops, scores, similarity
from pagewright.plans.inputs import TERMS_SQL, cte, doc_terms, packed_terms
from pagewright.plans.registry import Tables, query
from pagewright.session import cut_lineage, release

_T = dict(x=TERMS_SQL, t="SELECT source AS site, doc_id AS page, term, n AS tf FROM x")
_ST = dict(**_T, sz="SELECT site, count(DISTINCT page) AS pages FROM t GROUP BY 1", st="SELECT site, term, count(*) AS df, max(pages) AS n, ln(1 + max(pages) / count(*)) AS idf, max(pages) >= 10 AND count(*) / max(pages) > 0.25 AS sitewide FROM t JOIN sz USING (site) GROUP BY 1, 2")
_V = dict(**_ST, v="SELECT site, page, term, tf, (1 + ln(tf)) * idf AS weight FROM t JOIN st USING (site, term)", tot="SELECT site, term, sum(weight) AS weight FROM v GROUP BY 1, 2",
          top="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(weight, 9) DESC, term) AS rank FROM tot) WHERE rank <= 30")


def _terms(t: Tables):
    return doc_terms(t).select(F.col("source").alias("site"), F.col("doc_id").alias("page"), "term", F.col("n").alias("tf"))


def _vectors(t: Tables):
    # Written once: statistics, sizes and vectors read the terms, and each would take the texts apart again.
    terms = cut_lineage(packed_terms(t))
    vectors = cut_lineage(ops.tfidf(terms, ops.term_stats(terms)))
    release(terms)
    return vectors


def _clusters(t: Tables, vectors):
    # Initial letters stand in for term clusters, so that scores can be stated in SQL.
    return ops.site_terms(vectors).withColumn("cluster", F.substring("term", 1, 1))


@query("term_document_frequency", "D15", cte(**_ST) + "SELECT site, term, df::BIGINT AS df, round(idf, 6) AS idf, sitewide FROM st")
def _(t: Tables):
    return ops.term_stats(cut_lineage(_terms(t))).select("site", "term", "df", F.round("idf", 6).alias("idf"), "sitewide")


@query("term_inventory", "D16", cte(**_ST, k="SELECT *, row_number() OVER (PARTITION BY site, page ORDER BY tf DESC, term) AS rank FROM t") + "SELECT site, page, term, rank::INTEGER AS rank, n < 10 OR df / n <= 0.5 AS topical FROM k JOIN st USING (site, term) WHERE rank <= 40")
def _(t: Tables):
    terms = _terms(t)
    return ops.term_inventory(terms, ops.term_stats(terms))


@query("tfidf_vectors", "L7", cte(**_V) + "SELECT site, page, count(*)::BIGINT AS terms, round(sum(weight), 4) AS mass, round(max(weight), 6) AS top FROM v GROUP BY 1, 2")
def _(t: Tables):
    return ops.page_masses(_vectors(t)).withColumn("mass", F.round("mass", 4)).withColumn("top", F.round("top", 6))


@query("top_site_terms", "D17 F1", cte(**_V) + "SELECT site, term, round(weight, 6) AS weight, rank::INTEGER AS rank FROM top")
def _(t: Tables):
    return ops.top_terms(ops.site_weights(_vectors(t)), 30).withColumn("weight", F.round("weight", 6))


@query("term_cooccurrence", "L8", cte(**_V, s="SELECT v.* FROM v JOIN top USING (site, term)", nm="SELECT site, term, sqrt(sum(weight ** 2)) AS n FROM s GROUP BY 1, 2") + """
SELECT a.site, a.term AS "left", b.term AS "right", round(sum(a.weight * b.weight) / max(x.n * y.n), 6) AS similarity FROM s a JOIN s b ON a.site = b.site AND a.page = b.page AND a.term < b.term JOIN nm x ON x.site = a.site AND x.term = a.term JOIN nm y ON y.site = b.site AND y.term = b.term GROUP BY 1, 2, 3""")
def _(t: Tables):
    v = _vectors(t)
    return ops.cooccurrence(v, ops.top_terms(ops.site_weights(v), 30)).withColumn("similarity", F.round("similarity", 6))


@query("term_clusters", "L8 J2")
def _(t: Tables):
    v = _vectors(t)
    pairs = cut_lineage(ops.cooccurrence(v, ops.top_terms(ops.site_weights(v))))
    name = lambda c: F.concat_ws(":", "site", c)
    links = pairs.where("similarity > 0").select(name("left").alias("left"), name("right").alias("right"), "similarity")
    return similarity.average_linkage(links.select(F.col("left").alias("node")).union(links.select("right")), links, 0.6)


@query("anchor_term_mass", "L9", cte(**_V, a="SELECT site, min(page) AS page FROM t GROUP BY 1", w="SELECT v.site, term, weight / sum(weight) OVER (PARTITION BY v.site, v.page) AS m FROM v JOIN a ON a.site = v.site AND a.page = v.page") + "SELECT site, term, round(sum(m), 6) AS mass FROM w GROUP BY 1, 2")
def _(t: Tables):
    v = _vectors(t)
    return ops.anchor_mass(v, ops.site_pages(v).groupBy("site").agg(F.min("page").alias("page"))).withColumn("mass", F.round("mass", 6))


_CORE = dict(cl="SELECT site, term, substr(term, 1, 1) AS cluster, weight FROM tot", pc="SELECT site, cluster, sum(weight) AS mass FROM cl GROUP BY 1, 2", bc="SELECT site, arg_min(cluster, (-round(mass, 9), cluster)) AS core, sum(mass) AS al FROM pc GROUP BY 1",
             core="SELECT * FROM (SELECT cl.site, cl.cluster, term, weight, mass / al AS confidence, row_number() OVER (PARTITION BY cl.site ORDER BY round(weight, 9) DESC, term) AS rank FROM cl JOIN bc ON bc.site = cl.site AND bc.core = cl.cluster JOIN pc ON pc.site = cl.site AND pc.cluster = cl.cluster) WHERE rank <= 40")


def _core(v, clusters):
    return ops.core_terms(clusters, ops.site_weights(v))


@query("core_terms", "F5", cte(**_V, **_CORE) + "SELECT site, cluster, term, round(weight, 6) AS weight, round(confidence, 6) AS confidence, rank::INTEGER AS rank FROM core")
def _(t: Tables):
    v = _vectors(t)
    return _core(v, _clusters(t, v)).withColumn("weight", F.round("weight", 6)).withColumn("confidence", F.round("confidence", 6))


_REL = dict(**_V, **_CORE, j="SELECT v.*, substr(v.term, 1, 1) <> core AS f, c.weight AS cw FROM v JOIN bc USING (site) LEFT JOIN core c ON c.site = v.site AND c.term = v.term",
            k="SELECT site, count(*) AS k, sum(weight ** 2) AS sq FROM core GROUP BY 1",
            p="SELECT site, page, sum(weight * coalesce(cw, 0)) / sqrt(sum(weight ** 2) * max(k.sq)) AS sim, least(1, count(cw) / least(greatest(max(k.k), 1), 12)) AS ov, sum(CASE WHEN f THEN weight ELSE 0 END) / sum(weight) AS dr FROM j JOIN k USING (site) GROUP BY 1, 2")


@query("page_relevance", "L10", cte(**_REL) + "SELECT site, page, floor(greatest(0, least(100, (0.5 * sim + 0.3 * ov - 0.2 * dr) * 125)) * 10 + 0.5) / 10 AS score, round(sim, 6) AS similarity, round(ov, 6) AS overlap, round(dr, 6) AS drift FROM p")
def _(t: Tables):
    # Each is read several times, and what moves for one is gone when it is written.
    v = _vectors(t)
    clusters = cut_lineage(_clusters(t, v))
    rows = ops.page_relevance(v, clusters, cut_lineage(_core(v, clusters)))
    return rows.select("site", "page", "score", *[F.round(c, 6).alias(c) for c in ("similarity", "overlap", "drift")])


@query("term_alignment", "L11", cte(**_V, **_CORE, m="SELECT site, page, substr(term, 1, 1) AS c, sum(weight) AS m FROM v GROUP BY 1, 2, 3", s="SELECT *, m / sum(m) OVER (PARTITION BY site, page) AS share FROM m", r="SELECT *, row_number() OVER (PARTITION BY site, page ORDER BY round(weight, 9) DESC, term) AS rank FROM v") + """
SELECT r.site, r.page, r.term, r.rank::INTEGER AS rank, substr(r.term, 1, 1) = core AS is_core, round(share, 6) AS cluster_share FROM r JOIN bc USING (site) JOIN s ON s.site = r.site AND s.page = r.page AND s.c = substr(r.term, 1, 1) WHERE rank <= 20""")
def _(t: Tables):
    v = _vectors(t)
    clusters = cut_lineage(_clusters(t, v))
    return ops.alignment_rows(v, clusters, cut_lineage(_core(v, clusters))).withColumn("cluster_share", F.round("cluster_share", 6))


# Scored pages: documents with a score from their length and a type from their number.
_SP = "SELECT source AS site, doc_id AS page, (n_chars * 7 % 1000) / 10.0::DOUBLE AS score, CASE WHEN doc_id % 50 = 0 THEN 'homepage' WHEN doc_id % 11 = 0 THEN 'technical' WHEN doc_id % 5 = 0 THEN 'category' ELSE 'article' END AS page_type FROM documents"
_WT = "CASE page_type WHEN 'homepage' THEN 3.0 WHEN 'category' THEN 2.0 WHEN 'article' THEN 1.0 ELSE 0.1 END::DOUBLE"


def _scored(t: Tables):
    d = F.col("doc_id")
    kind = F.when(d % 50 == 0, "homepage").when(d % 11 == 0, "technical").when(d % 5 == 0, "category").otherwise("article")
    return t.documents.select(F.col("source").alias("site"), d.alias("page"), ((F.col("n_chars") * 7 % 1000) / 10.0).alias("score"), kind.alias("page_type"), "lang")


@query("site_focus_scores", "D18", cte(s=_SP) + f"SELECT site, round(sum({_WT} * score) / sum({_WT}), 6) AS focus, round(avg(CASE WHEN page_type <> 'technical' THEN CASE WHEN score >= 60 THEN 1.0 ELSE 0 END END), 6) AS on_topic_ratio, count(*)::BIGINT AS pages FROM s GROUP BY 1")
def _(t: Tables):
    return ops.focus_score(_scored(t), ["site"]).withColumn("focus", F.round("focus", 6)).withColumn("on_topic_ratio", F.round("on_topic_ratio", 6))


@query("segment_focus_scores", "D19", cte(s=_SP, k="SELECT d.lang AS segment, s.* FROM s JOIN documents d ON d.doc_id = s.page", g=f"SELECT segment, sum({_WT} * score) / sum({_WT}) AS focus FROM k GROUP BY 1") +
"SELECT segment, round(focus, 6) AS focus, CASE WHEN focus IS NULL THEN 'unavailable' WHEN focus >= 90 THEN 'excellent' WHEN focus >= 75 THEN 'good' WHEN focus >= 60 THEN 'moderate' WHEN focus >= 40 THEN 'weak' ELSE 'critical' END AS state FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS segment) LEFT JOIN g USING (segment)")
def _(t: Tables):
    segs = t.region.select(F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "xx")])).alias("segment")).distinct()
    return ops.segment_scores(_scored(t).withColumn("segment", F.col("lang")), segs).select("segment", F.round("focus", 6).alias("focus"), "state")


@query("sub_sites", "D20", """
WITH p AS (SELECT c_nationkey AS site, c_mktsegment AS cluster, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE lower(c_mktsegment) END AS seg FROM customer), c AS (SELECT site, cluster, seg, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT site, cluster, sum(n) AS pages, arg_min(seg, (-n, seg)) AS seg, max(n) AS top FROM c GROUP BY 1, 2), s AS (SELECT *, pages / sum(pages) OVER (PARTITION BY site) AS share, top / pages AS purity FROM g), k AS (SELECT * FROM s WHERE share >= 0.15 AND purity >= 0.6 QUALIFY count(*) OVER (PARTITION BY site, seg) = 1)
SELECT site, cluster, seg AS segment, round(share, 6) AS share, round(purity, 6) AS purity FROM k QUALIFY count(*) OVER (PARTITION BY site) >= 2""")
def _(t: Tables):
    pages = t.customer.select(F.col("c_nationkey").alias("site"), F.col("c_custkey").alias("page"), F.col("c_mktsegment").alias("cluster"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.lower("c_mktsegment")).alias("segment"))
    return ops.sub_sites(pages).withColumn("share", F.round("share", 6)).withColumn("purity", F.round("purity", 6))


_DL = "SELECT DISTINCT l_orderkey % 1000 AS source, l_partkey % 1000 AS target FROM lineitem"


def _doc_links(t: Tables):
    return t.lineitem.select((F.col("l_orderkey") % 1000).alias("source"), (F.col("l_partkey") % 1000).alias("target")).distinct()


@query("hub_link_suggestions", "C22", cte(s=_SP, l=_DL, h="SELECT site, page AS hub, row_number() OVER (PARTITION BY site ORDER BY score DESC, page) AS hr FROM s WHERE score >= 75 AND page_type <> 'technical' QUALIFY hr <= 5",
 o="SELECT s.site, s.page AS source, hub, hr FROM s JOIN h USING (site) WHERE score >= 40 AND score < 75 AND (s.page, hub) NOT IN (SELECT (source, target) FROM l)") + "SELECT site, source, hub, row_number() OVER (PARTITION BY site, source ORDER BY hr)::INTEGER AS rank FROM o QUALIFY rank <= 2")
def _(t: Tables):
    return ops.hub_link_suggestions(_scored(t), _doc_links(t))


_DELTAS = (cte(s=_SP, g=f"SELECT site, sum({_WT}) AS w, sum({_WT} * score) AS ws, sum(CASE WHEN score < 40 AND page_type <> 'technical' THEN {_WT} ELSE 0 END) AS wo, sum(CASE WHEN score < 40 AND page_type <> 'technical' THEN {_WT} * score ELSE 0 END) AS wso, sum(CASE WHEN score >= 40 AND score < 75 THEN {_WT} * (75 - score) ELSE 0 END) AS lift, count(*) FILTER (WHERE score < 40 AND page_type <> 'technical') AS o, count(*) FILTER (WHERE score >= 40 AND score < 75) AS b FROM s GROUP BY 1") +
"SELECT site, 'remove-off-topic' AS action, o::BIGINT AS pages, round((ws - wso) / (w - wo) - ws / w, 6) AS delta FROM g WHERE o > 0 UNION ALL SELECT site, 'improve-borderline', b::BIGINT, round(lift / w, 6) FROM g WHERE b > 0")


@query("recommendation_deltas", "N6", _DELTAS)
def _(t: Tables):
    return ops.recommendation_deltas(_scored(t)).withColumn("delta", F.round("delta", 6))


@query("weekly_tasks", "F11", f"SELECT *, 1 AS rank FROM (SELECT * FROM ({_DELTAS}) QUALIFY row_number() OVER (PARTITION BY site ORDER BY delta DESC, action) = 1)")
def _(t: Tables):
    return ops.weekly_tasks(ops.recommendation_deltas(_scored(t)).withColumn("delta", F.round("delta", 6)), 1)


@query("term_gaps", "G7", cte(**_T, o="SELECT site, page, term FROM t WHERE page % 2 = 0", c="SELECT site, page, term FROM t WHERE page % 2 = 1", m="SELECT site, term, count(*) AS df FROM o GROUP BY 1, 2", n="SELECT site, count(DISTINCT page) AS n FROM o GROUP BY 1", k="SELECT DISTINCT site, term FROM c") +
"SELECT k.site, k.term, 'competitor-term' AS code, 0.0::DOUBLE AS coverage FROM k LEFT JOIN m USING (site, term) WHERE m.df IS NULL UNION ALL SELECT site, term, 'thin-subtopic', round(df / n, 6) FROM k JOIN m USING (site, term) JOIN n USING (site) WHERE df / n < 0.15")
def _(t: Tables):
    terms = _terms(t)
    return ops.term_gaps(terms.where("page % 2 = 0"), terms.where("page % 2 = 1")).withColumn("coverage", F.round("coverage", 6))


@query("unique_group_terms", "G5", cte(**_T, g="SELECT page % 100 AS g, page AS url, term, tf FROM t", u="SELECT g, term, min(url) AS url, max(tf) AS w FROM g GROUP BY 1, 2 HAVING count(DISTINCT url) = 1") + "SELECT g AS \"group\", url, term, row_number() OVER (PARTITION BY g, url ORDER BY w DESC, term)::INTEGER AS rank FROM u QUALIFY rank <= 6")
def _(t: Tables):
    return ops.unique_terms(_terms(t).select((F.col("page") % 100).alias("group"), F.col("page").alias("url"), "term", F.col("tf").alias("weight")))


@query("link_opportunities", "C21", cte(l=_DL, p="SELECT DISTINCT l_suppkey AS a, l_partkey % 1000 AS b FROM lineitem WHERE l_suppkey < l_partkey % 1000", o="SELECT a AS source, b AS target FROM p UNION SELECT b, a FROM p") + "SELECT source, target FROM o WHERE (source, target) NOT IN (SELECT (source, target) FROM l)")
def _(t: Tables):
    a, b = F.col("l_suppkey"), F.col("l_partkey") % 1000
    pairs = t.lineitem.where(a < b).select(a.alias("left"), b.alias("right")).distinct().withColumn("similarity", F.lit(0.5)).withColumn("shared", F.lit(2))
    return ops.link_opportunities(pairs, _doc_links(t)).select("source", "target")


@query("brand_term_filter", "H32", cte(x=TERMS_SQL, d="SELECT DISTINCT term FROM x") + "SELECT term, CASE WHEN term = 'that' THEN NULL WHEN term IN ('with', 'from', 'that') THEN 'own-brand' WHEN term IN ('nicht') THEN 'competitor-brand' END AS brand_reason FROM d")
def _(t: Tables):
    return ops.brand_terms(doc_terms(t).select("term").distinct(), ["with", "from", "that"], ["nicht"], ["that"])


_ZONE_KEYS = """
WITH p AS (SELECT doc_id AS page, lang, split_part(text, chr(10), 1) AS title, text AS body FROM documents),
w AS (SELECT page, lang, 2.5 AS z, unnest(regexp_extract_all(lower(title), '([\\p{L}\\p{N}]+)', 1)) AS w, generate_subscripts(regexp_extract_all(lower(title), '([\\p{L}\\p{N}]+)', 1), 1) AS i FROM p UNION ALL SELECT page, lang, 1.0, unnest(regexp_extract_all(lower(body), '([\\p{L}\\p{N}]+)', 1)), generate_subscripts(regexp_extract_all(lower(body), '([\\p{L}\\p{N}]+)', 1), 1) FROM p),
f AS (SELECT *, replace(strip_accents(w), 'ß', 'ss') AS plain, replace(strip_accents(CASE WHEN lang = 'de' THEN replace(replace(replace(w, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') ELSE w END), 'ß', 'ss') AS f FROM w),
k AS (SELECT page, z, i, CASE WHEN length(regexp_replace(plain, '[^\\p{L}]', '', 'g')) >= 2 AND length(regexp_replace(plain, '[^\\p{N}]', '', 'g')) < length(regexp_replace(plain, '[^\\p{L}]', '', 'g')) AND plain NOT IN @STOP THEN
  CASE WHEN lang = 'en' AND length(f) > 4 AND f LIKE '%ies' THEN left(f, length(f) - 3) || 'y' WHEN lang = 'en' AND length(f) >= 5 AND regexp_matches(f, '[^aeiousy]s$') THEN left(f, length(f) - 1) ELSE f END END AS k FROM f),
g1 AS (SELECT page, z, k FROM k WHERE k IS NOT NULL),
g2 AS (SELECT a.page, a.z, a.i, a.k || ' ' || b.k AS k FROM k a JOIN k b ON b.page = a.page AND b.z = a.z AND b.i = a.i + 1 WHERE a.k IS NOT NULL AND b.k IS NOT NULL),
"""
_STOP = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query("zone_weighted_ngrams", "H11", _ZONE_KEYS.replace("@STOP", _STOP(("que", "para"))) + """
g AS (SELECT page, z, k FROM g1 UNION ALL SELECT page, z, k FROM g2)
SELECT page, k AS key, sum(z)::DOUBLE AS tf, count(*)::BIGINT AS count FROM g GROUP BY 1, 2""")
def _(t: Tables):
    pages = t.documents.select(F.col("doc_id").alias("page"), "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"))
    return ops.zone_ngrams(pages, {"title": "title", "body": "body"}, stopwords=("que", "para"))


@query("focus_terms", "F3", _ZONE_KEYS.replace("@STOP", _STOP(text.STOPWORDS)) + """
g3 AS (SELECT a.page, a.z, a.k || ' ' || b.k AS k FROM g2 a JOIN k b ON b.page = a.page AND b.z = a.z AND b.i = a.i + 2 WHERE b.k IS NOT NULL),
g AS (SELECT page, z, k FROM g1 UNION ALL SELECT page, z, k FROM g2 UNION ALL SELECT page, z, k FROM g3),
n AS (SELECT page, k AS key, sum(z)::DOUBLE AS tf, count(*)::BIGINT AS count FROM g GROUP BY 1, 2)
SELECT page, key, tf, count, row_number() OVER (PARTITION BY page ORDER BY tf DESC, key)::INTEGER AS rank FROM n WHERE NOT (contains(key, ' ') AND count = 1 AND tf <= 1) QUALIFY rank <= 20""")
def _(t: Tables):
    pages = t.documents.select(F.col("doc_id").alias("page"), "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"))
    return ops.focus_terms(ops.zone_ngrams(pages, {"title": "title", "body": "body"}, longest=3, drop_once=True), 20)


# --- scores and decisions ------------------------------------------------------------------------------------

@query("url_protection", "N1", """
WITH r AS (SELECT p_partkey AS url, p_size * 2 AS score, CASE WHEN p_partkey % 9 = 0 THEN 12.5 END AS rev, CASE WHEN p_partkey % 18 = 0 THEN 'PLN' END AS cur, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 60 END AS cl, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 23 = 1 THEN 1 ELSE 0 END END AS cv, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 4 END AS dm, p_partkey % 31 = 0 AS weak, p_partkey % 2 = 0 AS rel FROM part),
s AS (SELECT *, greatest(CASE WHEN cl IS NOT NULL THEN least(1, cl / 200) END, CASE WHEN cv IS NOT NULL THEN least(1, cv / 2) END, CASE WHEN dm IS NOT NULL THEN least(1, dm / 15) END) AS sig FROM r)
SELECT url, round(sig, 6) AS signal, CASE WHEN score >= 40 THEN 'keep' WHEN rev > 0 AND cur IS NOT NULL THEN 'shield' WHEN rev > 0 THEN 'needs-data' WHEN cv > 0 THEN 'shield' WHEN sig >= 0.15 THEN 'shield' WHEN cl IS NULL OR cv IS NULL OR dm IS NULL OR weak THEN 'needs-data' WHEN rel THEN 'semantic-bridge' ELSE 'prune-candidate' END AS decision FROM s""")
def _(t: Tables):
    p = F.col("p_partkey")
    rows = t.part.select(
        p.alias("url"), (F.col("p_size") * 2).alias("score"), F.when(p % 9 == 0, 12.5).alias("revenue"), F.when(p % 18 == 0, "PLN").alias("currency"), F.when(p % 4 != 0, p % 60).alias("clicks"),
        F.when(p % 5 != 0, (p % 23 == 1).cast("int")).alias("conversions"), F.when(p % 7 != 0, p % 4).alias("domains"), (p % 31 == 0).alias("weak"), (p % 2 == 0).alias("related"),
    )
    return scores.url_protection(rows).withColumn("signal", F.round("signal", 6))


@query("authority_scores", "N2 D41", """
WITH r AS (SELECT c_custkey AS site, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 101 END AS cov, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 3 % 101 END AS dep, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 7 % 101 END AS coh, c_custkey * 11 % 101 AS vel, c_custkey * 13 % 101 AS foc FROM customer),
w AS (SELECT *, (coalesce(cov * 0.35, 0) + coalesce(dep * 0.3, 0) + coalesce(coh * 0.25, 0) + vel * 0.1)::DOUBLE / (0.35 + CASE WHEN dep IS NULL THEN 0 ELSE 0.3 END + CASE WHEN coh IS NULL THEN 0 ELSE 0.25 END + 0.1)::DOUBLE AS raw FROM r WHERE cov IS NOT NULL)
SELECT r.site, round(w.raw, 3) AS raw3, CASE WHEN w.raw IS NOT NULL THEN CASE WHEN r.foc >= 75 THEN 'focused' ELSE 'broad' END END AS side FROM r LEFT JOIN w USING (site)""")
def _(t: Tables):
    c = F.col("c_custkey")
    rows = t.customer.select(
        c.alias("site"), F.when(c % 6 != 0, c % 101).cast("double").alias("coverage"), F.when(c % 5 != 0, c * 3 % 101).cast("double").alias("depth"), F.when(c % 4 != 0, c * 7 % 101).cast("double").alias("cohesion"),
        (c * 11 % 101).cast("double").alias("velocity"), (c * 13 % 101).cast("double").alias("focus"),
    )
    from pagewright.functions import numbers

    raw = numbers.weighted_mean([(F.col("coverage"), 0.35), (F.col("depth"), 0.30), (F.col("cohesion"), 0.25), (F.col("velocity"), 0.10)])
    out = scores.authority_score(rows)
    return out.select("site", F.when(F.col("coverage").isNotNull(), F.round(raw, 3)).alias("raw3"), F.when(F.col("quadrant").isin("dominant", "specialist"), "focused").when(F.col("quadrant").isNotNull(), "broad").alias("side"))


@query("holistic_scores", "D32", """
WITH m AS (SELECT o_custkey AS site, o_orderkey AS module, CAST(1 + o_orderkey % 4 AS DOUBLE) AS weight, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 5003 END AS value FROM orders), g AS (SELECT site, sum(weight * value) / sum(CASE WHEN value IS NOT NULL THEN weight END) AS v, sum(CASE WHEN value IS NOT NULL THEN weight ELSE 0 END) / sum(weight) AS s FROM m GROUP BY 1)
SELECT site, round(CASE WHEN s >= 0.5 THEN v END, 6) AS score, round(s, 6) AS known_share, CASE WHEN s >= 1 THEN 'ready' WHEN s >= 0.5 THEN 'partial' ELSE 'insufficient' END AS state FROM g""")
def _(t: Tables):
    m = t.orders.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("module"), (1 + F.col("o_orderkey") % 4).cast("double").alias("weight"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 5003).alias("value"))
    return scores.holistic_score(m).withColumn("score", F.round("score", 6)).withColumn("known_share", F.round("known_share", 6))


@query("declared_name_matches", "N4", """
WITH p AS (SELECT p_partkey, 'Dr. ' || p_name AS a, split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN ' ' || upper(split_part(p_name, ' ', 1)) || ' Jr' ELSE ' other' END AS b FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS same FROM p""")
def _(t: Tables):
    k, first, last = F.col("p_partkey"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    b = F.concat(last, F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" "), F.upper(first), F.lit(" Jr"))).otherwise(" other"))
    return t.part.select("p_partkey", scores.same_name(F.concat(F.lit("Dr. "), "p_name"), b).alias("same"))


@query("topic_coverage_ratio", "D21", "SELECT p_type AS pillar, round(sum(p_size * (p_partkey % 3) / 2) / sum(p_size), 6) AS coverage_ratio, round(avg(CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END), 6) AS mean_depth, count(*) FILTER (WHERE p_partkey % 3 = 0)::BIGINT AS gaps FROM part GROUP BY 1")
def _(t: Tables):
    k = F.col("p_partkey")
    rows = t.part.select(F.col("p_type").alias("pillar"), F.col("p_size").alias("importance"), (k % 3 / 2).alias("coverage"), F.when(k % 4 != 0, F.col("p_retailprice")).alias("depth"))
    return scores.coverage_ratio(rows, ["pillar"]).withColumn("coverage_ratio", F.round("coverage_ratio", 6)).withColumn("mean_depth", F.round("mean_depth", 6))


@query("template_clusters", "D22", """
WITH s AS (SELECT list_filter(string_split(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '://[^/]+(.*)$', 1), '/'), lambda x: x <> '') AS seg, url FROM pages)
SELECT array_to_string(list_transform(seg[:-2], lambda x: '/' || x), '') || '/{var}' AS pattern, count(*)::BIGINT AS pages, min(url) AS first_url FROM s GROUP BY 1""")
def _(t: Tables):
    from pagewright.functions import urls

    return scores.template_clusters(t.pages.select("url", urls.template_pattern(F.col("url")).alias("pattern"), F.lit("s").alias("signature"))).drop("signature")


@query("template_information_gain", "D23", """
WITH w AS (SELECT DISTINCT lang AS c, doc_id AS p, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS w FROM documents), n AS (SELECT lang AS c, count(*) AS n FROM documents GROUP BY 1), d AS (SELECT c, w, count(*) / max(n) < 0.05 AS own FROM w JOIN n USING (c) GROUP BY 1, 2),
g AS (SELECT c, p, avg(own::INT) AS g FROM w JOIN d USING (c, w) GROUP BY 1, 2)
SELECT c AS cluster, max(n)::BIGINT AS pages, round(avg(g), 6) AS gain, CASE WHEN avg(g) < 0.3 THEN 'thin' ELSE 'ok' END AS verdict, CASE WHEN avg(g) < 0.15 THEN 'noindex' WHEN avg(g) < 0.3 THEN 'enrich' ELSE 'none' END AS action FROM g JOIN n USING (c) GROUP BY 1""")
def _(t: Tables):
    return scores.template_gain(t.documents.select(F.col("lang").alias("cluster"), F.col("doc_id").alias("page"), "text"), shared_share=0.05).withColumn("gain", F.round("gain", 6))


@query("majority_intents", "D24", "WITH c AS (SELECT o_custkey AS query, o_orderpriority AS i, count(*) AS n FROM orders GROUP BY 1, 2) SELECT query, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(i, n) END AS intent FROM c GROUP BY 1")
def _(t: Tables):
    return scores.majority_intent(t.orders.select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("intent")), ["query"])


@query("language_parity", "D25", """
WITH d AS (SELECT l_partkey AS topic, CASE l_linenumber % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS language, max(l_quantity) AS depth, bool_or(l_partkey % 10 = 0) AS loc FROM lineitem GROUP BY 1, 2), r AS (SELECT topic, max(depth) FILTER (WHERE language = 'en') AS ref, bool_or(loc) AS loc FROM d GROUP BY 1)
SELECT topic, language, depth, CASE WHEN depth IS NULL AND r.loc THEN 'intentionally-local' WHEN depth IS NULL THEN 'missing' WHEN depth < ref * 0.5 THEN 'shallow' ELSE 'covered' END AS state FROM (SELECT r.topic, ref, loc, language FROM r, (SELECT unnest(['de', 'fr', 'es', 'it']) AS language)) r LEFT JOIN d USING (topic, language)""")
def _(t: Tables):
    ln = F.col("l_linenumber") % 4
    d = t.lineitem.select(F.col("l_partkey").alias("topic"), F.when(ln == 0, "en").when(ln == 1, "de").when(ln == 2, "fr").otherwise("es").alias("language"), F.col("l_quantity").alias("depth"), (F.col("l_partkey") % 10 == 0).alias("local"))
    return scores.language_parity(d, ["en", "de", "fr", "es", "it"], "en")


@query("article_citation_quality", "D27", """
WITH l AS (SELECT l_orderkey AS a, CASE l_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS k, l_partkey % 9 = 0 AS dead FROM lineitem)
SELECT a AS article, count(*)::BIGINT AS external, count(*) FILTER (WHERE k = 'A')::BIGINT AS trusted, count(*) FILTER (WHERE dead)::BIGINT AS dead, round(greatest(0, least(1, sum(CASE WHEN dead THEN -0.3 WHEN k = 'A' THEN 1 WHEN k = 'B' THEN 0.7 WHEN k = 'C' THEN 0.2 ELSE 0 END) / 5)), 6)::DOUBLE AS share FROM l GROUP BY 1""")
def _(t: Tables):
    k = F.col("l_suppkey") % 4
    links = t.lineitem.select(F.col("l_orderkey").alias("article"), F.when(k == 0, "A").when(k == 1, "B").when(k == 2, "C").otherwise("D").alias("source_class"), (F.col("l_partkey") % 9 == 0).alias("dead"))
    return scores.citation_quality(links).select("article", "external", "trusted", "dead", F.round("share", 6).alias("share"))


@query("authorship_coverage", "D28", """
WITH g AS (SELECT o_custkey % 30 AS site, avg((o_orderkey % 3 = 0)::INT) AS a, avg(CASE WHEN o_custkey % 30 <> 7 THEN (o_orderkey % 4 = 0)::INT END) AS d, avg((o_orderkey % 5 = 0)::INT) AS r, avg((o_orderkey % 2 = 0)::INT) AS p FROM orders GROUP BY 1)
SELECT site, round((0.3 * a + coalesce(0.35 * d, 0) + 0.2 * r + 0.15 * p) / (0.65 + CASE WHEN d IS NULL THEN 0 ELSE 0.35 END), 6) AS score FROM g""")
def _(t: Tables):
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 30
    rows = t.orders.select(s.alias("site"), (k % 3 == 0).alias("author"), F.when(s != 7, k % 4 == 0).alias("dated"), (k % 5 == 0).alias("reviewer"), (k % 2 == 0).alias("publisher"))
    return scores.authorship_coverage(rows, ["site"]).select("site", F.round("score", 6).alias("score"))


@query("author_rollup", "N3", """
WITH b AS (SELECT l_orderkey AS page, CASE WHEN l_suppkey % 3 = 0 THEN 'id' || (l_suppkey % 20) END AS aid, 'Author ' || chr(65 + CAST(l_suppkey % 17 AS INTEGER)) AS name, l_linenumber % 3 AS sa, l_partkey % 5 AS sk FROM lineitem)
SELECT coalesce(aid, lower(name)) AS author, count(DISTINCT page)::BIGINT AS articles, count(DISTINCT sa)::BIGINT AS profiles, count(DISTINCT sk)::BIGINT AS skills FROM b GROUP BY 1""")
def _(t: Tables):
    s = F.col("l_suppkey")
    b = t.lineitem.select(F.col("l_orderkey").alias("page"), F.when(s % 3 == 0, F.concat(F.lit("id"), s % 20)).alias("author_id"), F.concat(F.lit("Author "), F.char(65 + s % 17)).alias("name"), (F.col("l_linenumber") % 3).alias("same_as"), (F.col("l_partkey") % 5).alias("skill"))
    return scores.author_rollup(b).drop("name")


_ENT = "SELECT DISTINCT l_suppkey AS query, l_orderkey % 40 AS doc, l_partkey % 60 AS entity FROM lineitem"


def _entities(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("query"), (F.col("l_orderkey") % 40).alias("doc"), (F.col("l_partkey") % 60).alias("entity")).distinct()


@query("consensus_entities", "D33", cte(e=_ENT, n="SELECT query, count(DISTINCT doc) AS n FROM e GROUP BY 1") + "SELECT query, entity, count(*)::BIGINT AS df, round(count(*) / max(n), 6) AS share, CASE WHEN count(*) / max(n) >= 0.28 THEN 'consensus' WHEN count(*) / max(n) <= 0.2 THEN 'rare' ELSE 'shared' END AS kind FROM e JOIN n USING (query) GROUP BY 1, 2")
def _(t: Tables):
    return scores.consensus(_entities(t), common=0.28).withColumn("share", F.round("share", 6))


@query("novel_and_missing_entities", "G6", cte(e=_ENT, n="SELECT query, count(DISTINCT doc) AS n FROM e GROUP BY 1", c="SELECT query, entity FROM e JOIN n USING (query) GROUP BY 1, 2 HAVING count(*) / max(n) >= 0.28", m="SELECT query, entity FROM e WHERE doc = 3") +
"SELECT query, entity, 'novel' AS code FROM m ANTI JOIN c USING (query, entity) UNION ALL SELECT query, entity, 'missing' FROM c ANTI JOIN m USING (query, entity)")
def _(t: Tables):
    e = _entities(t)
    return scores.novel_and_missing(e.where("doc = 3").select("query", "entity"), scores.consensus(e, common=0.28))


@query("term_divergence", "H24", cte(x=TERMS_SQL, a="SELECT source AS g, term, sum(n)::DOUBLE AS n FROM x WHERE (doc_id // 20) % 2 = 0 GROUP BY 1, 2", b="SELECT source AS g, term, sum(n)::DOUBLE AS n FROM x WHERE (doc_id // 20) % 2 = 1 GROUP BY 1, 2",
 p="SELECT g, term, coalesce(a.n, 0) / sum(a.n) OVER (PARTITION BY g) AS p, coalesce(b.n, 0) / sum(b.n) OVER (PARTITION BY g) AS q FROM a FULL JOIN b USING (g, term)") + "SELECT g AS source, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 / ln(2), 6) AS divergence FROM p GROUP BY 1")
def _(t: Tables):
    x = doc_terms(t)
    return scores.divergence(x.where("(doc_id div 20) % 2 = 0"), x.where("(doc_id div 20) % 2 = 1"), ["source"]).withColumn("divergence", F.round("divergence", 6))


@query("cannibalization_index", "D34", "WITH g AS (SELECT c_nationkey AS site, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), e AS (SELECT c_nationkey AS site, count(*) AS e FROM customer GROUP BY 1), x AS (SELECT site, sum(n - 1) AS x FROM g GROUP BY 1) SELECT site, round(coalesce(x, 0) * 100 / e, 6) AS cannibal_index FROM e LEFT JOIN x USING (site)")
def _(t: Tables):
    groups = t.customer.groupBy(F.col("c_nationkey").alias("site"), "c_mktsegment").agg(F.count("*").alias("members"))
    eligible = t.customer.groupBy(F.col("c_nationkey").alias("site")).agg(F.count("*").alias("eligible"))
    return scores.cannibal_index(groups, eligible, ["site"]).withColumn("cannibal_index", F.round("cannibal_index", 6))


@query("competitor_ranking", "D35", "SELECT c_nationkey AS query, c_custkey AS site, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC)::BIGINT AS rank, round(avg(floor(c_acctbal / 100)) OVER (PARTITION BY c_nationkey), 6) AS mean FROM customer")
def _(t: Tables):
    rows = t.customer.select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("site"), F.floor(F.col("c_acctbal") / 100).alias("score"))
    return scores.competitor_ranking(rows).select("query", "site", "rank", F.round("mean", 6).alias("mean"))


@query("score_histogram", "D36", cte(s=_SP) + "SELECT site, least(floor(score / 10), 9)::BIGINT AS bucket, count(*)::BIGINT AS pages FROM s GROUP BY 1, 2")
def _(t: Tables):
    return scores.score_histogram(_scored(t), ["site"])


@query("label_confusion", "D36", "SELECT quality AS label, (n_chars > 2000)::INTEGER AS predicted, count(*)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def _(t: Tables):
    return scores.confusion(t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") > 2000).cast("int").alias("predicted")))


@query("freshness_ratio", "D41", "SELECT o_custkey % 40 AS site, round(avg(CASE WHEN o_orderkey % 6 <> 0 THEN (date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') <= 365)::INT END), 6) AS fresh_share, count(*) FILTER (WHERE o_orderkey % 6 <> 0)::BIGINT AS dated FROM orders GROUP BY 1")
def _(t: Tables):
    rows = t.orders.select((F.col("o_custkey") % 40).alias("site"), F.when(F.col("o_orderkey") % 6 != 0, F.to_date("o_orderdate")).alias("date"))
    return scores.freshness_ratio(rows, ["site"], "1998-06-01").withColumn("fresh_share", F.round("fresh_share", 6))


@query("reference_taxonomy", "D40", """
WITH h AS (SELECT DISTINCT l_suppkey % 30 AS topic, l_orderkey % 8 AS source, l_partkey % 500 AS key FROM lineitem), n AS (SELECT topic, count(DISTINCT source) AS a FROM h GROUP BY 1)
SELECT topic, key, count(*)::BIGINT AS sources, round(count(*) / max(a), 6) AS importance, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, key)::INTEGER AS rank FROM h JOIN n USING (topic) GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY rank <= 60""")
def _(t: Tables):
    h = t.lineitem.select((F.col("l_suppkey") % 30).alias("topic"), (F.col("l_orderkey") % 8).alias("source"), (F.col("l_partkey") % 500).alias("key"))
    return scores.taxonomy(h).withColumn("importance", F.round("importance", 6))


@query("entity_language_gaps", "D44", """
WITH l AS (SELECT l_partkey AS topic, CASE l_linenumber % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lg, 'E' || (l_suppkey % 90) AS e, l_linenumber % 2 AS p FROM lineitem), b AS (SELECT topic, lg, arg_min(e, (p, e)) AS e FROM l GROUP BY 1, 2), h AS (SELECT e, list_distinct(list(lg)) AS h FROM b GROUP BY 1)
SELECT e AS entity, array_to_string(list_sort(list_filter(['en', 'de', 'fr', 'it'], lambda x: NOT list_contains(h, x))), ',') AS missing FROM h""")
def _(t: Tables):
    ln = F.col("l_linenumber")
    links = t.lineitem.select(F.col("l_partkey").alias("topic"), F.when(ln % 3 == 0, "en").when(ln % 3 == 1, "de").otherwise("fr").alias("language"), F.concat(F.lit("E"), F.col("l_suppkey") % 90).alias("entity"), (ln % 2).alias("priority"))
    return scores.entity_language_gaps(links, ["en", "de", "fr", "it"])


@query("group_canonicals", "E13", "SELECT c_nationkey AS \"group\", arg_min(c_custkey, (-floor(c_acctbal / 1000), -(c_custkey % 5), -length(c_mktsegment), c_custkey)) AS canonical, count(*)::BIGINT AS members FROM customer GROUP BY 1")
def _(t: Tables):
    c = F.col("c_custkey")
    return scores.group_canonical(t.customer.select(F.col("c_nationkey").alias("group"), c.alias("url"), F.floor(F.col("c_acctbal") / 1000).alias("score"), (c % 5).alias("inbound"), F.length("c_mktsegment").alias("terms")))


def _actions(t: Tables):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "keep").when(k % 4 == 1, "prune").when(k % 4 == 2, "merge").otherwise("expand")
    return t.orders.select(k.alias("id"), kind.alias("kind"), F.array(F.col("o_custkey") % 400, F.col("o_custkey") % 333).alias("urls"), F.when(k % 7 != 0, F.col("o_totalprice") / 999.7).alias("delta"), (1 + k % 5).alias("effort"), F.when(k % 3 == 0, "open").otherwise("done").alias("state"))


@query("ranked_actions", "F4", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'open' ELSE 'done' END AS state, round(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 999.7 END / (1 + o_orderkey % 5), 6) AS ratio FROM orders")
def _(t: Tables):
    return scores.rank_actions(_actions(t)).select("id", "state", F.round("ratio", 6).alias("ratio"))


@query("merged_actions", "G10", "WITH a AS (SELECT o_custkey AS id, o_orderstatus AS kind, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * o_totalprice AS delta, o_orderpriority AS e FROM orders) SELECT id, min(kind) AS kind, arg_max(delta, abs(delta)) AS delta, array_to_string(list_sort(list_distinct(list(e))), ',') AS evidence FROM a GROUP BY 1")
def _(t: Tables):
    a = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("kind"), (F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1) * F.col("o_totalprice")).alias("delta"), F.array("o_orderpriority").alias("evidence"))
    return scores.merge_actions(a).withColumn("evidence", F.array_join("evidence", ","))


@query("arbitrated_actions", "G11", """
WITH a AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'prune' WHEN 2 THEN 'merge' ELSE 'expand' END AS kind, unnest([o_custkey % 400, o_custkey % 333]) AS u FROM orders), h AS (SELECT u, bool_or(kind = 'keep') AS k, bool_or(kind = 'merge') AS m FROM a GROUP BY 1),
j AS (SELECT id, kind, CASE WHEN kind = 'prune' AND u IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) THEN 'guarded' WHEN kind = 'prune' AND k THEN 'kept-elsewhere' WHEN kind = 'expand' AND m THEN 'merge-first' END AS r FROM a JOIN h USING (u))
SELECT id, kind, min(r) AS reason, count(*)::BIGINT AS urls, min(r) IS NULL AS active FROM j GROUP BY 1, 2""")
def _(t: Tables):
    return scores.arbitrate_actions(_actions(t), t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("url")))


@query("unique_template_pages", "G9", "SELECT o_custkey AS key, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS page FROM orders GROUP BY 1")
def _(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("page"), F.col("o_totalprice").alias("score"))
    return scores.unique_pages(rows, "key", F.col("score"), F.col("page")).select("key", "page")


_FE = "SELECT o_custkey % 200 AS query, o_orderkey AS page, o_orderkey % 9 = 0 AS own, o_orderkey % 4 AS tables, o_orderkey % 3 AS lists, o_orderkey % 2 AS videos, (o_orderkey % 11) // 8 AS faqs FROM orders"


def _formats(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select((F.col("o_custkey") % 200).alias("query"), k.alias("page"), (k % 9 == 0).alias("own"), (k % 4).alias("tables"), (k % 3).alias("lists"), (k % 2).alias("videos"), F.floor((k % 11) / 8).alias("faqs"))


@query("format_gaps", "G8", cte(f=_FE, r="SELECT query, count(*) AS n, avg((tables > 0)::INT) AS a, avg((lists > 0)::INT) AS b, avg((videos > 0)::INT) AS c, avg((faqs > 0)::INT) AS d FROM f WHERE NOT own GROUP BY 1") +
"SELECT f.query, page, unnest(list_filter([CASE WHEN a >= 0.6 AND tables = 0 THEN 'tables' END, CASE WHEN b >= 0.6 AND lists = 0 THEN 'lists' END, CASE WHEN c >= 0.6 AND videos = 0 THEN 'videos' END, CASE WHEN d >= 0.6 AND faqs = 0 THEN 'faqs' END], lambda x: x IS NOT NULL)) AS format FROM f JOIN r USING (query) WHERE own AND n >= 3")
def _(t: Tables):
    return scores.format_gaps(_formats(t))


@query("structure_alignment", "H30", cte(f=_FE, v="SELECT *, [least(1, tables / 3), least(1, lists / 2), least(1, videos / 1)]::DOUBLE[] AS v FROM f", m="SELECT query, [avg(v[1]), avg(v[2]), avg(v[3])] AS m, count(*) AS n FROM v WHERE NOT own GROUP BY 1",
 s="SELECT v.query, page, n, sqrt(list_inner_product(v, v)) + sqrt(list_inner_product(m, m)) AS d, sqrt((v[1] - m[1]) ** 2 + (v[2] - m[2]) ** 2 + (v[3] - m[3]) ** 2) AS g FROM v JOIN m USING (query) WHERE own") + "SELECT query, page, CASE WHEN n >= 3 AND d > 0 THEN floor(100 * (1 - g / d) * 10 + 0.5) / 10 END AS score FROM s")
def _(t: Tables):
    return scores.structure_alignment(_formats(t), {"tables": 3.0, "lists": 2.0, "videos": 1.0}).select("query", "page", "score")


_HEAD = "lower(trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<{0}>([^<]*)</{0}>', 1), '&amp;', '&'), '&copy;', '©'), '&middot;', '·'), '\\s+', ' ', 'g')))".replace("\\\\", "\\")


def _has(intent: str) -> str:
    return f"(CASE WHEN regexp_matches(t, '{scores.INTENT_WORDS[intent].replace(chr(39), chr(39) * 2)}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@query("page_micro_intents", "H29", rf"""
WITH b AS (SELECT page_id, {_HEAD.format('title')} || ' ' || {_HEAD.format('h1')} AS t, len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g')), '\s+'), lambda x: x <> '')) AS words FROM pages),
h AS (SELECT page_id, words, {_has('definitional')} AS d, {_has('how-to')} AS h, {_has('troubleshooting')} AS r, {_has('comparison')} AS c, {_has('curated-list')} AS l FROM b),
s AS (SELECT page_id, list_sort([struct_pack(s := 0.8 * d + CASE WHEN d > 0 AND words >= 300 THEN 0.2 ELSE 0.0 END, o := 0, n := 'definitional'), struct_pack(s := 0.5 * h, o := -1, n := 'how-to'), struct_pack(s := 0.7 * r, o := -2, n := 'troubleshooting'),
  struct_pack(s := 0.5 * c, o := -3, n := 'comparison'), struct_pack(s := 0.6 * l + 0.1, o := -4, n := 'curated-list')], 'DESC') AS k FROM h),
x AS (SELECT page_id, k[1] AS top, list_transform(list_filter(k[2:], lambda y: y.s >= 0.3 AND y.s >= k[1].s * 0.8), lambda y: y.n) AS rivals FROM s)
SELECT page_id, CASE WHEN top.s >= 0.3 THEN top.n END AS intent, CASE WHEN top.s >= 0.3 THEN array_to_string(rivals, ',') END AS mixed, round(top.s, 4) AS score,
  CASE WHEN top.s >= 0.3 THEN floor(top.s * CASE WHEN len(rivals) > 0 THEN 0.8 ELSE 1 END * 100 + 0.5) / 100 ELSE 0.0 END AS confidence FROM x""")
def _(t: Tables):
    return scores.micro_intents(extract.page_features(extract.parse(t.pages)))
