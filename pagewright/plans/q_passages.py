"""Passages, claims, mentions and gaps over documents, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import extract, passages as ops, readiness, scores, similarity
from pagewright.plans.inputs import TERMS_SQL, cte, doc_terms
from pagewright.plans.q_similarity import _NEAR
from pagewright.plans.registry import Tables, query
from pagewright.session import cut_lineage


def _lines(t: Tables):
    """Documents as one section each, their lines as paragraphs, the first words as heading."""
    return t.documents.select("doc_id", "lang", F.lit(0).alias("section"), F.substring("text", 1, 24).alias("heading"), F.lit(2).alias("level"), F.filter(F.split("text", r"\n"), lambda p: p != "").alias("paragraphs"))


@query("passage_windows", "L21", r"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents),
n AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p),
s AS MATERIALIZED (SELECT doc_id, i, len(regexp_extract_all(regexp_replace(x, '[\p{P}\p{S}]', ' ', 'g'), '[^\s\x0B]+')) AS n FROM n),
f(doc_id, i, w, total, last, back) AS (
  SELECT doc_id, i, 0, n, n, 0 FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN total + n > 300 THEN w + 1 ELSE w END, CASE WHEN total + n > 300 THEN n + CASE WHEN last <= 60 THEN last ELSE 0 END ELSE total + n END, n,
    CASE WHEN total + n > 300 AND last <= 60 THEN 1 ELSE 0 END FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
SELECT doc_id, w::INTEGER AS "window", (max(i) - min(i) + 1 + max(back))::INTEGER AS paragraphs, arg_max(total, i)::INTEGER AS tokens FROM f GROUP BY doc_id, w""")
def _(t: Tables):
    return readiness.section_windows(_lines(t)).select("doc_id", "window", F.size("paragraphs").alias("paragraphs"), "tokens")


@query("passage_chunks", "L21")
def _(t: Tables):
    return readiness.sentence_windows(_lines(t)).drop("paragraphs")


@query("passage_scores", "L22")
def _(t: Tables):
    # Scoring takes far longer than reading, so tasks go by documents and not by the splits of a few files.
    rows = readiness.window_scores(readiness.sentence_windows(_lines(t).repartition("doc_id")), readiness.rules_table(t.spark))
    return rows.withColumn("codes", F.array_join("codes", ",")).withColumn("fact_density", F.round("fact_density", 9))


@query("page_readiness", "L23 F10")
def _(t: Tables):
    # Sections of the pages' own markup: windows are scored, structure counts a fifth.
    sections = cut_lineage(extract.sections(extract.parse(t.pages)))
    lang = F.regexp_extract("html", r'<html lang="([a-z]+)', 1).alias("lang")
    windows = readiness.sentence_windows(sections.join(t.pages.select("page_id", lang), "page_id"))
    scored = readiness.window_scores(windows, readiness.rules_table(t.spark))
    return readiness.page_scores(scored, readiness.extractability(sections)).withColumn("weak_windows", F.size("weak_windows")).withColumn("extractability", F.round("extractability", 6))


@query("page_extractability", "L23", """
WITH h AS (SELECT page_id, html LIKE '%<table%' AS tables, len(regexp_extract_all(html, '<h[23][ >]')) AS outline FROM pages)
SELECT page_id, round(0.3 * tables::INT + 0.2 * least(1, outline / 4), 6)::DOUBLE AS extractability FROM h""")
def _(t: Tables):
    return readiness.extractability(extract.sections(extract.parse(t.pages))).withColumn("extractability", F.round("extractability", 6))


_PS = "SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_quantity * 2 AS score FROM lineitem"


def _cells(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") * 2).alias("score"), F.col("l_partkey").alias("tie"))


@query("weak_passages", "F10", "WITH p AS (SELECT l_suppkey AS doc_id, l_orderkey * 8 + l_linenumber AS pos, l_quantity AS score FROM lineitem WHERE l_quantity < 20), u AS (SELECT doc_id, pos, min(score) AS score FROM p GROUP BY 1, 2) SELECT doc_id, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score, pos)::INTEGER AS rank FROM u QUALIFY rank <= 5")
def _(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")).agg(F.min("l_quantity").alias("score"))
    return ops.weak_passages(rows, below=20)


@query("passage_heat", "L20", f"WITH p AS ({_PS}) SELECT doc_id, count(*)::BIGINT AS cells, round(avg(score), 6) AS mean, min(score) AS worst, CASE WHEN min(score) < 30 THEN 'rewrite' WHEN avg(score) < 50 THEN 'strengthen' ELSE 'keep' END AS advice FROM p GROUP BY 1")
def _(t: Tables):
    return ops.passage_heat(_cells(t), ["doc_id"]).withColumn("mean", F.round("mean", 6))


def _claim_docs(t: Tables):
    """Every document with a claim, or none, written after its text."""
    d = F.col("doc_id")
    end = (
        F.when(d % 6 == 0, F.concat(F.lit(". A study of 40 patients (Smith et al., 2019) agrees with ["), d % 12, F.lit("].")))
        .when(d % 6 == 1, F.concat(F.lit(". The dose was 12 mg. See https://r.example/"), d % 20, F.lit(".")))
        .when(d % 6 == 2, ". Risk fell by 30 %. Nothing more.").when(d % 6 == 3, ". Research agrees. PMID: 77 says so.")
        .when(d % 6 == 4, F.concat(F.lit(". Badania trwały 5 lat. Dane PMID: "), d % 30 + 1, F.lit(" są.")))
        .otherwise(".")
    )
    return t.documents.select("doc_id", F.concat("text", end).alias("text"))


_CLAIM_TEXTS = """SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN '. A study of 40 patients (Smith et al., 2019) agrees with [' || (doc_id % 12) || '].'
  WHEN 1 THEN '. The dose was 12 mg. See https://r.example/' || (doc_id % 20) || '.' WHEN 2 THEN '. Risk fell by 30 %. Nothing more.' WHEN 3 THEN '. Research agrees. PMID: 77 says so.'
  WHEN 4 THEN '. Badania trwały 5 lat. Dane PMID: ' || (doc_id % 30 + 1) || ' są.' ELSE '.' END AS x FROM documents"""
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_REFS = r"""list_sort(list_distinct(list_concat(list_concat(
  list_transform(regexp_extract_all({0}, '(?i)\\b(10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+)\\b', 1), lambda y: 'doi:' || lower(regexp_replace(y, '[.,;:]+$', ''))), list_transform(regexp_extract_all({0}, '(?i)\\b(PMC[0-9]{{4,9}})\\b', 1), lambda y: 'pmcid:' || lower(y))),
  list_concat(list_concat(list_transform(regexp_extract_all({0}, '(?i)\\bPMID\\s*:?[\\s#]*([0-9]{{1,9}})\\b', 1), lambda y: 'pmid:' || y), list_transform(regexp_extract_all({0}, '(?i)(https?://[^\\s)\\]>]+)', 1), lambda y: 'url:' || lower(regexp_replace(y, '[.,;:]+$', '')))),
  list_concat(list_transform(regexp_extract_all({0}, '\\[([0-9]{{1,3}})\\]', 1), lambda y: 'numeric:' || y), list_transform(regexp_extract_all({0}, '\\(([A-ZÀ-Ž][\\wÀ-ž''-]+(?:\\s+et\\s+al\\.)?[,; ]+[0-9]{{4}})\\)', 1), lambda y: 'author-year:' || lower(y)))))))""".replace("\\\\", "\\")


@query("claim_citations", "C29 H26", cte(
    x=_CLAIM_TEXTS,
    s=f"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(x, '([.!?…。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, {_STRIP})), lambda y: y <> '') AS s FROM x",
    e="SELECT doc_id, s, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM s",
    c=r"""SELECT * FROM e WHERE regexp_matches(sentence, '(?i)\b(?:study|studies|research|trial|patients?|risk|odds|caus(?:e|es|ed|al)|treatment|dose|mg|percent|%|badania|pacjent|ryzyko|dawka|skutek)\b|\d+(?:[.,]\d+)?\s*(?:%|mg|kg|lat|years?|dni|days?)')""",
    r=f"SELECT doc_id, i, {_REFS.format('sentence')} AS own, list_distinct(list_concat({_REFS.format('coalesce(s[nullif(i - 1, 0)], chr(32))')}, {_REFS.format('coalesce(s[i + 1], chr(32))')})) AS near FROM c",
    q="SELECT doc_id, i, CASE WHEN len(own) > 0 THEN 'same-sentence' WHEN len(near) > 0 THEN 'adjacent-sentence' ELSE 'unmatched' END AS relation, CASE WHEN len(own) > 0 THEN own ELSE near END AS refs FROM r",
    k="SELECT 'url:https://r.example/' || s_suppkey AS ref, s_suppkey % 2 = 0 AS ok FROM supplier WHERE s_suppkey < 15 UNION ALL SELECT 'numeric:' || s_suppkey, s_suppkey % 4 = 1 FROM supplier WHERE s_suppkey < 9",
) + """
SELECT doc_id, (i - 1)::INTEGER AS pos, relation, len(refs)::BIGINT AS refs, count(k.ref)::BIGINT AS known, bool_or(k.ok) AS supported
FROM (SELECT q.*, unnest(CASE WHEN len(refs) = 0 THEN [NULL] ELSE refs END) AS ref FROM q) u LEFT JOIN k USING (ref) GROUP BY doc_id, i, relation, len(refs)""")
def _(t: Tables):
    n = F.col("s_suppkey")
    web = t.supplier.where(n < 15).select(F.concat(F.lit("url:https://r.example/"), n).alias("ref"), (n % 2 == 0).alias("supports"))
    listed = t.supplier.where(n < 9).select(F.concat(F.lit("numeric:"), n).alias("ref"), (n % 4 == 1).alias("supports"))
    return ops.claims(_claim_docs(t), web.union(listed))


@query("claim_source_overlap", "L26", """
WITH p AS (SELECT item_id, list_distinct(regexp_extract_all(lower(b.text), '([\\p{L}\\p{N}]+)', 1)) AS c, regexp_extract_all(lower(d.text), '([\\p{L}\\p{N}]+)', 1) AS s FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = item_id), o AS (SELECT item_id, len(list_filter(c, lambda x: list_contains(s, x))) / len(c) AS v FROM p WHERE len(c) > 0)
SELECT item_id, CASE WHEN v >= 0.6 THEN 'supported' WHEN v >= 0.3 THEN 'partial' ELSE 'unsupported' END AS band, count(*)::BIGINT AS n FROM o GROUP BY 1, 2""")
def _(t: Tables):
    j = t.benchmark.select("item_id", F.col("text").alias("c")).join(t.documents.select((F.col("doc_id") % t.benchmark.agg(F.count("*")).scalar()).alias("item_id"), F.col("text").alias("s")), "item_id")
    return j.select("item_id", ops.claim_overlap(F.col("c"), F.col("s"))[1].alias("band")).where("band IS NOT NULL").groupBy("item_id", "band").agg(F.count("*").alias("n"))


_NAMES = r"(^|[^\p{L}\p{N}])(la|C\+\+)($|[^\p{L}\p{N}])"
_TOKEN = r"[^\p{L}\p{N}''’-]"
_CUES = dict(
    critical="|".join(ops.CRITICAL_STEMS[:-3]).replace("'", "''"), anywhere="|".join(ops.CRITICAL_STEMS[-3:]),
    negated="|".join(w.replace("'", "['']") for w in ops.NEGATIONS).replace("['']", "[''’]"), unspaced=ops.NEGATIONS_UNSPACED,
)


@query("mention_stances", "H27 C31", cte(
    x="SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'C++ is a fraud de facto.' WHEN 1 THEN chr(10) || 'Staff of C++ said de.' WHEN 2 THEN chr(10) || 'It doesn''t need C++ de.' ELSE '' END AS x FROM documents",
    p="SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS p FROM (SELECT doc_id, string_split_regex(x, '\\n+') AS p FROM x)".replace("\\\\", "\\"),
    h=rf"SELECT * FROM p WHERE regexp_matches(p, '(?i){_NAMES}') AND regexp_matches(p, '(?i)(^|[^\p{{L}}\p{{N}}])(de)($|[^\p{{L}}\p{{N}}])')",
    s="SELECT doc_id, pos, unnest(string_split(regexp_replace(p, '([.!?…。！？])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM h".replace("\\\\", "\\"),
    r=rf"""SELECT doc_id, pos, CASE WHEN regexp_matches(s, '(?i)(^|{_TOKEN})({_CUES['critical']})|{_CUES['anywhere']}') THEN 3
  WHEN regexp_matches(s, '(?i)(^|{_TOKEN})({_CUES['negated']})($|{_TOKEN})|\p{{L}}n[''’]t($|{_TOKEN})') OR regexp_matches(s, '{_CUES['unspaced']}') THEN 2
  WHEN regexp_matches(s, '(?i)\b(?:according to|said|says|claims?|allegedly)\b|według|zdaniem|twierdzi|podobno|\blaut\b|\bselon\b|\bsegún\b|\bsecondo\b|\bsegundo\b|по словам|据|によると|에 따르면')
    OR regexp_matches(s, '(?i)["„“«「『][^"”»」』]*(?:la|C\+\+)[^"”»」』]*["”»」』]') THEN 1 ELSE 0 END AS r FROM s WHERE regexp_matches(s, '(?i){_NAMES}')""",
) + "SELECT h.doc_id, h.pos::INTEGER AS pos, h.doc_id % 2 = 0 AS linked, ['neutral', 'quoted', 'negated', 'critical'][coalesce(max(r), 0) + 1] AS stance FROM h LEFT JOIN r USING (doc_id, pos) GROUP BY 1, 2")
def _(t: Tables):
    # Every line of every document that names la (or a name full of signs) next to de; the cues are the texts' own words.
    d = F.col("doc_id")
    more = F.when(d % 5 == 0, "\nC++ is a fraud de facto.").when(d % 5 == 1, "\nStaff of C++ said de.").when(d % 5 == 2, "\nIt doesn't need C++ de.").otherwise("")
    rows = t.documents.select("doc_id", F.posexplode(F.split(F.concat("text", more), r"\n+")).alias("pos", "paragraph"), (d % 2 == 0).alias("linked"))
    return ops.cocitations(rows, ["la", "C++"], "de")


@query("anchor_contexts", "C30", """
WITH l AS (SELECT doc_id AS link, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id END AS source, CASE WHEN doc_id % 5 = 0 THEN 'qqzz \\E(' ELSE ' ' || lower(substr(text, 21, 4 + (doc_id % 16)::INTEGER)) || ' ' END AS anchor FROM documents),
j AS (SELECT link, d.text, lower(d.text) AS low, trim(anchor) AS a, lower(trim(anchor)) AS needle FROM l LEFT JOIN documents d ON d.doc_id = l.source),
h AS (SELECT *, CASE WHEN text IS NULL THEN 'source-missing' WHEN needle = '' THEN 'not-found' WHEN (length(low) - length(replace(low, needle, ''))) // length(needle) = 1 THEN 'located' WHEN (length(low) - length(replace(low, needle, ''))) // length(needle) > 1 THEN 'ambiguous' ELSE 'not-found' END AS state FROM j)
SELECT link, state, CASE WHEN state = 'located' THEN substr(text, greatest(strpos(low, needle) - 40, 1), length(a) + 80) END AS excerpt FROM h""".replace("\\\\", "\\"))
def _(t: Tables):
    d = F.col("doc_id")
    anchor = F.when(d % 5 == 0, "qqzz \\E(").otherwise(F.concat(F.lit(" "), F.lower(F.substring("text", F.lit(21), (4 + d % 16).cast("int"))), F.lit(" ")))
    links = t.documents.select(d.alias("link"), F.when(d % 7 == 0, -1).otherwise(d).alias("source"), anchor.alias("anchor"))
    return ops.anchor_context(links, t.documents.select(d.alias("source"), "text"))


@query("phrase_evidence", "H17", """
SELECT doc_id, len(regexp_extract_all(lower(text), '(?:^|[^\\p{L}\\p{N}])of\\s+the(?:$|[^\\p{L}\\p{N}])'))::INTEGER AS in_body FROM documents""")
def _(t: Tables):
    return ops.phrase_evidence(t.documents, "of the", {"body": "text"}).select("doc_id", "in_body")


@query("evidence_densities", "H25", r"""
WITH x AS (SELECT doc_id, len(string_split(text, ' ')) AS w, text || '. doi 10.1234/ab ' || repeat('12 kg, ', (doc_id % 4)::INTEGER) || repeat('We tested it. ', (doc_id % 3)::INTEGER) || CASE WHEN doc_id % 5 = 0 THEN 'for €30 and 4,5 zł, so' ELSE '' END AS x FROM documents),
c AS (SELECT doc_id, w, len(regexp_extract_all(x, '(?i)\b10\.\d{4,9}/[^\s"<>]+')) + len(regexp_extract_all(x, '(?i)\bPMID:?\s*\d{4,9}\b')) AS refs,
  len(regexp_extract_all(x, '(?:^|[^\p{L}\p{N}.,/])\d+(?:[.,]\d+)?\s?(?:%|°[CF]|k?g|mg|km|cm|mm|m|ms|min|h|kWh|W|MB|GB|px|zł|PLN|EUR|USD|[$€£])(?:$|[^\p{L}\p{N}])')) + len(regexp_extract_all(x, '[$€£]\s?\d+(?:[.,]\d+)?(?:$|[^\p{L}\p{N}])')) AS q,
  len(regexp_extract_all(x, '(?i)\b(?:we|i)\s+(?:tested|measured|ran|benchmarked|interviewed|surveyed|built)\b')) + len(regexp_extract_all(x, '(?i)\b(?:przetestowa|zmierzy|sprawdzi|zbadali|przeprowadzi)')) + len(regexp_extract_all(x, '(?i)\bin our (?:test|study|experiment|survey)s?\b')) AS f FROM x)
SELECT doc_id, round(least(1, (refs + 0.5 * q) / greatest(1, w / 1000) / 3), 6) AS evidence, round(least(1, f / 3), 6) AS first_hand FROM c""")
def _(t: Tables):
    d = F.col("doc_id")
    body = F.concat("text", F.lit(". doi 10.1234/ab "), F.repeat(F.lit("12 kg, "), (d % 4).cast("int")), F.repeat(F.lit("We tested it. "), (d % 3).cast("int")), F.when(d % 5 == 0, "for €30 and 4,5 zł, so").otherwise(""))
    return t.documents.select("doc_id", F.round(ops.evidence_density(body, F.size(F.split("text", " "))), 6).alias("evidence"), F.round(ops.first_hand(body), 6).alias("first_hand"))


@query("entity_candidates", "H31", r"""
WITH e AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[\p{Ll}\p{N},] (\p{Lu}[\p{L}\p{N}''’-]+(?: \p{Lu}[\p{L}\p{N}''’-]+)*)', 1))) AS entity FROM documents)
SELECT entity, count(*)::BIGINT AS texts FROM e GROUP BY 1 HAVING count(*) >= 2""")
def _(t: Tables):
    return ops.entity_candidates(t.documents)


@query("query_topic_evidence", "C35", """
WITH q AS (SELECT p_partkey AS query, p_size AS topic, unnest(string_split(p_name, ' ')) AS term FROM part), n AS (SELECT query, count(DISTINCT term) AS n FROM q GROUP BY 1), pt AS (SELECT DISTINCT p_partkey % 60 AS page, unnest(string_split(p_name, ' ')) AS term FROM part),
f AS (SELECT q.query, count(DISTINCT q.term) AS f FROM q JOIN pt ON pt.term = q.term AND pt.page = q.topic % 60 GROUP BY 1)
SELECT query, n::BIGINT AS terms, coalesce(f, 0)::BIGINT AS found, CASE WHEN f = n THEN 'observed' WHEN f > 0 THEN 'partial' ELSE 'never-observed' END AS state FROM n LEFT JOIN f USING (query)""")
def _(t: Tables):
    q = t.part.select(F.col("p_partkey").alias("query"), F.col("p_size").alias("topic"), F.col("p_name").alias("text"))
    pages = t.part.select(F.col("p_size").alias("topic"), (F.col("p_size") % 60).alias("page")).distinct()
    terms = t.part.select((F.col("p_partkey") % 60).alias("page"), F.explode(text.words(F.col("p_name"))).alias("term"))
    return ops.query_evidence(q, pages, terms)


@query("content_gap_terms", "L25", cte(x=TERMS_SQL, r="SELECT source AS phrase, doc_id AS page, term FROM x WHERE (doc_id // 20) % 5 <> 0", g="SELECT source AS phrase, term FROM x WHERE (doc_id // 20) % 5 = 0", n="SELECT phrase, count(DISTINCT page) AS n FROM r GROUP BY 1") +
"SELECT phrase, term, count(*)::BIGINT AS df, round(count(*) / max(n), 6) AS share FROM r JOIN n USING (phrase) WHERE (phrase, term) NOT IN (SELECT (phrase, term) FROM g) GROUP BY 1, 2 HAVING count(*) / max(n) >= 0.05")
def _(t: Tables):
    x = doc_terms(t).select(F.col("source").alias("phrase"), F.col("doc_id").alias("page"), "term")
    own = (F.floor(F.col("page") / 20) % 5) == 0
    return ops.content_gap(x.where(own), x.where(~own), 0.05).withColumn("share", F.round("share", 6))


@query("nearest_documents", "F9", "WITH p AS (SELECT l_suppkey AS a, 1000 + l_partkey % 500 AS b, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2), u AS (SELECT a AS doc, b AS other, s FROM p UNION ALL SELECT b, a, s FROM p) SELECT doc, arg_min(other, (-s, other)) AS other, max(s) AS similarity FROM u GROUP BY 1")
def _(t: Tables):
    pairs = t.lineitem.groupBy(F.col("l_suppkey").alias("left"), (1000 + F.col("l_partkey") % 500).alias("right")).agg(F.max("l_quantity").alias("similarity"))
    return ops.nearest_document(pairs)


@query("centroid_shifts", "L24 D33", """
WITH e AS (SELECT label, vec_id % 2 AS half, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT label, half, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e), c AS (SELECT label, half, d, avg(u[d]) AS x FROM u, generate_series(1, 64) g(d) GROUP BY 1, 2, 3), z AS (SELECT label, half, list(x ORDER BY d) AS c FROM c GROUP BY 1, 2)
SELECT a.label AS query, CASE WHEN a.label % 4 <> 3 THEN round(greatest(0, 1 - list_cosine_similarity(a.c, b.c)), 6) END AS shift, CASE WHEN a.label % 4 = 3 THEN 'model-changed' END AS reason FROM z a JOIN z b ON a.label = b.label AND a.half = 0 AND b.half = 1""")
def _(t: Tables):
    side = lambda h: scores.centroids(t.embeddings.where(F.col("vec_id") % 2 == h).select(F.col("label").alias("query"), F.col("embedding").alias("v")), ["query"])
    a, b = side(0).withColumn("model", F.lit("m")), side(1).withColumn("model", F.when(F.col("query") % 4 == 3, "n").otherwise("m"))
    return ops.centroid_shift(a, b).withColumn("shift", F.round("shift", 6))


@query("passage_zones", "L18", """
WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.id, max(round(list_cosine_similarity(a.v, b.v), 9)) AS nearest FROM e a JOIN e b ON a.id % 5 = 0 AND b.id % 5 <> 0 GROUP BY 1),
u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e WHERE id % 5 <> 0), c AS (SELECT label, d, avg(u[d]) AS x FROM u, generate_series(1, 64) g(d) GROUP BY 1, 2), z AS (SELECT label, list(x ORDER BY d) AS c FROM c GROUP BY 1),
t AS (SELECT e.label AS query, e.id, list_cosine_similarity(v, c) AS topic, coalesce(nearest, 0) AS nearest FROM e JOIN z USING (label) LEFT JOIN n USING (id) WHERE e.id % 5 = 0)
SELECT query, id, round(topic, 6) AS topic, round(nearest, 6) AS nearest, CASE WHEN nearest >= 0.82 THEN 'echo' WHEN topic >= 0.48 THEN 'gain' WHEN nearest < 0.6 THEN 'drift' ELSE 'neutral' END AS zone FROM t""")
def _(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("query"))
    own, other = v.where("id % 5 = 0"), v.where("id % 5 <> 0")
    rows = ops.passage_zones(own, similarity.vector_top_k(own, other, 1), scores.centroids(other, ["query"]))
    return rows.withColumn("topic", F.round("topic", 6)).withColumn("nearest", F.round("nearest", 6))


@query("subtopic_coverage", "L16", cte(x=TERMS_SQL, r="SELECT source AS subtopic, term, sum(n)::DOUBLE AS rw FROM x GROUP BY 1, 2", np="SELECT doc_id AS page, sqrt(sum(n * n)) AS np FROM x GROUP BY 1", nr="SELECT subtopic, sqrt(sum(rw * rw)) AS nr FROM r GROUP BY 1",
    d="SELECT subtopic, doc_id AS page, sum(n * rw) AS dot FROM x JOIN r USING (term) GROUP BY 1, 2", c="SELECT subtopic, page, dot / (np * nr) AS cos FROM d JOIN np USING (page) JOIN nr USING (subtopic)",
    b="SELECT subtopic, arg_min(page, (-round(cos, 9), page)) AS page, max(round(cos, 9)) AS cos FROM c GROUP BY 1") + """
SELECT subtopic, CASE WHEN cos >= 0.60 THEN page END AS page, round(cos, 6) AS similarity, CASE WHEN cos >= 0.78 THEN 1.0::DOUBLE WHEN cos >= 0.60 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS coverage FROM b""")
def _(t: Tables):
    x = doc_terms(t)
    pages = x.select(F.col("doc_id").alias("page"), "term", F.col("n").cast("double").alias("weight"))
    refs = cut_lineage(x.groupBy(F.col("source").alias("subtopic"), "term").agg(F.sum("n").cast("double").alias("weight")))  # read three times
    return ops.subtopic_coverage(pages, refs).withColumn("similarity", F.round("similarity", 6))


_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"


@query("content_term_density", "D39", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) AS term FROM documents), f AS (SELECT *, replace(strip_accents(term), 'ß', 'ss') AS f FROM w),
k AS (SELECT doc_id, term, count(*) AS n FROM f WHERE f NOT IN """ + _STOP + r""" AND length(regexp_replace(f, '[^\p{L}]', '', 'g')) >= 2 AND length(regexp_replace(f, '[^\p{N}]', '', 'g')) < length(regexp_replace(f, '[^\p{L}]', '', 'g')) GROUP BY 1, 2)
SELECT doc_id, term, n::BIGINT AS n, round(n * 100.0 / sum(n) OVER (PARTITION BY doc_id), 6)::DOUBLE AS density FROM k""")
def _(t: Tables):
    return ops.reference_terms(t.documents).withColumn("density", F.round("density", 6))


@query("information_gain_scores", "L19", """
SELECT c_custkey AS query, CASE WHEN c_custkey % 10 >= 4 THEN floor(100 * (0.35::DOUBLE * ((c_custkey % 7) / 8) + 0.30::DOUBLE * ((c_custkey % 5) / 8) + 0.20::DOUBLE * ((c_custkey % 3) / 8) + 0.15::DOUBLE * ((c_custkey % 11) / 16)) * least(1, 0.5 + (c_custkey % 9) / 8) + 0.5)::BIGINT END AS gain, CASE WHEN c_custkey % 10 >= 4 THEN 'ready' ELSE 'off-topic' END AS state FROM customer""")
def _(t: Tables):
    c = F.col("c_custkey")
    parts = t.customer.select(c.alias("query"), (c % 10 / 10).alias("on_topic"), (c % 7 / 8).alias("novelty"), (c % 5 / 8).alias("evidence"), (c % 3 / 8).alias("first_hand"), (c % 11 / 16).alias("divergence"), (c % 9 / 8).alias("coverage"))
    return ops.information_gain(parts)


@query("blended_result_similarity", "L13", """
WITH p AS (SELECT c_custkey AS a, (c_custkey % 10) / 10.0::DOUBLE AS sem, [c_custkey % 5, c_custkey % 7, 20] AS ua, CASE WHEN c_custkey % 6 <> 0 THEN [c_custkey % 5, 20, 21] END AS ub, c_custkey % 4 = 0 AS diff FROM customer),
j AS (SELECT *, len(list_intersect(list_distinct(ua), list_distinct(ub))) / len(list_distinct(list_concat(ua, ub))) AS jac FROM p)
SELECT a, round(CASE WHEN ub IS NULL OR diff THEN sem ELSE 0.7 * sem + 0.3 * jac END, 6) AS similarity, CASE WHEN ub IS NULL THEN 'no-results' WHEN diff THEN 'different-context' END AS reason FROM j""")
def _(t: Tables):
    c = F.col("c_custkey")
    pairs = t.customer.select(
        c.alias("a"), (c + 1).alias("b"), (c % 10 / 10).alias("semantic"), F.array(c % 5, c % 7, F.lit(20).cast("long")).alias("urls_a"), F.when(c % 6 != 0, F.array(c % 5, F.lit(20).cast("long"), F.lit(21).cast("long"))).alias("urls_b"),
        F.lit("x").alias("context_a"), F.when(c % 4 == 0, "y").otherwise("x").alias("context_b"),
    )
    return ops.blended_result_similarity(pairs).select("a", F.round("similarity", 6).alias("similarity"), "reason")


def _sections(t: Tables):
    # Turns of a conversation as sections of a page, role as heading.
    return t.conversations.select(F.col("conv_id").alias("page"), F.col("turn").alias("section"), F.col("role").alias("heading"), (2 + F.col("turn") % 3).alias("level"), F.col("text").alias("body"))


_BEST = """WITH w AS (SELECT conv_id AS page, turn AS section, role AS heading, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS term FROM conversations WHERE 2 + turn % 3 IN (2, 3)), k AS (SELECT DISTINCT item_id AS page, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS term FROM benchmark),
h AS (SELECT w.page, section, heading, count(*) AS hits FROM w JOIN k ON k.page = w.page AND k.term = w.term GROUP BY 1, 2, 3), b AS (SELECT page, arg_min({'s': section, 'h': heading, 'n': hits}, (-hits, section)) AS b FROM h GROUP BY 1)"""


def _best(t: Tables):
    terms = t.benchmark.select(F.col("item_id").alias("page"), F.explode(text.words(F.col("text"))).alias("term"))
    return ops.best_section(_sections(t), terms)


@query("best_link_sections", "F6", _BEST + " SELECT page, b.s AS section, b.h AS heading, b.n::BIGINT AS hits FROM b")
def _(t: Tables):
    return _best(t)


@query("link_injections", "F7", _BEST + """, o AS (SELECT l_suppkey AS source, l_partkey AS target, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, target) AS rank FROM o)
SELECT source, target, rank::INTEGER AS rank, b.s AS section FROM r LEFT JOIN b ON b.page = source WHERE rank <= 3""")
def _(t: Tables):
    opp = t.lineitem.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.max("l_quantity").alias("similarity"))
    return ops.link_injections(opp, _best(t)).select("source", "target", "rank", "section")


@query("candidate_page_pairs", "L17", cte(**_NEAR, i="SELECT DISTINCT doc_id, coalesce(lang, '~') AS lang, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS term FROM documents",
    k_="SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, string_agg(lang || chr(31) || term, chr(30) ORDER BY lang, term) AS items FROM i GROUP BY 1) GROUP BY items", n_="SELECT i.* FROM i JOIN k_ USING (doc_id)",
    h_="SELECT a.doc_id AS l, b.doc_id AS r FROM n_ a JOIN n_ b ON a.lang = b.lang AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 6",
    d_="SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(lower(text))) AS first FROM documents",
    every="""SELECT first AS l, doc_id AS r, 'same-content' AS basis FROM d_ WHERE doc_id <> first UNION ALL SELECT "left", "right", 'fingerprint' FROM p UNION ALL SELECT l, r, 'topic-term' FROM h_""")
    + "SELECT l AS \"left\", r AS \"right\", string_agg(DISTINCT basis, ',' ORDER BY basis) AS basis FROM every GROUP BY 1, 2")
def _(t: Tables):
    d = t.documents.select("lang", "doc_id", "text")
    pages = d.select(F.col("doc_id").alias("page"), F.sha2(F.lower("text"), 256).alias("content_hash"))
    near = similarity.near_duplicates(d, ["lang"]).select("left", "right")
    terms = doc_terms(t).select(F.col("lang").alias("topic"), F.col("doc_id").alias("page"), "term")
    return ops.candidate_pages(pages, near, terms, 6)
