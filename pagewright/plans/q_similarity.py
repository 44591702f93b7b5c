"""De-duplication, set similarity, vector neighbours and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import numbers, text
from pagewright.operators import similarity as ops, termblocks
from pagewright.plans.inputs import TERMS_SQL, cte
from pagewright.plans.registry import Tables, query
from pagewright.session import cut_lineage, release

_SIG = dict(
    w="SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM docs",
    g="SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS g FROM w WHERE len(w) > 0",
    h="SELECT doc_id, CAST('0x' || substr(sha256(g), 1, 16) AS UBIGINT) AS h FROM g",
    v="SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1::UBIGINT = 1::UBIGINT THEN 1 ELSE -1 END) AS s FROM h, (SELECT b::UBIGINT AS b FROM generate_series(0, 63) y(b)) x GROUP BY 1, 2",
    sig="SELECT doc_id, bit_or(CASE WHEN s >= 0 THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS sig FROM v GROUP BY 1",
)


@query("text_fingerprints", "L1", cte(docs="SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations", **_SIG) + "SELECT doc_id, printf('%016x', sig) AS simhash FROM sig")
def _(t: Tables):
    docs = t.benchmark.select(F.col("item_id").alias("doc_id"), "text").union(t.conversations.select(1000 + F.col("conv_id") * 100 + F.col("turn"), "text"))
    return ops.simhash(docs).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


_FIRST = "SELECT lang, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY lang, sha256(lower(text))"
_LONG = "SELECT * FROM f WHERE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) >= 20"
_NEAR = dict(f=_FIRST, docs=_LONG, **_SIG, s="SELECT lang, doc_id, sig FROM sig JOIN docs USING (doc_id)",
             o="SELECT lang, sig, min(doc_id) AS id FROM s GROUP BY 1, 2",
             p="SELECT a.lang, a.id AS \"left\", b.id AS \"right\", bit_count(xor(a.sig, b.sig))::INTEGER AS distance FROM o a JOIN o b ON a.lang = b.lang AND a.id < b.id WHERE bit_count(xor(a.sig, b.sig)) <= 7 UNION ALL SELECT s.lang, o.id, s.doc_id, 0 FROM s JOIN o ON o.lang = s.lang AND o.sig = s.sig WHERE s.doc_id <> o.id")


@query("near_duplicate_documents", "L2", cte(**_NEAR) + 'SELECT lang, "left", "right", distance FROM p')
def _(t: Tables):
    return ops.near_duplicates(t.documents.select("lang", "doc_id", "text"), ["lang"])


@query("exact_duplicate_documents", "D7", "SELECT lang, sha256(lower(text)) AS content_hash, count(*)::BIGINT AS copies, min(doc_id) AS first FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables):
    return ops.exact_groups(t.documents, ["lang"])


_MEMBERS = cte(**_NEAR).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
x AS (SELECT "left" AS a, "right" AS b FROM p UNION SELECT "right", "left" FROM p), r(node, seen) AS (SELECT a, a FROM x UNION SELECT r.node, x.b FROM r JOIN x ON x.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1),
e AS (SELECT doc_id, min(doc_id) OVER w AS node, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY lang, sha256(lower(text)))),
m AS (SELECT doc_id, coalesce(component, node) AS component FROM e LEFT JOIN c USING (node) WHERE copies > 1 OR component IS NOT NULL)
"""


@query("duplicate_members", "L3", _MEMBERS + "SELECT doc_id, component FROM m")
def _(t: Tables):
    docs = t.documents.select("lang", "doc_id", "text")
    return ops.duplicate_members(docs, ops.near_duplicates(docs, ["lang"]), ["lang"])


@query("duplicate_groups", "L3", _MEMBERS + """
SELECT component, count(DISTINCT m.doc_id)::BIGINT AS members, coalesce(max(distance), 0)::INTEGER AS widest FROM m LEFT JOIN p ON p."left" = m.doc_id GROUP BY 1""")
def _(t: Tables):
    return ops.duplicate_groups(t.documents.select("lang", "doc_id", "text"), ["lang"])


@query("near_duplicate_images", "L4", """
WITH h AS (SELECT p_partkey AS id, (p_partkey % 40) * 1000003 * 7919 * 104729 + (1::BIGINT << CAST(p_partkey % 11 AS INTEGER)) + (1::BIGINT << CAST(20 + p_partkey % 7 AS INTEGER)) AS sig FROM part), o AS (SELECT sig, min(id) AS id FROM h GROUP BY 1)
SELECT a.id AS "left", b.id AS "right", bit_count(xor(a.sig, b.sig))::INTEGER AS distance FROM o a JOIN o b ON a.id < b.id WHERE bit_count(xor(a.sig, b.sig)) <= 8""")
def _(t: Tables):
    p = F.col("p_partkey")
    one = F.lit(1).cast("long")
    sig = (p % 40) * 1000003 * 7919 * F.lit(104729).cast("long") + F.call_function("shiftleft", one, (p % 11).cast("int")) + F.call_function("shiftleft", one, (20 + p % 7).cast("int"))
    return ops.near_hash_pairs(t.part.select(p.alias("id"), sig.alias("phash")), [], 8, "id", "phash", same=2)


_W = dict(t=TERMS_SQL, n="SELECT lang, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1", d="SELECT lang, term, count(*) AS df FROM t GROUP BY 1, 2", w="SELECT t.lang, doc_id, term, ln(1 + docs / df) AS w FROM t JOIN n USING (lang) JOIN d USING (lang, term)",
          s="SELECT lang, doc_id, sum(w) AS total, string_agg(term, ' ' ORDER BY term) AS key FROM w GROUP BY 1, 2", o="SELECT lang, min(doc_id) AS doc_id, arg_min(total, doc_id) AS total FROM s GROUP BY lang, key")


def _terms(t: Tables):
    """The terms of the documents, packed in blocks of a language and written; a text moves once."""
    docs = t.documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", "text")
    near = docs.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    return cut_lineage(termblocks.pack(near.select("lang", "doc_id", F.array_distinct(text.words(F.col("text"))).alias("words")), "lang", ["doc_id"]))


def _weights(t: Tables, ceiling: float | None = None):
    terms = _terms(t)
    weights = cut_lineage(ops.term_weights(terms, ["lang"], ceiling=ceiling))
    release(terms)
    return weights


@query("topic_edges", "L5 G4", cte(**_W, v="SELECT w.* FROM w JOIN o USING (lang, doc_id)",
 x="SELECT a.lang, a.doc_id AS l, b.doc_id AS r, sum(a.w) AS sw, count(*) AS n FROM v a JOIN v b ON a.lang = b.lang AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2, 3") + """
SELECT x.lang, l AS "left", r AS "right", round(sw / (a.total + b.total - sw), 6) AS similarity, n::INTEGER AS shared FROM x JOIN o a ON a.doc_id = l AND a.lang = x.lang JOIN o b ON b.doc_id = r AND b.lang = x.lang WHERE sw / (a.total + b.total - sw) >= 0.3 AND n >= 2""")
def _(t: Tables):
    return ops.weighted_jaccard_pairs(_weights(t), ["lang"], 0.3).withColumn("similarity", F.round("similarity", 6))


_CW = {**_W, "w": "SELECT t.lang, doc_id, term, ln(1 + docs / df) AS w FROM t JOIN n USING (lang) JOIN d USING (lang, term) WHERE docs < 10 OR df <= docs * 0.25"}


@query("topic_edges_below_ceiling", "L5 G4", cte(**_CW, v="SELECT w.* FROM w JOIN o USING (lang, doc_id)",
 x="SELECT a.lang, a.doc_id AS l, b.doc_id AS r, sum(a.w) AS sw, count(*) AS n FROM v a JOIN v b ON a.lang = b.lang AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2, 3") + """
SELECT x.lang, l AS "left", r AS "right", round(sw / (a.total + b.total - sw), 6) AS similarity, n::INTEGER AS shared FROM x JOIN o a ON a.doc_id = l AND a.lang = x.lang JOIN o b ON b.doc_id = r AND b.lang = x.lang WHERE sw / (a.total + b.total - sw) >= 0.16 AND n >= 2""")
def _(t: Tables):
    # The lower floor, without the terms that a quarter of a language's documents have.
    return ops.weighted_jaccard_pairs(_weights(t, 0.25), ["lang"], 0.16).withColumn("similarity", F.round("similarity", 6))


@query("average_linkage_topics", "L6")
def _(t: Tables):
    pairs = cut_lineage(ops.weighted_jaccard_pairs(_weights(t), ["lang"], 0.3))
    nodes = pairs.select(F.col("left").alias("node")).union(pairs.select(F.col("right").alias("node")))
    return ops.average_linkage(nodes, pairs, 0.3)


@query("keyword_groups", "L12", """
WITH RECURSIVE i AS (SELECT DISTINCT l_partkey % 700 AS k, l_suppkey * 50 + l_orderkey % 50 AS u FROM lineitem), p AS (SELECT a.k AS a, b.k AS b FROM i a JOIN i b ON a.u = b.u AND a.k <> b.k GROUP BY 1, 2 HAVING count(*) >= 6),
r(node, seen) AS (SELECT DISTINCT k, k FROM i UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
SELECT node AS key, component, count(*) OVER (PARTITION BY component)::BIGINT AS members FROM c""")
def _(t: Tables):
    rows = t.lineitem.select((F.col("l_partkey") % 700).alias("key"), (F.col("l_suppkey") * 50 + F.col("l_orderkey") % 50).alias("item"))
    return ops.keyword_groups(rows, 6)


def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


_E = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"


@query("vector_neighbours", "F2", cte(e=_E, s="SELECT a.id, b.id AS n, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.id <> b.id") +
"SELECT id, n AS neighbour, round(s, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, n) AS rank FROM s) WHERE rank <= 5")
def _(t: Tables):
    v = _vectors(t)
    return ops.vector_top_k(v, v, 5).withColumn("score", F.round("score", 6))


@query("donor_pages", "F8", cte(e=_E, s="SELECT a.id, b.id AS n, round(list_cosine_similarity(a.v, b.v), 9) AS s, (b.id * 13) % 100 AS sc FROM e a JOIN e b ON a.id <> b.id") +
"SELECT id, n AS donor, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, n) AS rank FROM s WHERE sc >= 70 AND s BETWEEN 0.2 AND 0.35) WHERE rank <= 3")
def _(t: Tables):
    v = _vectors(t)
    strong = v.where((F.col("id") * 13) % 100 >= 70)
    return ops.donors(v, strong, 0.20, 0.35, 3).withColumn("similarity", F.round("similarity", 6))


@query("vector_label_accuracy", "D38", cte(e=_E, s="SELECT a.id, b.label AS vote, round(list_cosine_similarity(a.v, b.v), 9) AS s, b.id AS n FROM e a JOIN e b ON a.id <> b.id",
 k="SELECT id, vote, sum(greatest(s, 0) + 1e-9) AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, n) AS r FROM s) WHERE r <= 3 GROUP BY 1, 2", g="SELECT id, arg_max(vote, (w, -vote)) AS p FROM k GROUP BY 1") +
"SELECT label, count(*)::BIGINT AS total, count(*) FILTER (WHERE p = label)::BIGINT AS correct FROM e JOIN g USING (id) GROUP BY 1")
def _(t: Tables):
    return ops.knn_accuracy(_vectors(t))


@query("cluster_purity", "D38", "WITH c AS (SELECT vec_id % 37 AS k, label, count(*) AS n FROM embeddings GROUP BY 1, 2), m AS (SELECT k, max(n) AS t, sum(n) AS a FROM c GROUP BY 1) SELECT round(sum(t) / sum(a), 6) AS purity FROM m")
def _(t: Tables):
    return ops.cluster_purity(t.embeddings.select((F.col("vec_id") % 37).alias("cluster"), "label")).withColumn("purity", F.round("purity", 6))


@query("vector_similar_pairs", "L15", cte(e=_E) + 'SELECT a.id AS "left", b.id AS "right", round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.35')
def _(t: Tables):
    return ops.vector_pairs(_vectors(t).select("id", "v"), 0.35).withColumn("score", F.round("score", 6))


@query("vector_groups", "L14", """
WITH RECURSIVE e AS (""" + _E + """), p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.45), r(node, seen) AS (SELECT id, id FROM e UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen), c AS (SELECT node, min(seen) AS k FROM r GROUP BY 1),
u AS (SELECT k, id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e JOIN c ON c.node = e.id), z AS (SELECT k, d, avg(u[d]) AS x FROM u, generate_series(1, 64) g(d) GROUP BY 1, 2), y AS (SELECT k, list(x ORDER BY d) AS c FROM z GROUP BY 1)
SELECT k AS component, count(*)::BIGINT AS members, round(avg(list_cosine_similarity(u, c)), 6) AS cohesion FROM u JOIN y USING (k) GROUP BY 1""")
def _(t: Tables):
    return ops.vector_groups(_vectors(t).select("id", "v"), 0.45).withColumn("cohesion", F.round("cohesion", 6))
