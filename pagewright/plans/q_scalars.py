"""Scalar functions over the given texts and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import numbers, text, urls
from pagewright.plans.registry import Tables, query

_TAGGED = "url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'utm_source=a&gclid=1&z=%41%2f%7E&b=2'"


def _tagged():
    return F.expr(
        "concat(split_part(url, '#', 1), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'utm_source=a&gclid=1&z=%41%2f%7E&b=2#frag')"
    )


@query("url_crawl_keys", "H1", """
WITH t AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages),
p AS (SELECT page_id, split_part(u, '?', 1) AS base, array_to_string(list_filter(string_split(CASE WHEN u LIKE '%?%' THEN split_part(u, '?', 2) ELSE '' END, '&'), lambda x: x <> '' AND x NOT LIKE 'utm_%') || ['z=A%2F~', 'b=2'], '&') AS q FROM t)
SELECT page_id, base || '?' || q AS key_full,
  regexp_extract(base, '^[a-z]+://[^/]+', 0) || CASE WHEN rtrim(regexp_replace(base, '^[a-z]+://[^/]+', ''), '/') = '' THEN '/' ELSE rtrim(regexp_replace(base, '^[a-z]+://[^/]+', ''), '/') END AS key_bare
FROM p""")
def _(t: Tables):
    u = _tagged()
    bare = urls.UrlPolicy(lowercase_path=True, trim_trailing_slash=True, keep_query=False)
    return t.pages.select("page_id", urls.crawl_key(u).alias("key_full"), urls.crawl_key(u, bare).alias("key_bare"))


@query("url_comparison_keys", "H2", """
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/]+)', 1)) AS host,
  regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '://[^/]+(/.*)$', 1) AS path,
  CASE WHEN split_part(url, '#', 1) LIKE '%?%' THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END AS q FROM pages),
v AS (SELECT *, rtrim(path, '/') AS cut, regexp_replace(host, '^www\\.', '') AS bare, CASE WHEN q <> '' THEN '?' || q ELSE '' END AS s,
  list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_[^=]+|gclid|dclid|fbclid|msclkid)$'))) AS kr,
  list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_[a-z]+|gclid|fbclid|msclkid|yclid|mc_cid|mc_eid|ref|srsltid)$'))) AS ks FROM u)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '/' THEN '/' ELSE cut END || s AS gate,
  scheme || '://' || bare || cut || s AS identity,
  bare || CASE WHEN cut = '' THEN '/' ELSE cut END || CASE WHEN len(kr) > 0 THEN '?' || array_to_string(kr, '&') ELSE '' END AS ranked,
  bare || cut || CASE WHEN len(ks) > 0 THEN '?' || array_to_string(ks, '&') ELSE '' END AS snapshot,
  regexp_replace(scheme || '://' || host || path || s, '/$', '') AS alternate
FROM v""")
def _(t: Tables):
    flavours = ("gate", "identity", "ranked", "snapshot", "alternate")
    return t.pages.select("page_id", *[urls.url_key(F.col("url"), f).alias(f) for f in flavours])


@query("registrable_domains", "H3", """
SELECT domain, count(*)::BIGINT AS pages FROM (
  SELECT array_to_string(string_split(lower(regexp_extract(url, '://([^/]+)', 1)), '.')[-2:], '.') AS domain FROM pages)
GROUP BY 1""")
def _(t: Tables):
    return t.pages.groupBy(urls.registrable_domain(urls.host(F.col("url"))).alias("domain")).agg(F.count("*").alias("pages"))


@query("url_template_patterns", "H4", """
WITH s AS (SELECT page_id, list_filter(string_split(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '://[^/]+(.*)$', 1) || '/new-item-' || page_id || '.html', '/'), lambda x: x <> '') AS seg FROM pages),
k AS (SELECT page_id, seg, list_filter(string_split(regexp_replace(seg[-1], '\\.[a-z0-9]{2,5}$', ''), '-'), lambda x: x <> '') AS tok FROM s)
SELECT page_id, array_to_string(list_transform(seg[:-2], lambda x: '/' || x), '') || '/' || array_to_string(tok[:least(2, len(tok) - 1)], '-') || '-{var}' AS pattern FROM k""")
def _(t: Tables):
    u = F.expr("concat(split_part(split_part(url, '#', 1), '?', 1), '/new-item-', page_id, '.html')")
    return t.pages.select("page_id", urls.template_pattern(u).alias("pattern"))


@query("url_path_parts", "H5", """
WITH u AS (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS base,
  CASE WHEN url LIKE '%?%' THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END AS q FROM pages),
s AS (SELECT *, list_filter(string_split(regexp_extract(base, '://[^/]+(.*)$', 1), '/'), lambda x: x <> '') AS seg,
  list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^page=[0-9]+$')) AS kept FROM u)
SELECT page_id, array_to_string(list_transform(seg, lambda x: lower(x)), '|') AS segments,
  coalesce(CASE WHEN regexp_matches(seg[1], '^[a-z]{2}$') THEN seg[2] ELSE seg[1] END, '(root)') AS section,
  base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS listing FROM s""")
def _(t: Tables):
    u = F.col("url")
    return t.pages.select(
        "page_id", F.array_join(urls.path_segments(u), "|").alias("segments"), urls.section(u).alias("section"),
        urls.listing_base(u).alias("listing"),
    )


@query("query_parameter_changes", "H6", """
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%?page=%' THEN regexp_extract(url, 'page=([0-9]+)', 1) END AS p,
  CASE WHEN url LIKE '%ref=%' THEN regexp_extract(url, 'ref=([a-z]+)', 1) END AS r, CASE WHEN url LIKE '%utm_source=%' THEN regexp_extract(url, 'utm_source=([a-z]+)', 1) END AS m FROM pages)
SELECT page_id, array_to_string(list_filter([CASE WHEN p IS DISTINCT FROM '9' THEN 'page: ' || coalesce(p, '∅') || ' → 9' END,
  CASE WHEN r IS NOT NULL THEN 'ref: ' || r || ' → ∅' END, 's: ∅ → 1', CASE WHEN m IS NOT NULL THEN 'utm_source: ' || m || ' → ∅' END], lambda x: x IS NOT NULL), '; ') AS changes FROM u""")
def _(t: Tables):
    target = F.expr("concat(split_part(split_part(url, '#', 1), '?', 1), '?page=9&s=1')")
    return t.pages.select("page_id", F.array_join(urls.query_changes(F.col("url"), target), "; ").alias("changes"))


@query("address_numbers", "H7", """
SELECT event_id, (192::BIGINT * 256 + 168) * 65536 + (user_id % 256) * 256 + event_id % 256 AS v4,
  '20010db8' || lpad(lower(to_hex(user_id)), 4, '0') || repeat('0', 16) || lpad(lower(to_hex(event_id % 65536)), 4, '0') AS v6,
  (event_id % 300 < 256) AS valid FROM events""")
def _(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    v4 = F.concat(F.lit("192.168."), u % 256, F.lit("."), e % 256)
    v6 = F.concat(F.lit("2001:DB8:"), F.hex(u), F.lit("::"), F.hex(e % 65536))
    maybe = F.concat(F.lit("10.0.0."), e % 300)
    return t.events.select(
        "event_id", numbers.ipv4_number(v4).alias("v4"), numbers.ipv6_hex(v6).alias("v6"),
        numbers.ipv4_number(maybe).isNotNull().alias("valid"),
    )


@query("term_keys", "H9 H10", """
WITH w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS word FROM documents),
f AS (SELECT lang, word, replace(replace(replace(replace(strip_accents(CASE WHEN lang = 'de' THEN replace(replace(replace(word, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') ELSE word END), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o') AS folded FROM w)
SELECT lang, word, CASE WHEN lang = 'en' AND length(folded) > 4 AND folded LIKE '%ies' THEN left(folded, length(folded) - 3) || 'y'
  WHEN lang = 'en' AND length(folded) >= 5 AND regexp_matches(folded, '[^aeiousy]s$') THEN left(folded, length(folded) - 1) ELSE folded END AS term_key,
  (length(regexp_replace(folded, '[^\\p{L}]', '', 'g')) < 2 OR length(regexp_replace(folded, '[^\\p{N}]', '', 'g')) >= length(regexp_replace(folded, '[^\\p{L}]', '', 'g'))
   OR folded IN ('the', 'and', 'of', 'from', 'with', 'this', 'that')) AS noise
FROM f""")
def _(t: Tables):
    w = t.documents.select("lang", F.explode(text.words(F.col("text"))).alias("word")).distinct()
    stop = ("the", "and", "of", "from", "with", "this", "that")
    return w.select(
        "lang", "word", text.term_key(F.col("word"), F.col("lang")).alias("term_key"),
        text.is_noise(text.fold(F.col("word"), F.col("lang")), stop).alias("noise"),
    )


@query("phrase_keys", "H12", """
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS word, generate_subscripts(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1), 1) AS i FROM benchmark),
f AS (SELECT item_id, i, replace(strip_accents(word), 'ß', 'ss') AS k FROM w),
g AS (SELECT item_id, i, CASE WHEN length(k) > 4 AND k LIKE '%ies' THEN left(k, length(k) - 3) || 'y' WHEN length(k) >= 5 AND regexp_matches(k, '[^aeiousy]s$') THEN left(k, length(k) - 1) ELSE k END AS k
  FROM f WHERE k NOT IN ('the', 'and', 'of') AND length(regexp_replace(k, '[^\\p{L}]', '', 'g')) >= 2)
SELECT item_id, string_agg(k, ' ' ORDER BY i) AS phrase_key FROM g GROUP BY 1""")
def _(t: Tables):
    return t.benchmark.select("item_id", text.phrase_key(F.col("text"), F.lit("en"), ("the", "and", "of")).alias("phrase_key"))


@query("sentence_spans", "H13", """
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?…。！？])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*)::BIGINT AS sentences, sum(length(trim(s, ' ' || chr(10) || chr(13) || chr(9))))::BIGINT AS chars FROM s
WHERE trim(s, ' ' || chr(10) || chr(13) || chr(9)) <> '' GROUP BY 1""")
def _(t: Tables):
    s = text.sentences(F.col("text"))
    return t.documents.select("doc_id", s.alias("s")).where(F.size("s") > 0).select(
        "doc_id", F.size("s").cast("long").alias("sentences"),
        F.aggregate(F.transform("s", lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"),
    )


@query("readability_scores", "H14 H15", """
WITH w AS (SELECT doc_id, lang, text, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')), lambda x: x <> '') AS words,
  len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) AS sentences FROM documents),
y AS (SELECT doc_id, lang, len(words) AS n, sentences, list_sum(list_transform(words, lambda x: length(x))) AS chars,
  list_sum(list_transform(words, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouyąęóàèìòù]+')) -
    CASE WHEN length(x) > 2 AND lower(x) LIKE '%e' AND NOT lower(x) LIKE '%le' AND len(regexp_extract_all(lower(x), '[aeiouyąęóàèìòù]+')) > 1 THEN 1 ELSE 0 END, 1))) AS syl FROM w),
r AS (SELECT *, n / sentences AS wps, syl / n AS spw, chars / n AS cpw FROM y WHERE sentences > 0)
SELECT doc_id, n::BIGINT AS words, sentences::BIGINT AS sentences,
  round(least(greatest(CASE lang WHEN 'es' THEN 206.84 - 1.02 * wps - 60 * spw WHEN 'fr' THEN 207 - 1.015 * wps - 73.6 * spw ELSE 206.835 - 1.015 * wps - 84.6 * spw END, 0), 100), 4) AS ease,
  round(CASE WHEN lang = 'de' THEN greatest(0.39 * wps + 11.8 * spw - 15.59, 0) ELSE least(greatest(0.39 * wps + 11.8 * spw - 15.59, 0), 100) END, 4) AS grade,
  CASE WHEN lang = 'de' THEN 'flesch-like' ELSE 'flesch-' || lang END AS method,
  floor(least(greatest(100 - greatest(wps - 12, 0) * 3 - greatest(cpw - 5, 0) * 8, 0), 100) + 0.5)::BIGINT AS complexity FROM r""")
def _(t: Tables):
    from pagewright.operators import terms

    m = terms.content_metrics(t.documents)
    return m.where("sentence_count > 0").select(
        "doc_id", F.col("measured_words").cast("long").alias("words"), F.col("sentence_count").cast("long").alias("sentences"),
        F.round("ease", 4).alias("ease"), F.round("grade", 4).alias("grade"), "method", "complexity",
    )


@query("language_guesses", "H16", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1) AS w FROM documents),
m(code, words) AS (VALUES ('en', ['the', 'and', 'with', 'from', 'this', 'that']), ('pl', ['jest', 'oraz', 'się', 'dla', 'który', 'które', 'może', 'mogą']),
  ('de', ['und', 'der', 'die', 'das', 'mit', 'nicht', 'eine']), ('es', ['que', 'para', 'con', 'una', 'los', 'las', 'del', 'está']),
  ('fr', ['les', 'des', 'pour', 'avec', 'dans', 'une', 'est']), ('it', ['gli', 'che', 'una', 'per', 'con', 'sono', 'della']),
  ('pt', ['uma', 'para', 'com', 'que', 'dos', 'das', 'não']), ('ru', ['это', 'для', 'что', 'как', 'или', 'при', 'есть'])),
v AS (SELECT doc_id, code, len(list_filter(w, lambda x: list_contains(words, x))) AS n FROM w, m),
r AS (SELECT doc_id, max(n) AS best, arg_max(code, n) AS code, count(*) FILTER (WHERE n = mx) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS mx FROM v) GROUP BY 1)
SELECT doc_id, CASE WHEN best >= 2 AND ties = 1 THEN code END AS guess FROM r""")
def _(t: Tables):
    return t.documents.select("doc_id", text.guess_language(F.col("text")).alias("guess"))


@query("declared_dates", "H18", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER), '%Y-%m-%d') AS latest FROM orders""")
def _(t: Tables):
    # Three declarations per record: the order day, a later day with a time, and one that is no date.
    d = F.to_date("o_orderdate")
    later = F.concat(F.date_add(d, (F.col("o_orderkey") % 5).cast("int")).cast("string"), F.lit("T10:00:00Z"))
    found = F.array(d.cast("string"), later, F.lit("soon"))
    return t.orders.select("o_orderkey", F.array_max(F.transform(found, text.iso_date)).alias("latest"))


@query("hreflang_code_checks", "H19", """
WITH c AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'en' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'x-default' WHEN 3 THEN 'english_uk' WHEN 4 THEN 'zh-Hant-TW' WHEN 5 THEN 'e' WHEN 6 THEN 'de-' ELSE 'sl-rozaj-rozaj' END AS code FROM pages)
SELECT page_id, code, code IN ('en', 'en-GB', 'x-default', 'zh-Hant-TW') AS valid FROM c""")
def _(t: Tables):
    codes = F.array(*[F.lit(c) for c in ("en", "en-GB", "x-default", "english_uk", "zh-Hant-TW", "e", "de-", "sl-rozaj-rozaj")])
    code = F.get(codes, (F.col("page_id") % 8).cast("int"))
    return t.pages.select("page_id", code.alias("code"), text.valid_hreflang(code).alias("valid"))


@query("alt_text_checks", "H21", """
WITH i AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'IMG_' || doc_id || '.jpg' WHEN 3 THEN 'Photo' WHEN 4 THEN left(text, 200) ELSE 'zzz qqq' END AS alt,
  regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1) AS ctx FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, alt, trim(alt) AS a, list_distinct(regexp_extract_all(lower(alt), '([\\p{L}\\p{N}]+)', 1)) AS w, ctx FROM i)
SELECT doc_id, CASE WHEN alt IS NULL THEN 'missing' WHEN a = '' THEN '' ELSE array_to_string(list_filter([
  CASE WHEN regexp_matches(a, '(?i)\\.(jpe?g|png)$|^(img|photo|image|dsc|screenshot)[-_ ]?[0-9]+') OR lower(a) = 'pic' || doc_id || '.png' THEN 'filename' END,
  CASE WHEN lower(a) = 'photo' THEN 'generic' END, CASE WHEN length(a) > 125 THEN 'too-long' END, CASE WHEN lower(a) = 'photo' THEN 'repeats-caption' END,
  CASE WHEN len(w) > 0 AND NOT list_has_any(w, ctx) THEN 'unrelated-to-context' END], lambda x: x IS NOT NULL), ',') END AS issues FROM c""")
def _(t: Tables):
    alt = (
        F.expr("CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('IMG_', doc_id, '.jpg') WHEN 3 THEN 'Photo' WHEN 4 THEN left(text, 200) ELSE 'zzz qqq' END")
    )
    src = F.concat(F.lit("https://cdn.example/pic"), F.col("doc_id"), F.lit(".png?w=3"))
    return t.documents.where(F.length("text") > 0).select(
        "doc_id", F.array_join(text.alt_issues(alt, src, F.lit("photo"), F.col("text")), ",").alias("issues")
    )


@query("vector_math", "H22", """
WITH e AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(sqrt(list_inner_product(x, x)), 6) AS norm, round(list_cosine_similarity(x, y), 6) AS cosine,
  round((0.5 + greatest(0, least(1, list_cosine_similarity(x, y)))) / 2, 6) AS blended, round(list_inner_product(x, x) / list_inner_product(x, x), 6) AS unit_dot FROM e""")
def _(t: Tables):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    cos = numbers.safe_cosine(x, y)
    u = numbers.unit(x)
    return a.join(b, "vec_id").select(
        "vec_id", F.round(numbers.norm(x), 6).alias("norm"), F.round(cos, 6).alias("cosine"),
        F.round(numbers.blend_similarity(F.lit(0.5), cos), 6).alias("blended"), F.round(numbers.dot(u, u), 6).alias("unit_dot"),
    )


@query("hamming_distances", "H23", """
SELECT o_orderkey, bit_count(xor(CAST(o_orderkey * 2654435761 AS BIGINT), CAST(o_custkey * 40503 AS BIGINT)))::INTEGER AS distance FROM orders""")
def _(t: Tables):
    a, b = (F.col("o_orderkey") * F.lit(2654435761)).cast("long"), (F.col("o_custkey") * 40503).cast("long")
    return t.orders.select("o_orderkey", numbers.hamming(numbers.hex_to_bits(F.lpad(F.hex(a), 16, "0")), b).alias("distance"))


@query("distribution_functions", "H28", """
WITH c AS (SELECT c_custkey, c_acctbal / 4000 - 1 AS x FROM customer),
e AS (SELECT c_custkey, x, 1 / (1 + 0.3275911 * abs(x / sqrt(2))) AS k FROM c)
SELECT c_custkey, round(0.5 * (1 + sign(x) * (1 - ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-x * x / 2))), 6) AS cdf,
  round(1.959964 + (1.959964 ** 3 + 1.959964) / (4 * (1 + c_custkey % 60)) + (5 * 1.959964 ** 5 + 16 * 1.959964 ** 3 + 3 * 1.959964) / (96 * (1 + c_custkey % 60) ** 2), 6) AS t975
FROM e""")
def _(t: Tables):
    x = F.col("c_acctbal") / 4000 - 1
    return t.customer.select(
        "c_custkey", F.round(numbers.normal_cdf(x), 6).alias("cdf"), F.round(numbers.t975(1 + F.col("c_custkey") % 60), 6).alias("t975")
    )


@query("reference_mentions", "H26", """
WITH d AS (SELECT doc_id, 'see doi:10.' || (1000 + doc_id % 9000) || '/ab.' || doc_id || ', PMID: ' || (doc_id % 50 + 1) || ' and https://ref.example/' || (doc_id % 30) || '. ' || text AS x FROM documents),
r AS (SELECT doc_id, list_concat(list_concat(list_transform(regexp_extract_all(x, '(?i)\\b(10\\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)\\b', 1), lambda y: 'doi:' || lower(regexp_replace(y, '[.,;:]+$', ''))),
  list_transform(regexp_extract_all(x, '(?i)\\bPMID\\s*:?[\\s#]*([0-9]{1,9})\\b', 1), lambda y: 'pmid:' || y)),
  list_concat(list_transform(regexp_extract_all(x, '(?i)\\b(PMC[0-9]{4,9})\\b', 1), lambda y: 'pmcid:' || lower(y)), list_transform(regexp_extract_all(x, '(?i)(https?://[^\\s)\\]>]+)', 1), lambda y: 'url:' || lower(regexp_replace(y, '[.,;:]+$', ''))))) AS k FROM d)
SELECT key, count(DISTINCT doc_id)::BIGINT AS docs FROM (SELECT doc_id, unnest(k) AS key FROM r) GROUP BY 1""")
def _(t: Tables):
    d = F.col("doc_id")
    x = F.concat(
        F.lit("see doi:10."), 1000 + d % 9000, F.lit("/ab."), d, F.lit(", PMID: "), d % 50 + 1, F.lit(" and https://ref.example/"),
        d % 30, F.lit(". "), F.col("text"),
    )
    return t.documents.select(F.explode(text.references(x)).alias("key")).groupBy("key").agg(F.count("*").alias("docs"))


@query("finding_type_keys", "D5", """
WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Title length is ' || n_chars || ' characters: too long' WHEN 1 THEN 'Slow response ' || doc_id || ' ms' ELSE ':' END AS msg FROM documents)
SELECT k AS kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN trim(regexp_replace(split_part(lower(trim(msg)), ':', 1), '[0-9]+', '#', 'g')) = '' THEN '<empty>' ELSE trim(regexp_replace(split_part(lower(trim(msg)), ':', 1), '[0-9]+', '#', 'g')) END AS k FROM m) GROUP BY 1""")
def _(t: Tables):
    msg = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN concat('Title length is ', n_chars, ' characters: too long') WHEN 1 THEN concat('Slow response ', doc_id, ' ms') ELSE ':' END"
    )
    return t.documents.groupBy(text.finding_type(msg).alias("kind")).agg(F.count("*").alias("n"))
