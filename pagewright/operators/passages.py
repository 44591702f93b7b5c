"""Passages, claims, mentions and gaps against reference texts."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from pagewright.functions import numbers, text
from pagewright.operators import shapes, sparse
from pagewright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cues of stance, claims and evidence; each list can be replaced by the caller's own.
NEGATIONS = (
    "not", "never", "no", "without", "don't", "doesn't", "isn't", "wasn't", "won't", "nie", "nigdy", "bez", "żaden", "żadna",
    "kein", "keine", "nicht", "pas", "jamais", "nunca", "sin", "non", "mai", "não", "sem", "без", "не", "нет", "никогда",
)
NEGATIONS_UNSPACED = r"不|没有|ない|않|아니"
CRITICAL_STEMS = (
    "scam", "fraud", "avoid", "worst", "terrible", "awful", "complain", "lawsuit", "ripoff", "rip-off", "misleading",
    "oszust", "unikaj", "najgorsz", "fataln", "skarg", "pozew", "naciąg", "wprowadza w błąd",
    "betrug", "vermeid", "arnaque", "escroquer", "estafa", "fraude", "truffa", "golpe", "мошенни", "обман", "詐欺", "骗", "사기",
)
ATTRIBUTION = (
    r"(?iu)\b(?:according to|said|says|claims?|allegedly)\b|według|zdaniem|twierdzi|podobno|\blaut\b|\bselon\b|\bsegún\b|\bsecondo\b|\bsegundo\b|"
    r"по словам|据|によると|에 따르면"
)
HIGH_STAKES = (
    r"(?iu)\b(?:study|studies|research|trial|patients?|risk|odds|caus(?:e|es|ed|al)|treatment|dose|mg|percent|%|badania|pacjent|ryzyko|dawka|skutek)\b"
    r"|\d+(?:[.,]\d+)?\s*(?:%|mg|kg|lat|years?|dni|days?)"
)
QUANTITY = r"(?<![\p{L}\p{N}.,/])\d+(?:[.,]\d+)?\s?(?:%|°[CF]|k?g|mg|km|cm|mm|m|ms|min|h|kWh|W|MB|GB|px|zł|PLN|EUR|USD|[$€£])(?![\p{L}\p{N}])"
PRICE = r"[$€£]\s?\d+(?:[.,]\d+)?(?![\p{L}\p{N}])"
EVIDENCE = (r"(?i)\b10\.\d{4,9}/[^\s\"<>]+", r"(?i)\bPMID:?\s*\d{4,9}\b")
FIRST_HAND = (
    r"(?i)\b(?:we|i)\s+(?:tested|measured|ran|benchmarked|interviewed|surveyed|built)\b",
    r"(?iu)\b(?:przetestowa|zmierzy|sprawdzi|zbadali|przeprowadzi)\p{L}*",
    r"(?i)\bin our (?:test|study|experiment|survey)s?\b",
)
#: Where a word of a text ends, hyphens and apostrophes being part of it.
_EDGE = r"[\p{L}\p{N}'’-]"


def _c(name: str) -> Column:
    return F.col(name)


def _spaced(cue: str) -> bool:
    """Whether a cue stands at the beginning of a word; phrases and scripts without spaces may stand anywhere."""
    return not re.search(r"[\s\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]", cue)


def _stem_pattern(stems: tuple[str, ...]) -> str:
    inside = "|".join(re.escape(s) for s in stems if not _spaced(s))
    return rf"(?iu)(?<!{_EDGE})(?:" + "|".join(re.escape(s) for s in stems if _spaced(s)) + ")" + (f"|{inside}" if inside else "")


def _word_pattern(words: tuple[str, ...]) -> str:
    return rf"(?iu)(?<!{_EDGE})(?:" + "|".join(re.escape(w).replace("'", "['’]") for w in words) + rf")(?!{_EDGE})"


def weak_passages(scored: DataFrame, below: float = 50, limit: int = 5, key: str = "doc_id") -> DataFrame:
    return shapes.top_k(scored.where(_c("score") < below), [key], limit, _c("score"), _c("pos"))


def passage_heat(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Cells per page and heading: number, mean and worst passage, with an advice kind."""
    out = scored.groupBy(*keys).agg(F.count("*").alias("cells"), F.avg("score").alias("mean"), F.min("score").alias("worst"))
    return out.withColumn("advice", F.when(_c("worst") < 30, "rewrite").when(_c("mean") < 50, "strengthen").otherwise("keep"))


# --- claims, references, mentions ----------------------------------------------------------------------------

def claims(docs: DataFrame, sources: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Claims that need a source, with the references in the same or a neighbouring sentence and what is known of them.

    A sentence claims something if it has a number with a unit or a word that findings are told with. References by number or
    by author and year count, and are known where ``sources(ref, supports)`` names them.
    """
    sents = docs.select(key, text.sentences(_c(body)).alias("s")).select(key, F.posexplode("s").alias("pos", "sentence"), "s")
    own = text.references(_c("sentence"))
    near = F.array_distinct(F.concat(text.references(F.coalesce(F.get("s", _c("pos") - 1), F.lit(""))), text.references(F.coalesce(F.get("s", _c("pos") + 1), F.lit("")))))
    rows = sents.where(_c("sentence").rlike(HIGH_STAKES)).select(key, "pos", own.alias("own"), near.alias("near"))
    relation = F.when(F.size("own") > 0, "same-sentence").when(F.size("near") > 0, "adjacent-sentence").otherwise("unmatched")
    rows = rows.select(key, "pos", relation.alias("relation"), F.when(F.size("own") > 0, _c("own")).otherwise(_c("near")).alias("refs"))
    each = rows.select(key, "pos", "relation", F.explode_outer("refs").alias("ref")).join(sources, "ref", "left")
    return each.groupBy(key, "pos", "relation").agg(F.count("ref").alias("refs"), F.count("supports").alias("known"), F.max("supports").alias("supported"))


def backed_share(claim_rows: DataFrame, key: str = "doc_id", few: float = 0.5) -> DataFrame:
    """Share of claims with a supporting source; damped below two known sources."""
    out = claim_rows.groupBy(key).agg(F.count("*").alias("claims"), F.avg(F.coalesce("supported", F.lit(False)).cast("double")).alias("share"), F.sum("known").alias("known"))
    return out.withColumn("backed", F.when(_c("known") < 2, _c("share") * few).otherwise(_c("share")))


def claim_overlap(claim: Column, source: Column) -> tuple[Column, Column]:
    """(share of a claim's words and numbers found in the source, band)."""
    share = text.overlap_share(claim, source)
    return share, F.when(share >= 0.6, "supported").when(share >= 0.3, "partial").when(share.isNotNull(), "unsupported")


def evidence_density(body: Column, words: Column) -> Column:
    """References, and measured quantities and prices at half, per thousand words, saturating at three."""
    count = lambda *patterns: sum((F.regexp_count(body, F.lit(x)) for x in patterns[1:]), F.regexp_count(body, F.lit(patterns[0])))
    return text.clamp((count(*EVIDENCE) + 0.5 * count(QUANTITY, PRICE)) / F.greatest(F.lit(1.0), words / 1000.0) / 3.0, 0, 1)


def first_hand(body: Column) -> Column:
    """Marks of own tests and measurements, saturating at three."""
    return text.clamp(sum((F.regexp_count(body, F.lit(x)) for x in FIRST_HAND), F.lit(0)) / 3.0, 0, 1)


def stance(sentence: Column, aliases: list[str], negations: tuple[str, ...] = NEGATIONS, critical: tuple[str, ...] = CRITICAL_STEMS) -> Column:
    """critical, negated, quoted or neutral mention in one sentence."""
    negated = sentence.rlike(_word_pattern(negations)) | sentence.rlike(rf"(?iu)\p{{L}}n['’]t(?!{_EDGE})") | sentence.rlike(NEGATIONS_UNSPACED)
    names = "|".join(re.escape(a) for a in aliases)
    inside = sentence.rlike(rf"(?iu)[\"„“«「『][^\"”»」』]*(?:{names})[^\"”»」』]*[\"”»」』]")
    return F.when(sentence.rlike(_stem_pattern(critical)), "critical").when(negated, "negated").when(sentence.rlike(ATTRIBUTION) | inside, "quoted").otherwise("neutral")


def cocitations(paragraphs: DataFrame, aliases: list[str], entity: str, key: str = "doc_id") -> DataFrame:
    """Paragraphs naming a brand alias and the entity as whole words, with the worst stance; ``(key, pos, paragraph, linked)``."""
    word = lambda names: r"(?iu)(^|[^\p{L}\p{N}])(" + "|".join(re.escape(n) for n in names) + r")($|[^\p{L}\p{N}])"
    hit = paragraphs.where(_c("paragraph").rlike(word(aliases)) & _c("paragraph").rlike(word([entity])))
    naming = F.filter(text.sentences(_c("paragraph")), lambda s: s.rlike(word(aliases)))
    rank = {"neutral": 0, "quoted": 1, "negated": 2, "critical": 3}
    scored = F.transform(naming, lambda s: stance(s, aliases))
    worst = F.array_max(F.transform(scored, lambda x: F.struct(F.element_at(F.create_map(*[F.lit(v) for p in rank.items() for v in p]), x).alias("r"), x.alias("s"))))
    return hit.select(key, "pos", "linked", F.coalesce(worst["s"], F.lit("neutral")).alias("stance"))


def anchor_context(links: DataFrame, documents: DataFrame, width: int = 40) -> DataFrame:
    """Where an anchor text stands in its fetched source: located with excerpt, ambiguous or not found.

    ``links(link, source, anchor)``, ``documents(source, text)``.
    """
    rows = links.join(documents, "source", "left")
    low, needle = F.lower("text"), F.lower(F.trim("anchor"))
    hits = F.floor((F.length(low) - F.length(F.replace(low, needle, F.lit("")))) / F.length(needle))
    at = F.expr("locate(lower(trim(anchor)), lower(text))")
    state = F.when(_c("text").isNull(), "source-missing").when(F.coalesce(needle, F.lit("")) == "", "not-found").when(hits == 1, "located").when(hits > 1, "ambiguous").otherwise("not-found")
    excerpt = F.substring("text", F.greatest(at - width, F.lit(1)), F.length(F.trim("anchor")) + 2 * width)
    return rows.select("link", state.alias("state"), F.when(state == "located", excerpt).alias("excerpt"))


def phrase_evidence(docs: DataFrame, phrase: str, fields: dict[str, str]) -> DataFrame:
    """Occurrences of a phrase per field and its density in the body."""
    needle = F.lit(r"(?i)(?<![\p{L}\p{N}])" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"(?![\p{L}\p{N}])")
    n = {name: F.regexp_count(F.coalesce(_c(col), F.lit("")), needle) for name, col in fields.items()}
    words = F.size(text.words(_c(fields["body"])))
    density = F.coalesce(F.try_divide(n["body"] * 100.0 * len(phrase.split()), words), F.lit(0.0))
    return docs.select(*[c for c in ("doc_id", "page_id") if c in docs.columns], *[v.alias(f"in_{k}") for k, v in n.items()], density.alias("density"))


def entity_candidates(docs: DataFrame, key: str = "doc_id", body: str = "text", min_texts: int = 2) -> DataFrame:
    """Capitalised runs inside sentences that several texts share, lower case."""
    run = r"(?<=[\p{Ll}\p{N},] )(\p{Lu}[\p{L}\p{N}'’-]+(?: \p{Lu}[\p{L}\p{N}'’-]+)*)"
    found = docs.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(run), F.lit(1)), lambda s: F.lower(s)))).alias("entity"))
    return found.groupBy("entity").agg(F.count("*").alias("texts")).where(_c("texts") >= min_texts)


# --- gaps and candidates -------------------------------------------------------------------------------------

def query_evidence(queries: DataFrame, pages: DataFrame, page_terms: DataFrame) -> DataFrame:
    """Share of each query's words found on the pages assigned to its topic; ``queries(query, topic, text)``, ``pages(topic, page)``."""
    each = queries.select("query", "topic", F.explode(F.array_distinct(text.words(_c("text")))).alias("term"))
    total = each.groupBy("query").agg(F.countDistinct("term").alias("terms"))
    seen = each.join(pages, "topic").join(page_terms.select("page", "term").distinct(), ["page", "term"]).groupBy("query").agg(F.countDistinct("term").alias("found"))
    out = total.join(seen, "query", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select("query", "terms", "found", F.when(_c("found") == _c("terms"), "observed").when(_c("found") > 0, "partial").otherwise("never-observed").alias("state"))


def content_gap(target: DataFrame, references: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Terms common on the reference pages of a phrase and absent on the target; ``(phrase, page, term)``."""
    df = references.groupBy("phrase", "term").agg(F.countDistinct("page").alias("df"))
    size = references.select("phrase", "page").distinct().groupBy("phrase").agg(F.count("*").alias("pages"))
    common = df.join(size, "phrase").withColumn("share", _c("df") / _c("pages")).where(_c("share") >= min_share)
    return common.join(target.select("phrase", "term").distinct(), ["phrase", "term"], "left_anti").select("phrase", "term", "df", "share")


def best_section(sections: DataFrame, terms: DataFrame) -> DataFrame:
    """H2/H3 section of each page with most hits of the shared terms; ``sections(page, section, heading, level, body)``, ``terms(page, term)``."""
    words = sections.where("level IN (2, 3)").select("page", "section", "heading", F.explode(text.words(_c("body"))).alias("term"))
    hits = words.join(terms.select("page", "term").distinct(), ["page", "term"]).groupBy("page", "section", "heading").agg(F.count("*").alias("hits"))
    return hits.groupBy("page").agg(F.min_by(F.struct("section", "heading", "hits"), F.struct((-_c("hits")).alias("a"), "section")).alias("b")).select("page", "b.section", "b.heading", "b.hits")


def link_injections(opportunities: DataFrame, donor_sections: DataFrame, per_source: int = 3) -> DataFrame:
    """Best missing links of each page with the section to put them in."""
    top = shapes.top_k(opportunities, ["source"], per_source, F.desc(F.round("similarity", 9)), _c("target"))
    return top.join(donor_sections.select(_c("page").alias("source"), "section", "heading"), "source", "left")


def nearest_document(pairs: DataFrame) -> DataFrame:
    """Closest partner of each document from a pair table."""
    both = pairs.select(_c("left").alias("doc"), _c("right").alias("other"), "similarity").unionByName(pairs.select(_c("right").alias("doc"), _c("left").alias("other"), "similarity"))
    return both.groupBy("doc").agg(F.min_by(F.struct("other", "similarity"), F.struct((-F.round("similarity", 9)).alias("a"), "other")).alias("b")).select("doc", "b.other", "b.similarity")


def blended_result_similarity(pairs: DataFrame) -> DataFrame:
    """.7 semantic and .3 shared results where both lists come from one context, else the semantic part with the reason.

    ``pairs(a, b, semantic, urls_a, urls_b, context_a, context_b)``.
    """
    union = F.size(F.array_union("urls_a", "urls_b"))
    jaccard = F.when(union > 0, F.size(F.array_intersect("urls_a", "urls_b")) / union)
    reason = F.when(_c("urls_a").isNull() | _c("urls_b").isNull(), "no-results").when(~_c("context_a").eqNullSafe(_c("context_b")), "different-context")
    return pairs.select("a", "b", jaccard.alias("jaccard"), F.when(reason.isNull() & jaccard.isNotNull(), 0.7 * _c("semantic") + 0.3 * jaccard).otherwise(_c("semantic")).alias("similarity"), reason.alias("reason"))


def candidate_pages(pages: DataFrame, near: DataFrame, topic_terms: DataFrame, min_shared: int = 2) -> DataFrame:
    """Page pairs worth comparing and why: same content, close fingerprints, or shared terms within one topic.

    ``pages(page, content_hash)``, ``near(left, right)`` from the fingerprint join, ``topic_terms(topic, page, term)``.
    Equal contents are links to the first page of the content, not all pairs. Pages that share terms may be most pairs, so they stay
    where they are found; the few other pairs are looked at by themselves.
    """
    from pagewright.operators import similarity

    head = pages.groupBy("content_hash").agg(F.min("page").alias("left"))
    same = pages.join(head, "content_hash").where("page <> left").select("left", _c("page").alias("right"), F.lit("same-content").alias("basis"))
    items = topic_terms.select(_c("page").alias("key"), F.concat_ws("\x1f", _c("topic").cast("string"), "term").alias("item"))
    few = same.unionByName(near.select("left", "right", F.lit("fingerprint").alias("basis")))
    few = cut_lineage(few.groupBy("left", "right").agg(F.array_join(F.array_sort(F.collect_set("basis")), ",").alias("other")))
    named = few.select(F.explode(F.array("left", "right")).alias("id")).distinct()
    held = cut_lineage(similarity.distinct_sets(items, min_shared).join(named, "id", "left_semi"))
    for side in ("left", "right"):
        few = few.join(held.select(_c("id").alias(side), _c("terms").alias(f"{side}_terms")), side, "left")
    both = F.size(F.array_intersect("left_terms", "right_terms")) >= min_shared
    few = cut_lineage(few.select("left", "right", F.concat_ws(",", "other", F.when(both, "topic-term")).alias("basis")))
    shared = similarity.text_item_pairs(items, min_shared).select("left", "right", F.lit("topic-term").alias("basis"))
    return few.unionByName(shared.join(few, ["left", "right"], "left_anti"))


def passage_zones(target: DataFrame, nearest: DataFrame, centroid: DataFrame) -> DataFrame:
    """echo, gain, drift or neutral per passage; ``target(query, id, v)``, ``nearest(id, score)``, ``centroid(query, centroid)``."""
    rows = target.join(centroid, "query").join(nearest.select("id", _c("score").alias("nearest")), "id", "left").withColumn("nearest", F.coalesce("nearest", F.lit(0.0)))
    topic = numbers.safe_cosine(_c("v"), _c("centroid"))
    zone = F.when(_c("nearest") >= 0.82, "echo").when(topic >= 0.48, "gain").when(_c("nearest") < 0.60, "drift").otherwise("neutral")
    return rows.select("query", "id", topic.alias("topic"), "nearest", zone.alias("zone"))


def information_gain(parts: DataFrame, quota: float = 0.4) -> DataFrame:
    """0-100 gain from novelty, evidence, first-hand marks and divergence, times the coverage penalty; null off topic.

    ``parts(query, on_topic, novelty, evidence, first_hand, divergence, coverage)``.
    """
    raw = 0.35 * _c("novelty") + 0.30 * _c("evidence") + 0.20 * _c("first_hand") + 0.15 * _c("divergence")
    penalty = F.least(F.lit(1.0), 0.5 + _c("coverage"))
    ok = _c("on_topic") >= quota
    return parts.select("query", F.when(ok, F.floor(100 * raw * penalty + 0.5)).alias("gain"), F.when(ok, "ready").when(_c("on_topic").isNull(), "unavailable").otherwise("off-topic").alias("state"))


def novelty(novel: Column, consensus: Column) -> Column:
    return text.clamp(novel / F.greatest(F.lit(5.0), 0.35 * consensus), 0, 1)


def centroid_shift(base: DataFrame, current: DataFrame) -> DataFrame:
    """1 - cosine of two snapshot centres; refused across models; ``(query, model, centroid)``."""
    rows = base.select("query", _c("model").alias("m0"), _c("centroid").alias("c0")).join(current.select("query", _c("model").alias("m1"), _c("centroid").alias("c1")), "query")
    same = _c("m0") == _c("m1")
    return rows.select("query", F.when(same, F.greatest(F.lit(0.0), 1 - numbers.safe_cosine(_c("c0"), _c("c1")))).alias("shift"), F.when(~same, "model-changed").alias("reason"))


def term_dots(pages: DataFrame, references: DataFrame) -> DataFrame:
    """(subtopic, page, dot, norm) of the pages and sub-topics that share a term; ``norm`` is the length of the page's vector.

    A page's terms stay together: pages lie in blocks, and the references come to a block once for each of its distinct terms.
    No row is made for a page's term and a sub-topic. Null weights count nothing.
    """
    rows = pages.where(_c("page").isNotNull()).groupBy(_c("page").alias("id")).agg(F.collect_list(F.struct("term", F.coalesce("weight", F.lit(0.0)).alias("weight"))).alias("t"))
    packed = cut_lineage(sparse.blocks(rows.select("id", F.transform("t", lambda x: x["term"]).alias("terms"), F.transform("t", lambda x: x["weight"]).alias("weights")), []))
    word = pages.schema["term"].dataType

    def listed(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for block, terms in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = sparse.terms_of(terms.as_py())
                for lo in range(0, len(found), 65536):
                    some = found.slice(lo, 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(np.arange(lo, lo + len(some))), some.cast(to_arrow_type(word))], names=["of", "at", "term"])

    terms = packed.select("block", "terms").mapInArrow(listed, StructType([*StructType.fromDDL("of long, at long").fields, StructField("term", word)]))
    wanted = terms.join(references.select("subtopic", "term", F.coalesce("weight", F.lit(0.0)).alias("rw")), "term").select("of", "at", "subtopic", "rw")
    kind = StructType([references.schema["subtopic"], StructField("page", pages.schema["page"].dataType), *StructType.fromDDL("dot double, norm double").fields])

    def meet(block, asked):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        if not block.num_rows or not asked.num_rows:
            return schema.empty_table()
        own = sparse.Block.opened(*[block.column(c)[0].as_py() for c in ("docs", "terms", "cells")])
        topics = asked.column("subtopic").combine_chunks().dictionary_encode(null_encoding="encode")
        norm, parts = np.sqrt(np.bincount(own.doc, own.own * own.own, own.n)), []
        for rows, cols, dot in sparse.products(own, topics.indices.to_numpy().astype(np.int64), asked.column("at").to_numpy(), asked.column("rw").to_numpy(), len(topics.dictionary)):
            parts.append(pa.RecordBatch.from_arrays([topics.dictionary.take(pa.array(cols)), own.ids.take(pa.array(rows)), pa.array(dot), pa.array(norm[rows])], schema=schema))
        return pa.Table.from_batches(parts, schema)

    return packed.select("block", "docs", "terms", "cells").groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(meet, kind)


def subtopic_coverage(pages: DataFrame, references: DataFrame, full: float = 0.78, partial: float = 0.60) -> DataFrame:
    """Best page per reference sub-topic by term cosine: 1, 0.5 or 0; ``pages(page, term, weight)``, ``references(subtopic, term, weight)``."""
    nr = references.groupBy("subtopic").agg(F.sqrt(F.sum(_c("weight") * _c("weight"))).alias("nr"))
    cos = term_dots(pages, references).join(nr, "subtopic").withColumn("cos", _c("dot") / (_c("norm") * _c("nr")))
    best = cos.groupBy("subtopic").agg(F.min_by(F.struct("page", "cos"), F.struct((-F.round("cos", 9)).alias("a"), "page")).alias("b"))
    rows = references.select("subtopic").distinct().join(best, "subtopic", "left")
    value = F.when(_c("b.cos") >= full, 1.0).when(_c("b.cos") >= partial, 0.5).otherwise(0.0)
    return rows.select("subtopic", F.when(value > 0, _c("b.page")).alias("page"), F.coalesce(_c("b.cos"), F.lit(0.0)).alias("similarity"), value.alias("coverage"))


def depth_score(entities: Column, questions: Column, gain: Column) -> Column:
    return numbers.js_round(numbers.weighted_mean([(entities, 0.40), (questions, 0.35), (gain, 0.25)]) * 100, 1)


def reference_terms(docs: DataFrame, key: str = "doc_id", lang: str = "lang", stopwords: tuple[str, ...] = text.STOPWORDS) -> DataFrame:
    """Words without stop words per text with count and density in percent."""
    words = docs.select(key, F.explode(F.filter(text.words(_c("text")), lambda w: ~text.is_noise(text.fold(w), stopwords))).alias("term"))
    n = words.groupBy(key, "term").agg(F.count("*").alias("n"))
    total = n.groupBy(key).agg(F.sum("n").alias("total"))
    return n.join(total, key).select(key, "term", "n", (_c("n") * 100.0 / _c("total")).alias("density"))
