"""Composite scores, decisions and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions import numbers, text
from pagewright.operators import shapes


def _c(name: str) -> Column:
    return F.col(name)


# --- decisions -----------------------------------------------------------------------------------------------

def url_protection(rows: DataFrame, score_from: float = 40, signal_from: float = 0.15) -> DataFrame:
    """keep, shield, needs-data, semantic-bridge or prune-candidate, in that order; unknown signals are never zero.

    ``rows(url, score, revenue, currency, clicks, conversions, domains, weak, related)``.
    """
    norm = lambda c, full: F.when(_c(c).isNotNull(), F.least(F.lit(1.0), F.greatest(_c(c), F.lit(0.0)) / full))
    signal = F.greatest(norm("clicks", 200.0), norm("conversions", 2.0), norm("domains", 15.0))
    unknown = _c("clicks").isNull() | _c("conversions").isNull() | _c("domains").isNull() | _c("weak")
    paid, named = _c("revenue") > 0, F.coalesce(F.trim("currency"), F.lit("")) != ""
    decision = (
        F.when(_c("score") >= score_from, "keep").when(paid & named, "shield").when(paid, "needs-data").when(_c("conversions") > 0, "shield")
        .when(signal >= signal_from, "shield").when(unknown, "needs-data").when(_c("related"), "semantic-bridge").otherwise("prune-candidate")
    )
    return rows.select("url", signal.alias("signal"), decision.alias("decision"))


def authority_score(rows: DataFrame) -> DataFrame:
    """.35 coverage, .30 depth, .25 cohesion, .10 velocity over the known parts, damped by focus; quadrant."""
    raw = numbers.weighted_mean([(_c("coverage"), 0.35), (_c("depth"), 0.30), (_c("cohesion"), 0.25), (_c("velocity"), 0.10)])
    raw = F.when(_c("coverage").isNotNull(), raw)
    factor = 0.7 + 0.3 * (text.clamp(_c("focus"), 0, 100) / 100)
    out = rows.withColumn("raw", F.floor(raw * 10 + 0.5) / 10).withColumn("authority", F.floor(raw * factor + 0.5))
    quadrant = F.when(_c("focus") >= 75, F.when(_c("authority") >= 75, "dominant").otherwise("specialist")).otherwise(F.when(_c("authority") >= 60, "diluted").otherwise("generalist"))
    return out.withColumn("quadrant", F.when(_c("authority").isNotNull(), quadrant))


def velocity(fresh_share: Column, cannibal_index: Column) -> Column:
    return numbers.js_round(numbers.weighted_mean([(fresh_share, 0.6), (1 - F.least(F.lit(100.0), cannibal_index) / 100, 0.4)]) * 100, 1)


def same_name(a: Column, b: Column, honorifics: tuple[str, ...] = ("dr", "prof", "mgr", "inz", "mr", "mrs", "ms")) -> Column:
    """True for equal or contained token sets of at least two names; null where either is a single name."""
    tokens = lambda c: F.filter(text.words(text.fold(c)), lambda w: ~w.isin(*honorifics))
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.when((F.size(x) >= 2) & (F.size(y) >= 2), inside)


def holistic_score(modules: DataFrame, min_weight: float = 0.5) -> DataFrame:
    """Weighted mean over the measured modules; partial or insufficient below a minimum weight; ``(site, module, weight, value)``."""
    known = _c("value").isNotNull()
    out = modules.groupBy("site").agg(
        (F.sum(F.when(known, _c("weight") * _c("value"))) / F.sum(F.when(known, _c("weight")))).alias("value"), F.sum(F.when(known, _c("weight")).otherwise(0.0)).alias("known"), F.sum("weight").alias("all")
    )
    share = _c("known") / _c("all")
    state = F.when(share >= 1, "ready").when(share >= min_weight, "partial").otherwise("insufficient")
    return out.select("site", F.when(share >= min_weight, _c("value")).alias("score"), share.alias("known_share"), state.alias("state"))


# --- roll-ups ------------------------------------------------------------------------------------------------

def coverage_ratio(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Importance-weighted coverage, mean depth and number of missing sub-topics; ``(…, importance, coverage, depth)``."""
    return rows.groupBy(*keys).agg(
        F.try_divide(F.sum(_c("importance") * _c("coverage")), F.sum("importance")).alias("coverage_ratio"), F.avg("depth").alias("mean_depth"), F.count_if(_c("coverage") == 0).alias("gaps")
    )


def template_clusters(pages: DataFrame) -> DataFrame:
    return pages.groupBy("pattern", "signature").agg(F.count("*").alias("pages"), F.min("url").alias("first_url"))


def template_gain(pages: DataFrame, min_pages: int = 10, shared_share: float = 0.8, thin_below: float = 0.3, noindex_below: float = 0.15) -> DataFrame:
    """Mean share of each page's words that less than four fifths of its template cluster use; ``(cluster, page, text)``."""
    words = pages.select("cluster", "page", F.explode(F.array_distinct(text.words(_c("text")))).alias("word"))
    size = pages.groupBy("cluster").agg(F.count("*").alias("pages"))
    df = words.groupBy("cluster", "word").agg(F.count("*").alias("df")).join(size, "cluster")
    own = words.join(df.select("cluster", "word", (_c("df") / _c("pages") < shared_share).alias("own")), ["cluster", "word"])
    per = own.groupBy("cluster", "page").agg(F.avg(_c("own").cast("double")).alias("gain"))
    out = per.groupBy("cluster").agg(F.avg("gain").alias("gain")).join(size, "cluster").where(_c("pages") >= min_pages)
    action = F.when(_c("gain") < noindex_below, "noindex").when(_c("gain") < thin_below, "enrich").otherwise("none")
    return out.select("cluster", "pages", "gain", F.when(_c("gain") < thin_below, "thin").otherwise("ok").alias("verdict"), action.alias("action"))


def majority_intent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Intent with more than half of the rows, else null."""
    n = rows.groupBy(*keys, "intent").agg(F.count("*").alias("n"))
    out = n.groupBy(*keys).agg(F.max_by("intent", "n").alias("top"), F.max("n").alias("best"), F.sum("n").alias("all"))
    return out.select(*keys, F.when(_c("best") * 2 > _c("all"), _c("top")).alias("intent"))


def language_parity(depths: DataFrame, languages: list[str], reference: str, shallow: float = 0.5) -> DataFrame:
    """State of every topic in every language against the reference language; ``(topic, language, depth, local)``."""
    per = depths.groupBy("topic", "language").agg(F.max("depth").alias("depth"), F.max("local").alias("local"))
    # Languages are a short fixed list, so each topic lists them itself.
    wanted = per.groupBy("topic").agg(F.max(F.when(_c("language") == reference, _c("depth"))).alias("ref"), F.max("local").alias("any_local")).withColumn("language", F.explode(F.array(*[F.lit(x) for x in languages])))
    rows = wanted.join(per.select("topic", "language", "depth"), ["topic", "language"], "left").where(_c("language") != reference)
    state = (
        F.when(_c("depth").isNull() & _c("any_local"), "intentionally-local").when(_c("depth").isNull(), "missing")
        .when(_c("depth") < _c("ref") * shallow, "shallow").otherwise("covered")
    )
    return rows.select("topic", "language", "depth", state.alias("state"))


def citation_quality(links: DataFrame, target: float = 5.0) -> DataFrame:
    """Trusted, scholarly and external counts per article and a quality of at most 1; ``(article, source_class, dead)``."""
    q = F.when(_c("dead"), -0.3).when(_c("source_class") == "A", 1.0).when(_c("source_class") == "B", 0.7).when(_c("source_class") == "C", 0.2).otherwise(0.0)
    return links.groupBy("article").agg(
        F.count("*").alias("external"), F.count_if(_c("source_class") == "A").alias("trusted"), F.count_if("dead").alias("dead"), F.sum(q).alias("quality")
    ).withColumn("share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c("quality") / target)))


def page_citation_score(share: Column, backed: Column) -> Column:
    return share * (0.4 + 0.6 * backed)


def authorship_coverage(articles: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of articles with author, date, reviewer and publisher, blended .30/.35/.20/.15 over the known ones."""
    share = lambda c: F.avg(_c(c).cast("double")).alias(c)
    out = articles.groupBy(*keys).agg(share("author"), share("dated"), share("reviewer"), share("publisher"))
    return out.withColumn("score", numbers.weighted_mean([(_c("author"), 0.30), (_c("dated"), 0.35), (_c("reviewer"), 0.20), (_c("publisher"), 0.15)]))


def author_rollup(bylines: DataFrame) -> DataFrame:
    """Articles, profiles and stated skills per author, merged by id or folded name; ``(page, author_id, name, same_as, skill)``."""
    key = F.coalesce(_c("author_id"), text.fold(_c("name")))
    return bylines.withColumn("author", key).groupBy("author").agg(
        F.countDistinct("page").alias("articles"), F.min("name").alias("name"), F.countDistinct("same_as").alias("profiles"), F.countDistinct("skill").alias("skills")
    )


def consensus(docs: DataFrame, common: float = 0.5, rare: float = 0.2) -> DataFrame:
    """Entities by the share of reference documents that hold them; ``(query, doc, entity)``."""
    df = docs.groupBy("query", "entity").agg(F.countDistinct("doc").alias("df"))
    size = docs.select("query", "doc").distinct().groupBy("query").agg(F.count("*").alias("docs"))
    share = _c("df") / _c("docs")
    return df.join(size, "query").select("query", "entity", "df", share.alias("share"), F.when(share >= common, "consensus").when(share <= rare, "rare").otherwise("shared").alias("kind"))


def centroids(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean unit vector per group, summed by dimension before anything is gathered."""
    rows = vectors.select(*keys, F.posexplode(numbers.unit(_c("v"))).alias("d", "x"))
    mean = rows.groupBy(*keys, "d").agg(F.avg("x").alias("x"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


def novel_and_missing(target: DataFrame, baseline: DataFrame) -> DataFrame:
    """Target entities outside the consensus, and consensus entities the target lacks; ``target(query, entity)``."""
    core = baseline.where("kind = 'consensus'").select("query", "entity")
    mine = target.select("query", "entity").distinct()
    return mine.join(core, ["query", "entity"], "left_anti").withColumn("code", F.lit("novel")).unionByName(core.join(mine, ["query", "entity"], "left_anti").withColumn("code", F.lit("missing")))


def divergence(left: DataFrame, right: DataFrame, keys: list[str], smooth: float = 0.0) -> DataFrame:
    """Jensen-Shannon divergence of two term distributions per group, 0 to 1; ``(keys, term, n)``.

    Every group has its totals joined from aggregates, so a group of any size is summed in parts.
    """
    pair = (
        left.select(*keys, "term", _c("n").cast("double").alias("a"), F.lit(0.0).alias("b")).unionByName(right.select(*keys, "term", F.lit(0.0).alias("a"), _c("n").cast("double").alias("b")))
        .groupBy(*keys, "term").agg((F.sum("a") + smooth).alias("a"), (F.sum("b") + smooth).alias("b"))
    )
    total = pair.groupBy(*keys).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    rows = pair.join(total, keys).where("ta > 0 AND tb > 0").withColumn("p", _c("a") / _c("ta")).withColumn("q", _c("b") / _c("tb")).withColumn("m", (_c("p") + _c("q")) / 2)
    part = lambda x: F.when(_c(x) > 0, _c(x) * F.log(_c(x) / _c("m"))).otherwise(0.0)
    return rows.groupBy(*keys).agg((F.sum(part("p") + part("q")) / 2 / F.log(F.lit(2.0))).alias("divergence")).withColumn("divergence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c("divergence"))))


def cannibal_index(groups: DataFrame, eligible: DataFrame, keys: list[str]) -> DataFrame:
    """Share of pages beyond the first of each group, in percent of the eligible pages."""
    extra = groups.groupBy(*keys).agg(F.sum(_c("members") - 1).alias("extra"))
    return eligible.join(extra, keys, "left").select(*keys, (F.coalesce("extra", F.lit(0)) * 100.0 / _c("eligible")).alias("cannibal_index"))


def competitor_ranking(scores: DataFrame) -> DataFrame:
    """Rank, mean and distance to the best of the sites of a query; ``(query, site, score)``.

    Equal scores are counted once, so the ordered window holds distinct scores, not sites.
    """
    steps = scores.groupBy("query", "score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.partitionBy("query").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1))
    place = steps.select("query", "score", (F.coalesce(above, F.lit(0)) + 1).alias("rank"))
    stats = scores.groupBy("query").agg(F.avg("score").alias("mean"), F.max("score").alias("best"))
    return scores.join(place, ["query", "score"]).join(stats, "query").select("query", "site", "score", "rank", "mean", (_c("best") - _c("score")).alias("to_best"))


def score_histogram(scores: DataFrame, keys: list[str], buckets: int = 10) -> DataFrame:
    return scores.groupBy(*keys, F.least(F.floor(_c("score") / (100.0 / buckets)), F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("pages"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def freshness_ratio(pages: DataFrame, keys: list[str], today: str, days: int = 365) -> DataFrame:
    """Share of dated pages at most a year old; null where none is dated."""
    age = F.datediff(F.lit(today).cast("date"), _c("date"))
    return pages.groupBy(*keys).agg(F.avg((age <= days).cast("double")).alias("fresh_share"), F.count("date").alias("dated"))


def taxonomy(headings: DataFrame, sources: int = 2, limit: int = 60) -> DataFrame:
    """Sub-topics backed by several sources, by source share; ``(topic, source, key)``."""
    per = headings.groupBy("topic", "key").agg(F.countDistinct("source").alias("sources")).where(_c("sources") >= sources)
    total = headings.select("topic", "source").distinct().groupBy("topic").agg(F.count("*").alias("all"))
    rows = per.join(total, "topic").withColumn("importance", _c("sources") / _c("all"))
    return shapes.top_k(rows, ["topic"], limit, F.desc("sources"), _c("key")).select("topic", "key", "sources", "importance", "rank")


def entity_language_gaps(links: DataFrame, languages: list[str]) -> DataFrame:
    """Languages that lack an entity another language has; links by hand beat exact labels, then the first candidate.

    ``(topic, language, entity, priority)``.
    """
    best = links.groupBy("topic", "language").agg(F.min_by("entity", F.struct("priority", "entity")).alias("entity"))
    per = best.groupBy("entity").agg(F.collect_set("language").alias("have"))
    gaps = F.array_except(F.array(*[F.lit(x) for x in languages]), "have")
    return per.where(F.size(gaps) > 0).select("entity", F.array_join(F.array_sort(gaps), ",").alias("missing"))


def group_canonical(members: DataFrame) -> DataFrame:
    """Best member per group by score, inbound links, terms and address."""
    order = F.struct((-_c("score")).alias("a"), (-_c("inbound")).alias("b"), (-_c("terms")).alias("c"), "url")
    return members.groupBy("group").agg(F.min_by("url", order).alias("canonical"), F.count("*").alias("members"))


def rank_actions(actions: DataFrame) -> DataFrame:
    """Open first, then gain per effort, gain, id; unknown gains last."""
    return actions.withColumn("ratio", F.try_divide(_c("delta"), _c("effort"))).orderBy((_c("state") == "open").desc(), F.desc_nulls_last("ratio"), F.desc_nulls_last("delta"), "id")


def merge_actions(actions: DataFrame) -> DataFrame:
    """One action per id: evidence united, strongest change kept; ``(id, kind, delta, evidence array)``."""
    flat = actions.select("id", "kind", "delta", F.explode_outer("evidence").alias("e"))
    return flat.groupBy("id").agg(F.min("kind").alias("kind"), F.max_by("delta", F.abs("delta")).alias("delta"), F.array_sort(F.collect_set("e")).alias("evidence"))


def arbitrate_actions(actions: DataFrame, guarded: DataFrame) -> DataFrame:
    """Drop actions that clash on an address: keeping beats pruning, merging comes before expanding, guarded addresses stay.

    ``(id, kind, urls array)``. What an address holds is aggregated first, so addresses with many actions stay one row.
    """
    rows = actions.select("id", "kind", F.explode("urls").alias("url"))
    held = rows.groupBy("url").agg(*[F.max(_c("kind") == k).alias(k) for k in ("keep", "merge")])
    safe = guarded.select("url").distinct().withColumn("guarded", F.lit(True))
    judged = rows.join(held, "url").join(safe, "url", "left").withColumn(
        "reason", F.when((_c("kind") == "prune") & _c("guarded"), "guarded").when((_c("kind") == "prune") & _c("keep"), "kept-elsewhere").when((_c("kind") == "expand") & _c("merge"), "merge-first")
    )
    return judged.groupBy("id", "kind").agg(F.min("reason").alias("reason"), F.count("*").alias("urls")).withColumn("active", _c("reason").isNull())


def unique_pages(pages: DataFrame, key: str, *order: Column) -> DataFrame:
    return shapes.latest(pages, [key], *order)


def format_gaps(features: DataFrame, share: float = 0.6, min_pages: int = 3) -> DataFrame:
    """Formats most reference pages of a query have and the own page lacks; ``(query, page, own, tables, lists, videos, faqs)``."""
    names = ("tables", "lists", "videos", "faqs")
    ref = features.where(~_c("own")).groupBy("query").agg(F.count("*").alias("refs"), *[F.avg((_c(n) > 0).cast("double")).alias(f"{n}_share") for n in names])
    mine = features.where("own").join(ref, "query").where(_c("refs") >= min_pages)
    found = F.array_compact(F.array(*[F.when((_c(f"{n}_share") >= share) & (_c(n) == 0), F.lit(n)) for n in names]))
    return mine.select("query", "page", F.explode(found).alias("format"))


def structure_alignment(features: DataFrame, caps: dict[str, float], min_pages: int = 3) -> DataFrame:
    """How close a page's structure lies to the mean of its reference pages, 0-100; ``(query, page, own, …features)``."""
    vec = F.array(*[F.least(F.lit(1.0), _c(n) / cap) for n, cap in caps.items()])
    rows = features.withColumn("v", vec)
    ref = rows.where(~_c("own")).groupBy("query").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(len(caps))]).alias("m"), F.count("*").alias("refs"))
    mine = rows.where("own").join(ref, "query")
    size = numbers.norm(_c("v")) + numbers.norm(_c("m"))
    gap = numbers.norm(F.zip_with("v", "m", lambda a, b: a - b))
    score = numbers.js_round(100 * (1 - F.try_divide(gap, size)), 1)
    ok = (_c("refs") >= min_pages) & (size > 0)
    return mine.select("query", "page", F.when(ok, score).alias("score"), F.when(~ok, "inconclusive").when(score < 60, "mismatch").otherwise("aligned").alias("state"))


# Words of headings that tell an intent.
INTENT_WORDS = {
    "definitional": r"what is|what are|definition|co to jest|czym jest|was ist|qu'est-ce|qué es|cos'è|o que é",
    "how-to": r"how to|jak |wie man|cómo|comment |come |como ",
    "troubleshooting": r"error|fix|not working|troubleshoot|problem|błąd|napraw|nie działa|fehler|lösung|solución|erreur|errore|erro",
    "comparison": r"\bvs\b|versus|compar|porówn|vergleich|différence|differenza|diferença|diferencia",
    "curated-list": r"\bbest\b|\btop \d|najlepsz|beste|mejores|meilleurs|migliori|melhores|\d+ (?:ways|tools|tips|sposob|tipps)",
}


# What speaks for an intent: (intent, feature, enough of it, weight, feature without which it doesn't count).
INTENT_SIGNS = (
    ("definitional", "definitional_heading", 1, 0.8, None), ("definitional", "long_text", 1, 0.2, "definitional_heading"),
    ("how-to", "how-to_heading", 1, 0.5, None), ("how-to", "ordered_lists", 1, 0.5, None),
    ("troubleshooting", "troubleshooting_heading", 1, 0.7, None), ("troubleshooting", "ordered_lists", 1, 0.3, "troubleshooting_heading"),
    ("comparison", "comparison_heading", 1, 0.5, None), ("comparison", "tables", 1, 0.5, None),
    ("curated-list", "curated-list_heading", 1, 0.6, None), ("curated-list", "lists", 2, 0.2, None), ("curated-list", "product_cards", 3, 0.2, None),
    ("tool", "calculators", 1, 0.7, None), ("tool", "form_inputs", 1, 0.3, "calculators"),
    ("transactional", "product_cards", 1, 0.6, None), ("transactional", "form_inputs", 1, 0.2, "product_cards"), ("transactional", "product_cards", 3, 0.2, None),
    ("local", "local_signals", 2, 1.0, None),
)


def micro_intents(features: DataFrame, min_score: float = 0.3, mixed_ratio: float = 0.8) -> DataFrame:
    """Leading intent of each page from heading words and structure, further strong ones, and how sure it is.

    An intent's score is the weighted sum of its signs; a rival close to it takes a fifth of the confidence.
    """
    count = {c: _c(c).cast("double") for c in ("ordered_lists", "tables", "product_cards", "calculators", "form_inputs", "local_signals")}
    count |= {f"{k}_heading": F.lower("heading_text").rlike(v).cast("double") for k, v in INTENT_WORDS.items()}
    count |= {"lists": (_c("ordered_lists") + _c("unordered_lists")).cast("double"), "long_text": (_c("words") >= 300).cast("double")}

    def sign(feature: str, enough: int, weight: float, needs: str | None) -> Column:
        value = F.least(F.lit(1.0), count[feature] / enough) * weight
        return value if needs is None else F.when(count[needs] >= 1, value).otherwise(0.0)

    intents = list(dict.fromkeys(row[0] for row in INTENT_SIGNS))
    total = {k: sum((sign(*row[1:]) for row in INTENT_SIGNS if row[0] == k), F.lit(0.0)) for k in intents}
    ranked = F.sort_array(F.array(*[F.struct(v.alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("intent")) for i, (k, v) in enumerate(total.items())]), asc=False)
    rows = features.withColumn("r", ranked).withColumn("top", F.get("r", F.lit(0)))
    rivals = F.filter(F.slice("r", 2, len(intents)), lambda x: (x["score"] >= min_score) & (x["score"] >= _c("top.score") * mixed_ratio))
    strong = _c("top.score") >= min_score
    rows = rows.withColumn("rivals", F.transform(rivals, lambda x: x["intent"]))
    sure = numbers.js_round(_c("top.score") * F.when(F.size("rivals") > 0, 0.8).otherwise(1.0), 2)
    return rows.select(
        *[c for c in ("page_id", "page") if c in features.columns], F.when(strong, _c("top.intent")).alias("intent"), F.when(strong, F.array_join("rivals", ",")).alias("mixed"),
        F.round("top.score", 4).alias("score"), F.when(strong, sure).otherwise(0.0).alias("confidence"),
    )
