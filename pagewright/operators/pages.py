"""Filters, findings and roll-ups over crawled pages and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions import status, text, urls
from pagewright.session import cut_lineage

RUN = ["site_id", "run_id"]


def _c(name: str) -> Column:
    return F.col(name)


def keys_of(df: DataFrame, names=("site_id", "run_id")) -> list[str]:
    return [c for c in names if c in df.columns]


def with_index_state(pages: DataFrame) -> DataFrame:
    verdict = _c("verdict") if "verdict" in pages.columns else None
    return pages.withColumn(
        "index_state", status.index_state(_c("http_status"), _c("meta_robots"), _c("x_robots_tag"), _c("url"), _c("canonical"), verdict)
    )


def index_gate(pages: DataFrame, include_excluded: bool = False) -> DataFrame:
    """Pages that stay: unknown state is kept."""
    rows = with_index_state(pages)
    return rows if include_excluded else rows.where(~_c("index_state").isin("noindex", "canonicalized", "error-status"))


def index_gate_summary(pages: DataFrame) -> DataFrame:
    rows = with_index_state(pages)
    return rows.groupBy(*keys_of(pages), "index_state").agg(F.count("*").alias("pages"))


def filter_links(links: DataFrame, kind: str = "all", state: str = "all", needle: str = "", sort: str = "target", descending: bool = False) -> DataFrame:
    """Link rows of one kind and status whose fields hold the search text, in the chosen order."""
    rows = links.withColumn("link_status", status.link_status(_c("error_kind"), _c("target_status"), _c("redirect_url")))
    if kind != "all":
        rows = rows.where(_c("is_internal") == (kind == "internal"))
    if state != "all":
        rows = rows.where(_c("link_status") == state)
    if needle.strip():
        hay = F.lower(F.concat_ws("\n", "source", "target", "anchor", "rel", "error_kind", "redirect_url", _c("target_status").cast("string")))
        rows = rows.where(hay.contains(needle.strip().lower()))
    first = {"source": _c("source"), "anchor": _c("anchor"), "status": F.concat_ws(" ", "link_status", "target_status"), "target": _c("target")}[sort]
    order = F.lower(first).desc() if descending else F.lower(first).asc()
    return rows.orderBy(order, "source", "pos")


def listing_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Paged addresses, or pages with many links into their own section and little text per link."""
    own = links.where(urls.section(_c("source")) == urls.section(_c("target")))
    linked = own.groupBy(*keys_of(links), _c("source").alias("url")).agg(F.countDistinct("target").alias("linked"))
    rows = pages.join(linked, [*[k for k in keys_of(links) if k in pages.columns], "url"], "left")
    paged = urls.parts(_c("url")).path.rlike(urls.PAGED_PATH)
    return rows.withColumn("is_listing", paged | status.looks_like_listing(_c("word_count"), _c("linked")))


def link_degrees(links: DataFrame) -> DataFrame:
    """Per page: distinct targets, targets deeper in the own path, distinct linking pages."""
    edges = links.where("is_internal").select(*keys_of(links), urls.url_key(_c("source"), "gate").alias("source"), urls.url_key(_c("target"), "gate").alias("target")).where("source <> target").distinct()
    keys = keys_of(links)
    below = _c("target").startswith(F.concat(F.regexp_replace("source", "/$", ""), F.lit("/"))).cast("int")
    out = edges.groupBy(*keys, _c("source").alias("url_key")).agg(F.count("*").alias("targets"), F.sum(below).alias("downward"))
    into = edges.groupBy(*keys, _c("target").alias("url_key")).agg(F.count("*").alias("inlinks"))
    return out.join(into, [*keys, "url_key"], "full_outer")


def page_types(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Homepage, category, article or technical, with the type weight."""
    keys = [k for k in keys_of(links) if k in pages.columns]
    counts = pages.groupBy(*keys).agg(F.count("*").alias("page_count"))
    rows = (
        pages.withColumn("url_key", urls.url_key(_c("url"), "gate"))
        .join(link_degrees(links), [*keys, "url_key"], "left").join(counts, keys)
    )
    kind = status.page_type(
        _c("url"), _c("title") if "title" in pages.columns else F.lit(""), _c("start_url"), _c("downward"), _c("targets"), _c("inlinks"), _c("word_count"), _c("depth"), _c("page_count")
    )
    return rows.withColumn("page_type", kind).withColumn("type_weight", status.type_weight(_c("page_type")))


def segment_of(pages: DataFrame, segments: list[tuple[str, str]]) -> DataFrame:
    """First listed segment whose path prefix matches by whole segments."""
    segs = urls.path_segments(_c("url"))
    out = None
    for label, prefix in segments[:10]:
        parts = [p for p in prefix.lower().split("/") if p]
        hit = F.slice(segs, 1, len(parts)) == F.array(*[F.lit(p) for p in parts])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return pages.withColumn("segment", out)


def text_filter(pages: DataFrame, needle: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "url", "title", _c("http_status").cast("string"), "index_state"))
    return pages.where(hay.contains(needle.strip().lower()))


def removal_quarantine(removals: DataFrame, groups: DataFrame, protected: DataFrame, needs_data: DataFrame) -> DataFrame:
    """Quarantined and conflicting URLs.

    ``removals(url)`` come first; protected or undocumented ones become conflicts. Then members of
    ``groups(canonical, url)`` redirect to their canonical, unless that canonical is itself removed.
    """
    flag = lambda df, name: df.select(urls.url_key(_c("url"), "identity").alias("k")).distinct().withColumn(name, F.lit(True))
    asked = (
        removals.select(urls.url_key(_c("url"), "identity").alias("k")).distinct()
        .join(flag(protected, "guarded"), "k", "left").join(flag(needs_data, "unknown"), "k", "left")
    )
    first = asked.select(
        "k", F.when(_c("guarded"), "protected-by-evidence").when(_c("unknown"), "needs-data").otherwise("remove").alias("outcome"),
        F.lit(None).cast("string").alias("redirect_to"),
    )
    removed = first.where("outcome = 'remove'").select("k")
    members = groups.select(urls.url_key(_c("canonical"), "identity").alias("c"), urls.url_key(_c("url"), "identity").alias("k")).distinct()
    gone = removed.select(_c("k").alias("c"), F.lit(True).alias("canonical_gone"))
    judged = members.join(gone, "c", "left")
    clash = judged.where("canonical_gone").select(_c("c").alias("k"), F.lit("canonical-removed").alias("outcome"), F.lit(None).cast("string").alias("redirect_to")).distinct()
    redirect = (
        judged.where("canonical_gone IS NULL AND k <> c").join(removed, "k", "left_anti").join(flag(protected, "guarded").select("k"), "k", "left_anti")
        .groupBy("k").agg(F.min("c").alias("redirect_to")).select("k", F.lit("redirect").alias("outcome"), "redirect_to")
    )
    return first.unionByName(clash).unionByName(redirect).withColumnRenamed("k", "url")


def drop_quarantined(items: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Suggestions whose source and target are both outside the quarantine."""
    blocked = quarantine.where("outcome IN ('remove', 'redirect')").select(_c("url").alias("k")).distinct()
    rows = items.withColumn("_s", urls.url_key(_c("source"), "identity")).withColumn("_t", urls.url_key(_c("target"), "identity"))
    return (
        rows.join(blocked.withColumnRenamed("k", "_s"), "_s", "left_anti").join(blocked.withColumnRenamed("k", "_t"), "_t", "left_anti").drop("_s", "_t")
    )


# --- joins of links and pages --------------------------------------------------------------------------------

def _status_table(pages: DataFrame, key: str) -> DataFrame:
    """One status per address, the smallest page id winning; pre-aggregated, so no address repeats."""
    return pages.groupBy(*keys_of(pages), _c("url").alias(key)).agg(
        F.min_by("http_status", "page_id").alias("target_status"), F.min_by("canonical", "page_id").alias("target_canonical")
    )


def link_target_status(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the status their target has in the same run; null where it was not crawled."""
    keys = [k for k in keys_of(links) if k in pages.columns]
    return links.join(_status_table(pages, "target").select(*keys, "target", "target_status"), [*keys, "target"], "left")


def broken_target_findings(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with internal links to failing targets, and how many distinct ones.

    Failing pages are few, so the join keeps only links to them before anything is grouped.
    """
    keys = [k for k in keys_of(links) if k in pages.columns]
    failing = _status_table(pages, "target").where("target_status = 0 OR target_status >= 400").select(*keys, "target")
    return (
        links.where("is_internal").join(failing, [*keys, "target"]).groupBy(*keys, "source")
        .agg(F.countDistinct("target").alias("broken_targets"))
    )


def canonical_target_status(pages: DataFrame) -> DataFrame:
    """Declared canonical targets with their status in the run and a finding for failing ones."""
    keys = keys_of(pages)
    declared = pages.where("trim(canonical) <> ''").select(*keys, "page_id", "url", urls.resolve(_c("url"), _c("canonical")).alias("target"))
    rows = declared.join(_status_table(pages, "target").select(*keys, "target", "target_status"), [*keys, "target"], "left")
    return rows.withColumn("finding", F.when((_c("target_status") == 0) | (_c("target_status") >= 400), "canonical-target-error"))


def relation_reciprocity(pages: DataFrame, relations: DataFrame, opposite: dict[str, str]) -> DataFrame:
    """Whether the crawled target of each declared relation declares the opposite one back; null when not crawled."""
    keys = keys_of(relations)
    mapping = F.create_map(*[F.lit(x) for pair in opposite.items() for x in pair])
    edge = relations.select(*keys, urls.url_key(_c("source"), "gate").alias("source"), F.lower("relation").alias("relation"), urls.url_key(_c("target"), "gate").alias("target")).distinct()
    crawled = pages.select(*keys_of(pages), urls.url_key(_c("url"), "gate").alias("target")).distinct().withColumn("crawled", F.lit(True))
    answer = edge.select(*keys, _c("source").alias("target"), F.col("relation").alias("back"), _c("target").alias("source")).withColumn("answered", F.lit(True))
    rows = (
        edge.withColumn("back", F.try_element_at(mapping, _c("relation"))).where("back IS NOT NULL")
        .join(crawled, [*[k for k in keys if k in pages.columns], "target"], "left").join(answer, [*keys, "target", "back", "source"], "left")
    )
    return rows.select(*keys, "source", "relation", "target", F.when(_c("crawled"), _c("answered").eqNullSafe(True)).alias("reciprocal"))


def _aligned(target_canonical: Column, target: Column, source: Column | None = None) -> Column:
    k = lambda c: urls.url_key(c, "alternate")

    def judged(c: Column) -> Column:
        own = F.when(c == k(target), "self-canonical").otherwise("canonical-points-elsewhere")
        return own if source is None else F.when(c == k(source), "canonical-to-source").otherwise(own)

    return F.when(target_canonical.isNull(), "missing-canonical").otherwise(urls.let(k(urls.resolve(target, target_canonical)), judged))


def alternate_targets(pages: DataFrame, alternates: DataFrame) -> DataFrame:
    """Language alternates with target status, reciprocity and canonical alignment of the crawled target."""
    keys = keys_of(alternates)
    shared = [k for k in keys if k in pages.columns]
    known = _status_table(pages, "target").withColumn("crawled", F.lit(True))
    declares = alternates.select(*keys, _c("source").alias("target")).distinct().withColumn("declares", F.lit(True))
    back = alternates.select(*keys, _c("source").alias("target"), _c("target").alias("source")).distinct().withColumn("answered", F.lit(True))
    rows = (
        alternates.join(known, [*shared, "target"], "left").join(declares, [*keys, "target"], "left").join(back, [*keys, "target", "source"], "left")
    )
    return rows.select(
        *keys, "source", "language", "target", "target_status",
        F.when(_c("crawled") & _c("declares"), _c("answered").eqNullSafe(True)).alias("reciprocal"),
        F.when(_c("crawled"), _aligned(_c("target_canonical"), _c("target"))).alias("alignment"),
    )


def amp_targets(pages: DataFrame, amp: DataFrame) -> DataFrame:
    """Mobile versions with status and where their canonical points."""
    keys = keys_of(amp)
    known = _status_table(pages, "target").withColumn("crawled", F.lit(True))
    rows = amp.join(known, [*[k for k in keys if k in pages.columns], "target"], "left")
    return rows.select(
        *keys, "source", "target", "target_status",
        F.when(_c("crawled"), _aligned(_c("target_canonical"), _c("target"), _c("source"))).alias("alignment"),
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, agent, directive, path) rows of robots texts given as (host, text).

    A user-agent line opens a group unless it follows another one; rules belong to every agent of their group.
    The text of one host is bounded by its file, so the scan stays inside the row.
    """
    pairs = F.filter(
        F.transform(F.split("text", r"\r?\n"), lambda l: F.struct(
            F.lower(F.trim(F.regexp_extract(F.regexp_replace(l, "#.*$", ""), "^([^:]*):", 1))).alias("k"),
            F.trim(F.regexp_extract(F.regexp_replace(l, "#.*$", ""), "^[^:]*:(.*)$", 1)).alias("v"),
        )),
        lambda p: p["k"].isin("user-agent", "allow", "disallow", "crawl-delay"),
    )
    empty = F.array().cast("array<string>")
    rule = "array<struct<agents:array<string>,k:string,v:string>>"
    folded = F.aggregate(
        pairs,
        F.struct(empty.alias("agents"), F.lit(False).alias("open"), F.array().cast(rule).alias("rules")),
        lambda acc, p: F.when(
            p["k"] == "user-agent",
            F.struct(
                F.when(acc["open"], F.concat(acc["agents"], F.array(F.lower(p["v"])))).otherwise(F.array(F.lower(p["v"]))).alias("agents"),
                F.lit(True).alias("open"), acc["rules"].alias("rules"),
            ),
        ).otherwise(F.struct(
            acc["agents"].alias("agents"), F.lit(False).alias("open"),
            F.concat(acc["rules"], F.array(F.struct(acc["agents"].alias("agents"), p["k"].alias("k"), p["v"].alias("v")))).alias("rules"),
        )),
    )
    return (
        files.select("host", F.explode(folded["rules"]).alias("r")).select("host", F.explode("r.agents").alias("agent"), F.col("r.k").alias("directive"), F.col("r.v").alias("path"))
        .where("directive = 'crawl-delay' OR path <> ''")
    )


def robots_decisions(pages: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Deciding rule per URL: most characters other than ``*`` wins, allow wins a tie.

    The rules of one host fit one robots file, so they travel as one array per host and no URL is multiplied.
    """
    own = rules.where((F.col("agent") == agent) & F.col("directive").isin("allow", "disallow"))
    literal = F.regexp_replace(F.regexp_replace("path", r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    anchored = F.when(_c("path").endswith("$"), "$").otherwise("")
    table = own.groupBy("host").agg(F.collect_set(F.struct(
        F.length(F.regexp_replace(F.regexp_replace("path", r"\$$", ""), r"\*", "")).alias("weight"), (_c("directive") == "allow").alias("allow"), _c("path").alias("rule"),
        F.concat(F.lit("^"), F.regexp_replace(literal, r"\*", ".*"), anchored).alias("pattern"),
    )).alias("rules"))
    u = urls.parts(_c("url"))
    rows = pages.withColumn("host", u.host).withColumn("_asked", F.concat(u.path, u.search)).join(table, "host", "left")
    hits = F.filter("rules", lambda r: F.regexp_like(_c("_asked"), r["pattern"]))
    best = F.array_max(hits)
    return rows.withColumn("rule", best["rule"]).withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules", "_asked", "host")


def index_conflicts(pages: DataFrame, inlinks: DataFrame, clicks: DataFrame, domains: DataFrame, sitemap: DataFrame, pillars: DataFrame, min_inlinks: int = 50) -> DataFrame:
    """Pages whose index state contradicts other evidence. Side tables are keyed ``url_key``."""
    rows = with_index_state(pages).withColumn("url_key", urls.url_key(_c("url"), "gate"))
    for side, name in ((inlinks, "inlinks"), (clicks, "clicks"), (domains, "domains")):
        rows = rows.join(side.groupBy("url_key").agg(F.max(name).alias(name)), "url_key", "left")
    for side, name in ((sitemap, "in_sitemap"), (pillars, "is_pillar")):
        rows = rows.join(side.select("url_key").distinct().withColumn(name, F.lit(True)), "url_key", "left")
    target = status.canonical_target(_c("url"), _c("canonical"))
    noindex, zero = _c("index_state") == "noindex", F.lit(0)
    codes = F.array_compact(F.array(
        F.when(noindex & _c("is_pillar"), "pillar-noindex"),
        F.when(noindex & ((F.coalesce(_c("clicks"), zero) > 0) | (F.coalesce(_c("domains"), zero) > 0)), "noindex-with-traffic"),
        F.when(noindex & _c("in_sitemap"), "sitemap-noindex"),
        F.when((_c("index_state") == "canonicalized") & (_c("inlinks") >= min_inlinks) & (urls.host(target) != urls.host(_c("url"))), "inlinked-foreign-canonical"),
    ))
    return rows.select(*keys_of(pages), "page_id", "url", "clicks", "domains", "inlinks", F.explode(codes).alias("code"))


def resolve_aliases(rows: DataFrame, aliases: DataFrame, column: str = "url_key") -> DataFrame:
    """Replace a key by its redirect or canonical target of the same origin; ``aliases(alias, target)``."""
    origin = lambda c: F.regexp_extract(c, r"^([a-z]+://[^/]+)", 1)
    table = aliases.where(origin(_c("alias")) == origin(_c("target"))).groupBy("alias").agg(F.min("target").alias("_to"))
    joined = rows.join(table.withColumnRenamed("alias", column), column, "left")
    return joined.withColumn("resolved", F.coalesce("_to", column)).drop("_to")


def dangling_references(triples: DataFrame, pages: DataFrame) -> DataFrame:
    """References to an ``@id`` with a fragment on a crawled page that no node of the run declares.

    ``triples(page, decl, path, property, value)``; a declaration needs more than an ``@id`` alone.
    """
    keys = keys_of(triples)
    node = [*keys, "page", "decl", "path"]
    # Properties that point from one entity to another.
    relations = ("author", "publisher", "creator", "mainEntityOfPage", "mainEntity", "about", "isPartOf", "worksFor", "brand", "reviewedBy")
    absolute = urls_with_fragment(_c("page"), _c("value"))
    declared = (
        triples.groupBy(*node).agg(
            F.max(F.when(_c("property") == "@id", absolute)).alias("id"),
            F.count_if(~_c("property").isin("@id")).alias("others"),
        ).where("id IS NOT NULL AND others > 0").select(*keys, F.col("id").alias("target")).distinct()
    )
    base = lambda c: urls.url_key(F.regexp_replace(c, "#.*$", ""), "gate")
    crawled = pages.select(*keys_of(pages), base(_c("url")).alias("base")).distinct()
    # Written once, so that no filter or join works the addresses out again.
    refs = cut_lineage(triples.where(_c("property").isin(*relations)).select(*keys, "page", "property", "value").distinct().withColumn("target", absolute))
    # Many references name one target: each target is looked up once.
    targets = refs.where(_c("target").rlike("#.+")).select(*keys, "target").distinct().withColumn("base", base(_c("target")))
    missing = targets.join(crawled, [*[k for k in keys if k in pages.columns], "base"], "left_semi").join(declared, [*keys, "target"], "left_anti")
    lost = missing.select(*[_c(k).alias("_" + k) for k in (*keys, "target")])
    return refs.join(lost, [_c(k).eqNullSafe(_c("_" + k)) for k in (*keys, "target")], "left_semi").select(*keys, "page", "property", "value")


def urls_with_fragment(base: Column, ref: Column) -> Column:
    """Absolute reference with its fragment."""
    fragment = F.regexp_extract(ref, r"(#.*)$", 1)
    return F.concat(urls.resolve(base, ref), fragment)


def entity_nodes(triples: DataFrame) -> DataFrame:
    """One row per structured-data node: id, types, names, sameAs."""
    keys = keys_of(triples)
    pick = lambda p: F.array_sort(F.collect_set(F.when(_c("property") == p, F.lower(F.trim("value")))))
    return triples.groupBy(*keys, "page", "decl", "path").agg(
        F.max(F.when(_c("property") == "@id", urls_with_fragment(_c("page"), _c("value")))).alias("id"),
        pick("@type").alias("types"), pick("name").alias("names"), pick("sameAs").alias("same_as"),
        F.count_if(_c("property") != "@id").alias("others"),
    )


#: What a structured-data type should state: types, any of these properties, finding, severity.
PROFILE_RULES = (
    ("product", "name", "product-name-missing", "warning"), ("product", "offers review aggregaterating", "product-offer-review-missing", "warning"),
    ("breadcrumblist", "itemlistelement", "breadcrumb-items-missing", "warning"), ("article newsarticle blogposting", "headline", "article-headline-recommended", "info"),
    ("organization website webpage localbusiness", "name", "schema-name-missing", "warning"), ("faqpage", "mainentity", "faq-main-entity-missing", "warning"),
    ("question", "name", "question-name-missing", "warning"), ("event", "name", "event-name-missing", "warning"), ("recipe", "name", "recipe-name-missing", "warning"),
    ("videoobject", "name", "video-name-missing", "warning"), ("review", "reviewbody", "review-body-missing", "info"), ("person author", "name", "person-name-missing", "warning"),
    ("imageobject", "contenturl url", "image-url-missing", "warning"),
)


def profile_findings(triples: DataFrame) -> DataFrame:
    """(keys, page, decl, path, code, severity): properties that a node's type asks for and the node lacks or leaves empty.

    Types may be full addresses; a node with several types of one rule has its finding once. The rules meet the nodes by
    type, so a node is copied once for each of its types.
    """
    keys = [*keys_of(triples, ("site_id", "run_id", "page_id")), "page", "decl", "path"]
    kind = F.lower(F.regexp_extract("value", r"([^/#:]+)$", 1))
    types = triples.where("property = '@type'").select(*keys, kind.alias("type")).distinct()
    stated = triples.where("value IS NULL OR trim(value) <> ''").groupBy(*keys).agg(F.collect_set(F.lower("property")).alias("stated"))
    rows = [(t, wanted.split(), code, severity) for names, wanted, code, severity in PROFILE_RULES for t in names.split()]
    rules = triples.sparkSession.createDataFrame(rows, "type string, wanted array<string>, code string, severity string")
    met = types.join(rules, "type").join(stated, keys, "left")
    return met.where(~F.coalesce(F.arrays_overlap("wanted", "stated"), F.lit(False))).select(*keys, "code", "severity").distinct()


def entity_registry(nodes: DataFrame) -> DataFrame:
    """Nodes of one id merged across pages."""
    return nodes.where("id IS NOT NULL AND others > 0").groupBy(*keys_of(nodes), "id").agg(
        F.count("*").alias("declarations"), F.countDistinct("page").alias("pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"),
    )


def entity_conflicts(nodes: DataFrame) -> DataFrame:
    """Ids declared with different names, types or sameAs; names repeated over pages without an id.

    Every count is over distinct values, so a hot id is reduced before it is shuffled.
    """
    keys = keys_of(nodes)
    named = nodes.where("id IS NOT NULL AND others > 0")
    kinds = named.withColumn("t", F.filter("types", lambda x: ~x.isin("thing", "intangible")))
    exploded = kinds.where(F.size("t") > 0).select(*keys, "id", "page", "decl", "path", F.explode("t").alias("type"))
    per_type = exploded.groupBy(*keys, "id", "type").agg(F.count("*").alias("n"))
    typed = kinds.groupBy(*keys, "id").agg(F.count_if(F.size("t") > 0).alias("typed_nodes"))
    type_clash = per_type.groupBy(*keys, "id").agg(F.max("n").alias("widest")).join(typed, [*keys, "id"]).where("typed_nodes > 1 AND widest < typed_nodes").select(*keys, "id", F.lit("type-conflict").alias("code"))
    name_clash = named.select(*keys, "id", F.explode("names").alias("v")).distinct().groupBy(*keys, "id").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "id", F.lit("name-conflict").alias("code"))
    same = named.where(F.size("same_as") > 0).groupBy(*keys, "id").agg(F.countDistinct(F.array_join("same_as", "\x1f")).alias("n")).where("n > 1").select(*keys, "id", F.lit("same-as-conflict").alias("code"))
    loose = (
        nodes.where("id IS NULL").select(*keys, "page", F.explode(F.array_intersect("types", F.array(F.lit("organization"), F.lit("person"), F.lit("website")))).alias("kind"), "names")
        .select(*keys, "page", "kind", F.explode("names").alias("name")).groupBy(*keys, "kind", "name").agg(F.countDistinct("page").alias("n")).where("n > 1")
        .select(*keys, F.concat_ws(":", "kind", "name").alias("id"), F.lit("name-without-id").alias("code"))
    )
    return type_clash.unionByName(name_clash).unionByName(same).unionByName(loose)


# --- aggregates ----------------------------------------------------------------------------------------------

def health_score(pages: DataFrame, findings: DataFrame, types_counted: int = 3) -> DataFrame:
    """Run score: shares of pages hit by the three commonest critical and warning kinds, 60 and 30 points, floor 20.

    ``findings(page_id, severity, message)``; ``pages`` carries ``usable`` (HTML without request error) and ``partial``.
    """
    keys = keys_of(pages)
    totals = pages.groupBy(*keys).agg(
        F.count("*").alias("pages"), F.count_if("usable").alias("usable_pages"), F.count_if(_c("usable") & _c("partial")).alias("partial_pages")
    )
    kinds = (
        findings.withColumn("kind", text.finding_type(_c("message"))).groupBy(*keys, "severity", "kind").agg(F.countDistinct("page_id").alias("hit"))
    )
    # Few kinds exist per run, so the top three are taken from a small aggregate.
    top = kinds.groupBy(*keys, "severity").agg(F.slice(F.sort_array(F.collect_list("hit"), asc=False), 1, types_counted).alias("hits"))
    share = F.aggregate("hits", F.lit(0).cast("long"), lambda a, b: a + b)
    side = top.groupBy(*keys).agg(
        F.max(F.when(_c("severity") == "Critical", share)).alias("critical_hits"), F.max(F.when(_c("severity") == "Warning", share)).alias("warning_hits")
    )
    counts = findings.groupBy(*keys).agg(*[F.count_if(_c("severity") == s).alias(n) for s, n in (("Critical", "critical_count"), ("Warning", "warning_count"), ("Info", "notice_count"))])
    rows = totals.join(side, keys, "left").join(counts, keys, "left").fillna(0, ["critical_hits", "warning_hits", "critical_count", "warning_count", "notice_count"])
    penalty = F.least(
        F.lit(80), F.ceil(_c("critical_hits") / _c("pages") / types_counted * 60 + _c("warning_hits") / _c("pages") / types_counted * 30)
    )
    cap = F.when(_c("usable_pages") == 0, 50).when(_c("partial_pages") > 0, 90).otherwise(100)
    return rows.withColumn("health_score", F.greatest(F.lit(20), F.least(cap, 100 - penalty)).cast("long"))


def duplicate_texts(pages: DataFrame, column: str) -> DataFrame:
    """Texts, trimmed and lower case, used by more than one page of a run."""
    keyed = pages.withColumn("text_key", F.lower(F.trim(_c(column)))).where("text_key <> ''")
    return keyed.groupBy(*keys_of(pages), "text_key").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


def directory_rollup(pages: DataFrame) -> DataFrame:
    """Status, finding and word counts of every directory, descendants included."""
    u = urls.parts(_c("url"))
    origin = F.concat(u.scheme, F.lit("://"), u.host)
    base = pages.where(u.is_web).groupBy(
        *keys_of(pages), origin.alias("origin"), urls.path_prefixes(_c("url")).alias("prefixes")
    ).agg(*_directory_measures(_c("http_status"), _c("request_error_kind")))
    # Pages are summed per folder first, so prefixes multiply folders, not pages.
    names = [c for c in base.columns if c not in (*keys_of(pages), "origin", "prefixes")]
    return (
        base.withColumn("directory", F.explode("prefixes")).groupBy(*keys_of(pages), "origin", "directory")
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("avg_response_ms", F.try_divide(_c("response_ms").cast("double"), _c("timed_pages"))).drop("response_ms", "timed_pages")
    )


def _directory_measures(code: Column, error: Column) -> list[Column]:
    failed = error.isNotNull() | (code <= 0)
    band = lambda lo: F.count_if(~failed & code.between(lo, lo + 99))
    return [
        F.count("*").alias("pages"), F.count_if(failed).alias("request_errors"), band(200).alias("status_2xx"), band(300).alias("status_3xx"),
        band(400).alias("status_4xx"), band(500).alias("status_5xx"), F.sum(F.greatest(_c("word_count"), F.lit(0))).alias("words"),
        F.coalesce(F.sum("response_time_ms"), F.lit(0)).alias("response_ms"), F.count("response_time_ms").alias("timed_pages"),
    ]


def inbound_sources(links: DataFrame) -> DataFrame:
    """Distinct linking pages per target, self-links dropped."""
    return links.where("source <> target").groupBy(*keys_of(links), "target").agg(F.countDistinct("source").alias("inbound"))


def orphan_pages(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that are no root and that no other page links to."""
    keys = keys_of(nodes)
    linked = edges.where("source <> target").select(*keys_of(edges), F.col("target").alias("node")).distinct()
    return nodes.join(linked, [*[k for k in keys if k in edges.columns], "node"], "left_anti").join(roots, "node", "left_anti")


def resource_inventory(resources: DataFrame, pages: DataFrame) -> DataFrame:
    """Resources by how many of their source pages the run holds; an empty source list is unknown."""
    key = lambda c: F.regexp_replace(urls.url_key(c, "gate"), "/$", "")
    known = pages.select(key(_c("url")).alias("source")).distinct().withColumn("known", F.lit(True))
    rows = resources.select("resource", F.explode_outer("source_urls").alias("s")).select("resource", key(_c("s")).alias("source")).distinct()
    counted = rows.join(known, "source", "left").groupBy("resource").agg(F.count("source").alias("sources"), F.count("known").alias("known_sources"))
    state = (
        F.when(_c("sources") == 0, "unknown").when(_c("known_sources") == _c("sources"), "referenced").when(_c("known_sources") > 0, "partial").otherwise("orphaned")
    )
    return counted.withColumn("state", state)


def readiness_checks(pages: DataFrame) -> DataFrame:
    """One row per check with failing, warned and unknown pages, its state, and the run's score over known checks."""
    keys = keys_of(pages)
    code, blank = _c("http_status"), lambda c: F.coalesce(F.trim(_c(c)), F.lit("")) == ""
    checks = {
        "http-response": (_c("request_error_kind").isNotNull() | (code == 0) | (code >= 400), code.between(300, 399)),
        "metadata": (blank("title"), ~blank("title") & (blank("description") | blank("canonical"))),
        "content": (_c("word_count") <= 0, F.lit(False)),
        "language": (F.lit(False), blank("language")),
    }
    sums = pages.groupBy(*keys).agg(
        F.count("*").alias("pages"), *[F.count_if(bad).alias(f"{n}|e") for n, (bad, _) in checks.items()], *[F.count_if(warn).alias(f"{n}|w") for n, (_, warn) in checks.items()]
    )
    rows = sums.select(*keys, "pages", F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), _c(f"`{n}|e`").alias("errors"), _c(f"`{n}|w`").alias("warnings")) for n in checks
    ])).alias("c")).select(*keys, "pages", "c.check", "c.errors", "c.warnings")
    return rows.withColumn("state", F.when(_c("errors") > 0, "error").when(_c("warnings") > 0, "warning").otherwise("pass"))


def readiness_score(checks: DataFrame) -> DataFrame:
    points = F.when(_c("state") == "pass", 100).when(_c("state") == "warning", 50).when(_c("state") == "error", 0)
    return checks.groupBy(*keys_of(checks)).agg(F.floor(F.avg(points) + 0.5).alias("score"), F.count(points).alias("known_checks"))


def status_findings(pages: DataFrame, slow_ms: int = 2000) -> DataFrame:
    """HTTP findings of each page: errors, redirects, slow answers."""
    code = _c("http_status")
    found = F.array_compact(F.array(
        F.when(_c("request_error_kind").isNotNull() | (code == 0), F.struct(F.lit("Critical").alias("severity"), F.lit("request-failed").alias("code"))),
        F.when(code >= 500, F.struct(F.lit("Critical").alias("severity"), F.lit("server-error").alias("code"))),
        F.when(code.between(400, 499), F.struct(F.lit("Critical").alias("severity"), F.lit("client-error").alias("code"))),
        F.when(code.between(300, 399), F.struct(F.lit("Warning").alias("severity"), F.lit("redirect").alias("code"))),
        F.when(_c("response_time_ms") > slow_ms, F.struct(F.lit("Warning").alias("severity"), F.lit("slow-response").alias("code"))),
    ))
    return pages.select(*keys_of(pages), "page_id", F.explode(found).alias("f")).select(*keys_of(pages), "page_id", "f.severity", "f.code")


def page_audit_score(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """100 less 15, 5 and 1 per finding by severity; 0 for failing pages."""
    points = F.when(_c("severity") == "Critical", 15).when(_c("severity") == "Warning", 5).otherwise(1)
    lost = findings.groupBy("page_id").agg(F.sum(points).alias("lost"))
    score = F.when(_c("http_status") >= 400, 0).otherwise(F.greatest(F.lit(0), 100 - F.coalesce(_c("lost"), F.lit(0))))
    return pages.join(lost, "page_id", "left").select(*keys_of(pages), "page_id", score.cast("long").alias("score"))


def redirect_chains(hops: DataFrame, limit: int = 10) -> DataFrame:
    """Chains from an array of hop addresses: length, loop, limit, end."""
    loop = F.size(F.array_distinct("hops")) < F.size("hops")
    reason = F.when(loop, "loop").when(F.size("hops") - 1 >= limit, "limit").when(F.size("hops") > 1, "redirected").otherwise("direct")
    return hops.select(*[c for c in hops.columns if c != "hops"], (F.size("hops") - 1).alias("redirects"), F.element_at("hops", -1).alias("final_url"), reason.alias("reason"))


def security_findings(pages: DataFrame) -> DataFrame:
    """Missing or weak response headers; ``headers`` is a map with lower-case names."""
    h = lambda n: F.try_element_at(_c("headers"), F.lit(n))
    age = F.regexp_extract(h("strict-transport-security"), r"max-age=([0-9]+)", 1).try_cast("long")
    codes = F.array_compact(F.array(
        F.when(h("strict-transport-security").isNull(), "hsts-missing").when(F.coalesce(age, F.lit(0)) < 15552000, "hsts-short"),
        F.when(h("x-frame-options").isNull() & ~F.coalesce(h("content-security-policy"), F.lit("")).contains("frame-ancestors"), "frame-protection-missing"),
        F.when(F.lower(F.coalesce(h("x-content-type-options"), F.lit(""))) != "nosniff", "nosniff-missing"),
        F.when(h("content-security-policy").isNull(), "csp-missing").when(h("content-security-policy").rlike("unsafe-inline|unsafe-eval"), "csp-unsafe"),
        F.when(h("referrer-policy").isNull(), "referrer-policy-missing"),
        F.when(h("permissions-policy").isNull(), "permissions-policy-missing"),
    ))
    return pages.select(*keys_of(pages), "page_id", F.explode(codes).alias("code"))


def cookie_findings(pages: DataFrame) -> DataFrame:
    """Cookies without Secure, HttpOnly or SameSite; ``set_cookie`` is an array of header values."""
    rows = pages.select(*keys_of(pages), "page_id", F.explode("set_cookie").alias("cookie"))
    parts = F.transform(F.split(F.lower("cookie"), ";"), lambda p: F.trim(p))
    codes = F.array_compact(F.array(
        F.when(~F.array_contains(parts, "secure"), "secure-missing"), F.when(~F.array_contains(parts, "httponly"), "httponly-missing"),
        F.when(~F.exists(parts, lambda p: p.startswith("samesite=")), "samesite-missing"),
        F.when(F.exists(parts, lambda p: p == "samesite=none") & ~F.array_contains(parts, "secure"), "samesite-none-insecure"),
    ))
    return rows.select(*keys_of(pages), "page_id", F.regexp_extract("cookie", "^([^=;]+)", 1).alias("name"), F.explode(codes).alias("code"))


def mixed_content(resources: DataFrame) -> DataFrame:
    """Plain http resources on https pages; ``resources(page, kind, target)``."""
    active = _c("kind").isin("script", "iframe", "stylesheet", "object")
    return resources.where(F.lower("page").startswith("https://") & F.lower("target").startswith("http://")).withColumn(
        "code", F.when(active, "mixed-active").otherwise("mixed-passive")
    )


def page_checks(audits: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named checks per audited page; a null condition is unknown, true passes."""
    rows = audits.select(*keys_of(audits), "page_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.when(c.isNull(), "unknown").when(c, "pass").otherwise("fail").alias("state")) for n, c in checks.items()
    ])).alias("c"))
    return rows.select(*keys_of(audits), "page_id", "c.check", "c.state")


def check_rollup(check_rows: DataFrame) -> DataFrame:
    state = lambda s: F.count_if(_c("state") == s).alias(s)
    return check_rows.groupBy(*keys_of(check_rows), "check").agg(state("pass"), state("fail"), state("unknown"))


def topic_assignments(assignments: DataFrame, pages: DataFrame, today: str) -> DataFrame:
    """Topics against pages of a run: unmapped, stale, unhealthy, overdue.

    ``assignments(topic, lifecycle, planned, urls array)``.
    """
    rows = assignments.select("topic", "lifecycle", "planned", F.explode_outer("urls").alias("u")).withColumn("url_key", urls.url_key(_c("u"), "gate"))
    known = pages.groupBy(urls.url_key(_c("url"), "gate").alias("url_key")).agg(F.min_by("http_status", "page_id").alias("status"))
    per = rows.join(known, "url_key", "left").groupBy("topic", "lifecycle", "planned").agg(
        F.count("status").alias("mapped"), F.count_if(_c("u").isNotNull() & _c("status").isNull()).alias("stale"),
        F.count_if(~_c("status").between(200, 299)).alias("unhealthy"),
    )
    codes = F.array_compact(F.array(
        F.when(_c("mapped") == 0, "unmapped-topic"), F.when(_c("stale") > 0, "stale-url-assignment"),
        F.when((_c("lifecycle") == "published") & (_c("unhealthy") > 0), "topic-url-unhealthy"),
        F.when(_c("lifecycle") == "needs-update", "needs-update"),
        F.when((_c("planned") < F.lit(today).cast("date")) & ~_c("lifecycle").isin("published", "needs-update"), "overdue"),
    ))
    return per.withColumn("codes", codes)
