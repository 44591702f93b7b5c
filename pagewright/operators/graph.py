"""Link graphs: ranks, components, hub areas, silos. Loops run on DataFrames and cut lineage in shared storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions import text
from pagewright.session import cut_lineage, release

# Weight of a link by the zone it stands in. Zones that are not listed count 1 and are reported.
ZONE_WEIGHTS = {"above_fold": 1.0, "below_fold": 0.75, "widget": 0.35, "nav_breadcrumb": 0.25, "sidebar_footer": 0.05}


@dataclass(frozen=True)
class RankRules:
    damping: float = 0.85
    tolerance: float = 1e-6
    max_iterations: int = 150
    held_back: float = 0.001
    part_edges: int = 1_000_000
    similarity_floor: float = 0.05
    under_linked_share: float = 0.5
    leak_share: float = 0.5


def _c(name: str) -> Column:
    return F.col(name)


def zone_edges(links: DataFrame) -> DataFrame:
    """One weighted edge per page pair: followed links summed by zone weight, unknown zones counted."""
    table = F.create_map(*[F.lit(x) for pair in ZONE_WEIGHTS.items() for x in pair])
    weight = F.try_element_at(table, _c("zone"))
    follow = ~F.array_contains(F.split(F.lower(F.coalesce("rel", F.lit(""))), r"\s+"), "nofollow")
    return links.where(follow & (_c("source") != _c("target"))).groupBy("site_id", "source", "target").agg(
        F.count("*").alias("links"), F.sum(F.coalesce(weight, F.lit(1.0))).alias("weight"), F.count_if(weight.isNull()).alias("unweighted_links")
    )


def context_similarity(links: DataFrame) -> DataFrame:
    """Overlap of the words around a link with the target's terms, over the root of both sizes; null when unknown.

    ``links(…, before, anchor, after, target_terms array)``.
    """
    words = F.array_distinct(text.words(F.concat_ws(" ", "before", "anchor", "after")))
    known = (_c("before").isNotNull() | _c("after").isNotNull()) & (F.size(words) > 0) & (F.size("target_terms") > 0)
    value = F.size(F.array_intersect(words, _c("target_terms"))) / F.sqrt(F.size(words).cast("double") * F.size("target_terms"))
    return links.withColumn("context_similarity", F.when(known, value))


def similarity_weights(edges: DataFrame, floor: float = 0.05) -> DataFrame:
    """Edge weights times page and context similarity, each only where known for every edge of the source."""
    known = edges.groupBy("site_id", "source").agg(
        (F.count("similarity") == F.count("*")).alias("_page"), (F.count("context_similarity") == F.count("*")).alias("_context")
    )
    factor = lambda gate, c: F.when(_c(gate), F.greatest(F.lit(floor), _c(c))).otherwise(1.0)
    return edges.join(known, ["site_id", "source"]).withColumn(
        "weight", _c("weight") * factor("_page", "similarity") * factor("_context", "context_similarity")
    ).drop("_page", "_context")


def page_rank(nodes: DataFrame, edges: DataFrame, rules: RankRules = RankRules(), start: DataFrame | None = None) -> DataFrame:
    """(site_id, node, rank, iterations, residual, converged): weighted link rank of every node, per site, summing to 1.

    Dangling mass and jumps are both spread evenly, so the rank is, up to its sum, the sum of an even share and of what
    followed links pass on of it, again and again. Only what arrived in the last round is passed on, and a page whose arrivals
    are below ``held_back`` of the limit keeps them until they add up: rounds get smaller as sites settle. The limit is the tolerance
    or a hundredth of an even share, whichever is less. A site has converged when all its pages hold less than the limit; the
    loop ends when no page sends, or after ``max_iterations``. With ``start``, ranks of an earlier graph, only differences to
    them are passed on.

    ``nodes(site_id, node)``, ``edges(site_id, source, target, weight)``. The edges of a source are cut into parts of bounded
    size, so a page that links everywhere is many tasks; what is passed on is summed by target before it moves.
    """
    known = nodes.select("site_id", "node").distinct()
    merged = edges.groupBy("site_id", "source", "target").agg(F.sum("weight").alias("weight"))
    totals = merged.groupBy("site_id", "source").agg(F.sum("weight").alias("total"), F.ceil(F.count("*") / rules.part_edges).cast("int").alias("parts"))
    sizes = known.groupBy("site_id").agg(F.count("*").alias("n"))
    limit = F.least(F.lit(rules.tolerance), 0.01 / _c("n"))
    table = cut_lineage(
        known.join(totals.select("site_id", _c("source").alias("node"), "parts"), ["site_id", "node"], "left").join(sizes, "site_id")
        .select("site_id", "node", F.coalesce("parts", F.lit(0)).alias("parts"), "n", limit.alias("bound"))
    )
    part = F.pmod(F.xxhash64("target"), _c("parts")).cast("int").alias("part")
    share = (rules.damping * _c("weight") / _c("total")).alias("share")
    into = table.select("site_id", _c("node").alias("target"), _c("parts").alias("next_parts"), "bound")
    flow = merged.join(totals, ["site_id", "source"]).select("site_id", _c("source").alias("node"), part, "target", share).join(into, ["site_id", "target"])
    flow = flow.repartition("site_id", "node", "part").persist()
    even = table.select("site_id", "node", "parts", "bound", (1.0 / _c("n")).alias("q"))
    if start is None:
        held, sent = cut_lineage(even), []
    else:
        # The sum of all passes on from a rank r is c r, if c = 1 + damping * c * (share of r on pages with links).
        given = table.join(start.select("site_id", "node", _c("rank").alias("given")), ["site_id", "node"], "left").withColumn("given", F.coalesce("given", 1.0 / _c("n")))
        linked = F.sum(F.when(_c("parts") > 0, _c("given")).otherwise(0.0)) / F.sum("given")
        scale = given.groupBy("site_id").agg((1 / (1 - rules.damping * linked) / F.sum("given")).alias("c"))
        first = cut_lineage(given.join(scale, "site_id").select("site_id", "node", "parts", "bound", (_c("given") * _c("c")).alias("q")))
        sent = [first.select("site_id", "node", "q")]
        away = first.withColumn("q", -_c("q"))
        held = cut_lineage(_gathered(_passed(first, flow).unionByName(away).unionByName(even)))
    done, least = 0, _c("bound") * rules.held_back
    while done < rules.max_iterations:
        moving = held.where(F.abs("q") > least)
        if moving.isEmpty():
            break
        done += 1
        sent.append(moving.select("site_id", "node", "q"))
        held = cut_lineage(_gathered(_passed(moving, flow).unionByName(held.where(F.abs("q") <= least))))
        if len(sent) > 12:
            sent = [cut_lineage(_summed(sent))]
    flow.unpersist()
    settled = held.groupBy("site_id").agg(F.max(F.abs("q")).alias("residual"), F.max(F.abs("q") > _c("bound")).alias("moving"))
    rank = cut_lineage(_summed([*sent, held.select("site_id", "node", "q")]))
    total = rank.groupBy("site_id").agg(F.sum("q").alias("s"))
    return known.join(rank, ["site_id", "node"]).join(total, "site_id").join(settled, "site_id", "left").select(
        "site_id", "node", (_c("q") / _c("s")).alias("rank"), F.lit(done).alias("iterations"), F.coalesce("residual", F.lit(0.0)).alias("residual"), (~F.coalesce("moving", F.lit(False))).alias("converged")
    )


def _passed(moving: DataFrame, flow: DataFrame) -> DataFrame:
    """What pages with links pass on to each target."""
    sources = moving.where("parts > 0").select("site_id", "node", "q", F.explode(F.sequence(F.lit(0), _c("parts") - 1)).alias("part"))
    return flow.join(sources, ["site_id", "node", "part"]).select("site_id", _c("target").alias("node"), _c("next_parts").alias("parts"), "bound", (_c("q") * _c("share")).alias("q"))


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site_id", "node").agg(F.max("parts").alias("parts"), F.max("bound").alias("bound"), F.sum("q").alias("q"))


def _summed(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("site_id", "node").agg(F.sum("q").alias("q"))


def link_rank_report(nodes: DataFrame, edges: DataFrame, rules: RankRules = RankRules(), start: DataFrame | None = None) -> DataFrame:
    """Rank on a 0-100 scale with degrees and the flags dead end, under-linked and leak."""
    usable = edges.where("source <> target")
    rank = page_rank(nodes, similarity_weights(usable, rules.similarity_floor), rules, start).select("site_id", "node", "rank")
    leaking = F.when(_c("similarity") < rules.similarity_floor, _c("weight")).otherwise(0.0)
    out = usable.groupBy("site_id", _c("source").alias("node")).agg(F.count("*").alias("out_degree"), F.sum("weight").alias("total"), F.sum(leaking).alias("leaking"))
    into = usable.groupBy("site_id", _c("target").alias("node")).agg(F.countDistinct("source").alias("in_degree"))
    top = rank.groupBy("site_id").agg(F.max("rank").alias("top"), F.count("*").alias("n"))
    rows = rank.join(top, "site_id").join(out, ["site_id", "node"], "left").join(into, ["site_id", "node"], "left")
    return rows.select(
        "site_id", "node", "rank", (F.floor(_c("rank") / _c("top") * 1000 + 0.5) / 10).alias("score"),
        F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
        _c("out_degree").isNull().alias("dead_end"), (_c("rank") < rules.under_linked_share / _c("n")).alias("under_linked"),
        F.coalesce(_c("leaking") / _c("total") >= rules.leak_share, F.lit(False)).alias("leak"),
    )


def rank_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scores of two reports on the first one's scale, with switched flags; null for added or removed nodes."""
    scale = before.groupBy("site_id").agg(F.max("rank").alias("top"))
    a = before.select("site_id", "node", _c("score").alias("before"), F.struct("dead_end", "under_linked", "leak").alias("f0"))
    b = after.join(scale, "site_id").select(
        "site_id", "node", (F.floor(_c("rank") / _c("top") * 1000 + 0.5) / 10).alias("after"), F.struct("dead_end", "under_linked", "leak").alias("f1")
    )
    switched = F.array_compact(F.array(*[
        F.when(_c(f"f0.{n}") != _c(f"f1.{n}"), F.concat(F.when(_c(f"f1.{n}"), F.lit("+")).otherwise("-"), F.lit(n))) for n in ("dead_end", "under_linked", "leak")
    ]))
    return a.join(b, ["site_id", "node"], "full_outer").select(
        "site_id", "node", "before", "after", F.round(_c("after") - _c("before"), 1).alias("delta"), switched.alias("flag_changes")
    )


def components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node id of each connected group.

    Large-star and small-star rounds: every node only learns its smallest neighbour, an aggregate that shrinks before
    the shuffle, so a hub of any size is never gathered in one task. Ends when a round changes nothing; raises where
    ``max_rounds`` don't settle it, which no graph that fits a cluster needs.
    """
    edges = pairs.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    mark = _fingerprint(edges)
    for _ in range(max_rounds):
        last, edges = edges, cut_lineage(_small_star(_large_star(edges)))
        release(last)
        now = _fingerprint(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(_c("u").alias("node"), _c("v").alias("component"))
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(_c("v").alias("u"), _c("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), _c("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(_c("v").alias("u"), _c("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(_c("v").alias("u"), _c("m").alias("v"))
    return moved.unionByName(least.select("u", _c("m").alias("v"))).where("u <> v").distinct()


def alternate_clusters(pages: DataFrame, alternates: DataFrame) -> DataFrame:
    """Language clusters by component, with their issue rows per page; ``alternates(source, language, target, reciprocal)``."""
    own = pages.select(_c("url").alias("node"))
    inside = alternates.join(own.withColumnRenamed("node", "target"), "target", "left_semi").select(_c("source").alias("a"), _c("target").alias("b"))
    groups = components(own, inside)
    per = alternates.groupBy(_c("source").alias("node")).agg(
        F.max(F.lower("language") == "x-default").alias("has_default"), F.max(_c("source") == _c("target")).alias("has_self"),
        F.count_if(~text.valid_hreflang(_c("language"))).alias("invalid_codes"), F.count_if(~_c("reciprocal")).alias("not_answered"), F.count_if(_c("reciprocal").isNull()).alias("not_crawled"),
    )
    yes = lambda c: F.coalesce(_c(c), F.lit(False))
    n = lambda c: F.coalesce(_c(c), F.lit(0))
    codes = F.array_compact(F.array(
        F.when(~yes("has_default"), "missing-x-default"), F.when(~yes("has_self"), "missing-self"), F.when(n("invalid_codes") > 0, "invalid-code"),
        F.when(n("not_answered") > 0, "missing-reciprocal"), F.when(n("not_crawled") > 0, "target-not-crawled"),
    ))
    return groups.join(per, "node", "left").select("node", "component", codes.alias("codes"))


def hub_areas(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Content documents with their hub: fewest members, then deepest path, then smallest id.

    ``documents(doc, role, section, depth)``, ``links(source, target)`` between documents.
    """
    hub = documents.where("role = 'hub'").select(_c("doc").alias("source"), _c("section").alias("hub_section"), _c("depth").alias("hub_depth"))
    content = documents.where("role = 'content'").select(_c("doc").alias("target"), "section")
    member = links.select("source", "target").distinct().join(hub, "source").join(content, "target").where("section = hub_section")
    size = member.groupBy("source").agg(F.count("*").alias("members"))
    choice = member.join(size, "source").groupBy("target").agg(F.min_by("source", F.struct("members", (-_c("hub_depth")).alias("d"), "source")).alias("hub"))
    return content.join(choice, "target", "left").select(_c("target").alias("doc"), "section", "hub")


def hub_verdicts(areas: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """Members without a link back, documents of a member topic the hub does not list, and healthy areas.

    ``topics(doc, topic)``.
    """
    edges = links.select("source", "target").distinct()
    member = areas.where("hub IS NOT NULL").select("hub", "doc")
    no_back = member.join(edges.select(_c("source").alias("doc"), _c("target").alias("hub")), ["doc", "hub"], "left_anti")
    sections = areas.where("hub IS NOT NULL").select("hub", "section").distinct()
    tagged = areas.select("doc", "section").join(topics, "doc").distinct()
    # What a hub lists of a topic goes with the hub's demand for it, so only pairs that are missing come out, and none is shuffled.
    listed = edges.select(_c("source").alias("hub"), _c("target").alias("doc")).join(sections, "hub").join(tagged, ["doc", "section"])
    listed = listed.groupBy("hub", "topic", "section").agg(F.collect_set("doc").alias("listed"))
    wanted = member.join(topics, "doc").join(sections, "hub").select("hub", "topic", "section").distinct().join(listed, ["hub", "topic", "section"], "left")
    size = tagged.groupBy("topic", "section").agg(F.count("*").alias("n"))
    lacking = wanted.join(size, ["topic", "section"]).where(F.coalesce(F.size("listed"), F.lit(0)) < _c("n"))
    topics_of = tagged.groupBy("doc").agg(F.countDistinct("topic").alias("topics"), F.countDistinct("section").alias("sections"))
    near = lacking.select("hub", "topic", "section", F.coalesce("listed", F.array().cast(listed.schema["listed"].dataType)).alias("listed"))
    met = near.join(tagged.join(topics_of, "doc"), ["topic", "section"]).where(~F.array_contains("listed", _c("doc")))
    # Only a document of several topics or sections can be missed twice by a hub.
    once = (_c("topics") <= 1) & (_c("sections") <= 1)
    unlisted = met.where(once).select("hub", "doc").unionByName(met.where(~once).select("hub", "doc").distinct())
    bad = no_back.select("hub").union(lacking.select("hub")).distinct()
    healthy = member.select("hub").distinct().join(bad, "hub", "left_anti")
    return (
        no_back.select("hub", "doc", F.lit("hub-missing-backlink").alias("code"))
        .unionByName(unlisted.select("hub", "doc", F.lit("hub-missing-member-link").alias("code")))
        .unionByName(healthy.select("hub", F.lit(None).cast(member.schema["doc"].dataType).alias("doc"), F.lit("area-healthy").alias("code")))
    )


def document_verdicts(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Content documents nobody links to, and those linked by hubs only."""
    edges = links.where("source <> target").select("source", "target").distinct()
    role = documents.select(_c("doc").alias("source"), _c("role").alias("source_role"))
    into = edges.join(role, "source").groupBy(_c("target").alias("doc")).agg(F.bool_and(_c("source_role") == "hub").alias("hubs_only"))
    rows = documents.where("role = 'content'").join(into, "doc", "left")
    return rows.select("doc", F.when(_c("hubs_only").isNull(), "orphan").when(_c("hubs_only"), "isolated").alias("code")).where("code IS NOT NULL")


def topic_verdicts(topics: DataFrame, links: DataFrame, areas: DataFrame) -> DataFrame:
    """Per topic: no pillar although spread over areas, member pairs without a link, thin topics.

    Linked pairs are counted from the links and taken from the number of possible pairs; member pairs are never listed.
    """
    size = topics.groupBy("topic").agg(F.count("*").alias("members"))
    a = topics.select(_c("doc").alias("source"), _c("topic").alias("topic"))
    b = topics.select(_c("doc").alias("target"), _c("topic").alias("topic_to"))
    inside = links.where("source <> target").select("source", "target").distinct().join(a, "source").join(b, "target").where("topic = topic_to")
    linked = inside.select("topic", F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).distinct().groupBy("topic").agg(F.count("*").alias("linked_pairs"))
    reach = inside.groupBy("topic", "source").agg(F.count("*").alias("reach")).groupBy("topic").agg(F.max("reach").alias("widest"))
    spread = topics.join(areas.select("doc", "hub"), "doc", "left").groupBy("topic").agg(F.countDistinct("hub").alias("areas"), F.count_if(_c("hub").isNull()).alias("without_hub"))
    rows = size.join(linked, "topic", "left").join(reach, "topic", "left").join(spread, "topic").fillna(0, ["linked_pairs", "widest"])
    pillar = _c("widest") >= _c("members") - 1
    unlinked = _c("members") * (_c("members") - 1) / 2 - _c("linked_pairs")
    codes = F.array_compact(F.array(
        F.when(((_c("areas") >= 2) | (_c("without_hub") > 0)) & ~pillar, "topic-no-hub"), F.when(unlinked > 0, "topic-members-unlinked"), F.when(_c("members") == 2, "topic-thin"),
    ))
    return rows.select("topic", "members", unlinked.cast("long").alias("unlinked_pairs"), codes.alias("codes"))


def silo_audit(members: DataFrame, links: DataFrame) -> DataFrame:
    """Link cohesion of each group around its pillar: to pillar, from pillar, to siblings.

    ``members(group, page, relevance)``; the pillar has most inbound links, then relevance, then the smallest name.
    """
    edges = links.where("source <> target").select("source", "target").distinct()
    inbound = edges.groupBy(_c("target").alias("page")).agg(F.count("*").alias("inbound"))
    rows = members.join(inbound, "page", "left").fillna(0, ["inbound"])
    pillar = rows.groupBy("group").agg(F.min_by("page", F.struct((-_c("inbound")).alias("a"), (-_c("relevance")).alias("b"), "page")).alias("pillar"), (F.count("*") - 1).alias("satellites"))
    sat = rows.join(pillar, "group").where("page <> pillar").select("group", "page", "pillar", "satellites")
    to_p = edges.select(_c("source").alias("page"), _c("target").alias("pillar"), F.lit(1.0).alias("to_pillar"))
    from_p = edges.select(_c("source").alias("pillar"), _c("target").alias("page"), F.lit(1.0).alias("from_pillar"))
    peers = (
        edges.join(sat.select("group", _c("page").alias("source")), "source").join(sat.select(_c("group").alias("g2"), _c("page").alias("target")), "target")
        .where("group = g2").groupBy("group", _c("source").alias("page")).agg(F.count("*").alias("peers"))
    )
    scored = sat.join(to_p, ["page", "pillar"], "left").join(from_p, ["pillar", "page"], "left").join(peers, ["group", "page"], "left").fillna(0, ["to_pillar", "from_pillar", "peers"])
    siblings = F.when(_c("satellites") > 1, F.least(F.lit(1.0), _c("peers") / F.least(F.lit(2), _c("satellites") - 1)))
    weights = ((_c("to_pillar"), 0.5), (_c("from_pillar"), 0.3), (siblings, 0.2))
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in weights), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in weights), F.lit(0.0)) / total
    return scored.groupBy("group", "pillar").agg(F.avg(value).alias("connectivity"), F.count("*").alias("satellites"))


def silo_score(connectivity: Column, anchors: Column, orphan_share: Column, bleed_share: Column) -> Column:
    """0-100 of .45 connectivity, .35 anchor fit and .20 of what is neither orphaned nor bleeding; unknown parts left out."""
    from pagewright.functions.numbers import weighted_mean

    rest = 1 - F.least(F.lit(1.0), orphan_share + bleed_share)
    return F.floor(weighted_mean([(connectivity, 0.45), (anchors, 0.35), (rest, 0.20)]) * 1000 + 0.5) / 10


def anchor_fit(anchor_keys: Column, target_keys: Column, generic: float = 0.2, full: float = 0.3) -> Column:
    """How well an anchor names its target, between the weight of an empty anchor and 1."""
    shared = F.size(F.array_intersect(anchor_keys, target_keys))
    cos = shared / F.sqrt(F.size(anchor_keys).cast("double") * F.size(target_keys))
    usable = (F.size(anchor_keys) > 0) & (F.size(target_keys) > 0)
    return F.when(usable, F.greatest(F.lit(generic), F.least(F.lit(1.0), cos / full))).otherwise(generic)


def funnel_transitions(stages: DataFrame, links: DataFrame) -> DataFrame:
    """Links between funnel stages of classified pages; ``stages(page, stage)``."""
    a, b = stages.select(_c("page").alias("source"), _c("stage").alias("from_stage")), stages.select(_c("page").alias("target"), _c("stage").alias("to_stage"))
    return links.join(a, "source").join(b, "target").groupBy("from_stage", "to_stage").agg(F.count("*").alias("links"))


def missing_transitions(transitions: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Wanted steps without any link."""
    seen = F.array(*[F.struct(F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage")) for a, b in wanted])
    found = transitions.agg(F.collect_set(F.struct("from_stage", "to_stage")).alias("f"))
    return found.select(F.explode(F.array_except(seen, "f")).alias("s")).select("s.*")


def page_islands(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """Connected parts among the structured-data nodes of each page; ``nodes(page, id)``, ``references(page, a, b)``."""
    name = lambda c: F.concat_ws("\x1f", "page", c)
    own = nodes.select(name("id").alias("node"))
    pairs = references.select(name("a").alias("a"), name("b").alias("b"))
    inside = pairs.join(own.select(_c("node").alias("a")), "a", "left_semi").join(own.select(_c("node").alias("b")), "b", "left_semi")
    parts = components(own, inside)
    return parts.groupBy(F.split_part("node", F.lit("\x1f"), F.lit(1)).alias("page")).agg(F.countDistinct("component").alias("islands"), F.count("*").alias("nodes"))


def entity_evidence(facts: DataFrame, page_terms: DataFrame, min_share: float = 0.25) -> DataFrame:
    """Declared facts and the pages whose terms cover at least a quarter of their words.

    ``facts(fact, text, lang)``, ``page_terms(page, term)``; pages meet facts by shared words only.
    """
    keys = facts.select("fact", F.array_distinct(text.content_keys(_c("text"), _c("lang"))).alias("k")).where(F.size("k") > 0)
    each = keys.select("fact", F.size("k").alias("words"), F.explode("k").alias("term"))
    hit = each.join(page_terms.select("page", "term").distinct(), "term").groupBy("fact", "page", "words").agg(F.count("*").alias("found"))
    return hit.withColumn("share", _c("found") / _c("words")).where(_c("share") >= min_share).select("fact", "page", "share", (_c("share") == 1).alias("observed"))
