"""Term statistics, topical focus and page relevance per site."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from pagewright.functions import status, text, urls
from pagewright.operators import shapes, termblocks
from pagewright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ZONE_WEIGHT = {"title": 2.5, "h1": 2.5, "h2": 1.5, "body": 1.0}
SEMANTIC = {"similarity": 0.5, "overlap": 0.3, "drift": 0.2}
LEXICAL = {"overlap": 0.75, "drift": 0.25}
SCALE, OVERLAP_SATURATION = 125, 12


def _c(name: str) -> Column:
    return F.col(name)


# Terms and vectors come as rows (site, page, term, tf[, weight]) or packed in blocks (termblocks), which hold the same rows.

def _over(blocks: DataFrame, ddl: str, made, *more: str) -> DataFrame:
    """Rows of each block; a column named ``page`` has the type of the pages."""
    fields = [StructField("page", blocks.schema["page"].dataType) if f.name == "page" else f for f in StructType.fromDDL(ddl).fields]
    return termblocks.over(blocks, "site", StructType(fields), made, *more)


def _spelled(b: termblocks.Pages) -> pa.Array:
    return b.terms.column("term").combine_chunks()


def site_terms(vectors: DataFrame) -> DataFrame:
    """(site, term), each once."""
    if not termblocks.packed(vectors):
        return vectors.select("site", "term").distinct()
    return _over(vectors, "term string", lambda b: [{"term": _spelled(b)}]).distinct()


def site_pages(vectors: DataFrame) -> DataFrame:
    """(site, page), each once."""
    if not termblocks.packed(vectors):
        return vectors.select("site", "page").distinct()
    return _over(vectors, "page long", lambda b: [{"page": b.pages}])


def page_masses(vectors: DataFrame) -> DataFrame:
    """(site, page, terms, mass, top): number, sum and maximum of the weights of a page."""
    if not termblocks.packed(vectors):
        return vectors.groupBy("site", "page").agg(F.count("*").alias("terms"), F.sum("weight").alias("mass"), F.max("weight").alias("top"))

    def made(b: termblocks.Pages) -> list[dict]:
        weight, top = b.weight(), np.zeros(len(b.pages))
        np.maximum.at(top, b.of, weight)
        return [{"page": b.pages, "terms": np.bincount(b.of, minlength=len(b.pages)), "mass": b.summed(weight), "top": top}]

    return _over(vectors, "page long, terms long, mass double, top double", made)


def zone_ngrams(pages: DataFrame, zones: dict[str, str], longest: int = 2, stopwords: tuple[str, ...] = text.STOPWORDS, drop_once: bool = False) -> DataFrame:
    """(page, key, tf, count): word runs of each zone, weighted by zone; ``zones`` maps a column to a zone name.

    Runs are built inside the row; only distinct runs of a page are merged. ``drop_once`` leaves out runs of several
    words that occur a single time with body weight.
    """
    def runs(column: str, zone: str) -> Column:
        weight = F.lit(ZONE_WEIGHT[zone])

        def of(bound: Column, n: int) -> Column:
            # Null where a word of the run is noise or lies behind the end.
            run = lambda x, i: F.concat(x, *[part for k in range(1, n) for part in (F.lit(" "), F.get(bound, i + k))])
            return F.transform(F.filter(F.transform(bound, run), lambda r: r.isNotNull()), lambda r: F.struct(r.alias("key"), weight.alias("w")))

        # The keys are bound once; every run only picks them.
        return urls.let(text.word_keys(F.coalesce(_c(column), F.lit("")), _c("lang"), stopwords), lambda bound: F.concat(*[of(bound, n) for n in range(1, longest + 1)]))

    # Whole texts meet by page, so that their many more runs need not move.
    given = pages.select("page", "lang", *zones).repartition("page")
    rows = given.select("page", F.explode(F.concat(*[runs(c, z) for c, z in zones.items()])).alias("x"))
    out = rows.groupBy("page", _c("x.key").alias("key")).agg(F.sum("x.w").alias("tf"), F.count("*").alias("count"))
    return out.where(~(_c("key").contains(" ") & (_c("count") == 1) & (_c("tf") <= 1))) if drop_once else out


def focus_terms(ngrams: DataFrame, limit: int = 120) -> DataFrame:
    return shapes.top_k(ngrams, ["page"], limit, F.desc("tf"), _c("key"))


def term_stats(terms: DataFrame, brand: tuple[str, ...] = (), ceiling: float = 0.25, from_pages: int = 10) -> DataFrame:
    """(site, term, df, n, idf, sitewide): ln(1 + N/df); own brand words out; very common terms marked."""
    if termblocks.packed(terms):
        def made(b: termblocks.Pages) -> list[dict]:
            cells = b.cells if len(b.pages) == len(b.size) else np.unique(b.of * b.k + b.cells) % b.k  # a term once a page
            if b.pages.null_count:  # a page without a number isn't counted for a term
                gone = np.flatnonzero(b.pages.is_null().to_numpy(zero_copy_only=False))
                cells = np.unique((b.of * b.k + b.cells)[~np.isin(b.of, gone)]) % b.k
            return [{"term": _spelled(b), "df": np.bincount(cells, minlength=b.k)}]

        counted = _over(terms, "term string, df long", made)
        df = (counted if not brand else counted.where(~_c("term").isin(*brand))).groupBy("site", "term").agg(F.sum("df").alias("df"))
        sizes = terms.groupBy("site").agg(F.sum("pages").alias("n"))
    else:
        rows = terms if not brand else terms.where(~_c("term").isin(*brand))
        df = rows.groupBy("site", "term").agg(F.countDistinct("page").alias("df"))
        sizes = terms.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("n"))
    return df.join(sizes, "site").select(
        "site", "term", "df", "n", F.log(1 + _c("n") / _c("df")).alias("idf"), ((_c("n") >= from_pages) & (_c("df") / _c("n") > ceiling)).alias("sitewide")
    )


def tfidf(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(site, page, term, tf, weight): (1 + ln tf) times idf; packed terms get the idf beside each term of a block."""
    if termblocks.packed(terms):
        return termblocks.looked_up(terms, "site", stats, ["idf"])
    return terms.join(stats.select("site", "term", "idf"), ["site", "term"]).select(
        "site", "page", "term", "tf", ((1 + F.log(F.greatest(F.lit(1.0), _c("tf").cast("double")))) * _c("idf")).alias("weight")
    )


def term_inventory(terms: DataFrame, stats: DataFrame, per_page: int = 40, max_share: float = 0.5) -> DataFrame:
    """Most frequent terms of each page with whether they can tell pages apart."""
    top = shapes.top_k(terms, ["site", "page"], per_page, F.desc("tf"), _c("term"))
    topical = (_c("n") < 10) | (_c("df") / _c("n") <= max_share)
    return top.join(stats, ["site", "term"]).select("site", "page", "term", "rank", topical.alias("topical"))


def site_weights(vectors: DataFrame) -> DataFrame:
    if termblocks.packed(vectors):
        vectors = _over(vectors, "term string, weight double", lambda b: [{"term": _spelled(b), "weight": np.bincount(b.cells, b.weight(), b.k)}])
    return vectors.groupBy("site", "term").agg(F.sum("weight").alias("weight"))


def top_terms(totals: DataFrame, limit: int = 500) -> DataFrame:
    return shapes.top_k(totals, ["site"], limit, F.desc(F.round("weight", 9)), _c("term"))


def cooccurrence(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cosine of the chosen terms over pages. Chosen terms are few per site, so a page pairs at most that many.

    In a block of packed pages the chosen terms are multiplied as a matrix, and only its sums move.
    """
    if termblocks.packed(vectors):
        return _packed_cooccurrence(vectors, chosen)
    v = vectors.join(chosen.select("site", "term"), ["site", "term"], "left_semi")
    norm = v.groupBy("site", "term").agg(F.sqrt(F.sum(_c("weight") * _c("weight"))).alias("norm"))
    per = v.groupBy("site", "page").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"))
    left = per.select("site", F.posexplode("t").alias("i", "a"), "t").select("site", "a", F.explode(F.slice("t", _c("i") + 2, F.size("t"))).alias("b"))
    dots = left.groupBy("site", _c("a.term").alias("left"), _c("b.term").alias("right")).agg(F.sum(_c("a.weight") * _c("b.weight")).alias("dot"))
    n = lambda side: norm.select("site", _c("term").alias(side), _c("norm").alias(f"n_{side}"))
    return dots.join(n("left"), ["site", "left"]).join(n("right"), ["site", "right"]).select("site", "left", "right", (_c("dot") / (_c("n_left") * _c("n_right"))).alias("similarity"))


def _packed_cooccurrence(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    few = cut_lineage(chosen.select("site", "term").distinct().groupBy("site").agg(F.array_sort(F.collect_list("term")).alias("chosen")))

    def made(b: termblocks.Pages, terms: list[str]) -> list[dict]:
        column = pc.index_in(_spelled(b), value_set=pa.array(terms, pa.string())).fill_null(-1).to_numpy()
        used = np.unique(column[column >= 0])
        if not len(used):
            return []
        place = np.full(b.k, -1)
        place[column >= 0] = np.searchsorted(used, column[column >= 0])
        at = place[b.cells]
        own, page, weight = at[at >= 0], b.of[at >= 0], b.weight()[at >= 0]
        dot, met = np.zeros((len(used), len(used))), np.zeros((len(used), len(used)), bool)
        step = max(1, (1 << 22) // len(used))
        for lo in range(0, len(b.pages), step):
            here = (page >= lo) & (page < lo + step)
            cell = (page[here] - lo) * len(used) + own[here]
            w = np.bincount(cell, weight[here], step * len(used)).reshape(step, len(used))
            dot += w.T @ w
            met |= (w > 0).astype(np.float32).T @ (w > 0).astype(np.float32) > 0
        square = np.bincount(own, weight * weight, len(used))
        # A term pairs with itself only on a page that has it in two languages.
        twice = np.unique(own[np.isin(page * len(used) + own, *_repeated(page * len(used) + own))])
        i, j = np.nonzero(np.triu(met, 1))
        name = pa.array(terms, pa.string()).take(pa.array(used))
        n = np.arange(len(used))
        itself = pa.array((dot[n, n] - square) / 2, mask=~np.isin(n, twice))
        pairs = {"left": name.take(pa.array(i)), "right": name.take(pa.array(j)), "dot": dot[i, j], "sq": np.zeros(len(i))}
        return [pairs, {"left": name, "right": name, "dot": itself, "sq": square}]

    parts = _over(vectors.join(few, "site"), "left string, right string, dot double, sq double", made, "chosen")
    sums = cut_lineage(parts.groupBy("site", "left", "right").agg(F.sum("dot").alias("dot"), F.sum("sq").alias("sq")))
    norm = lambda side: sums.where(_c("left") == _c("right")).select("site", _c("left").alias(side), F.sqrt("sq").alias(f"n_{side}"))
    rows = sums.where("dot IS NOT NULL").select("site", "left", "right", "dot").join(norm("left"), ["site", "left"]).join(norm("right"), ["site", "right"])
    return rows.select("site", "left", "right", (_c("dot") / (_c("n_left") * _c("n_right"))).alias("similarity"))


def _repeated(values: np.ndarray) -> tuple[np.ndarray]:
    found, n = np.unique(values, return_counts=True)
    return (found[n > 1],)


def anchor_mass(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Term mass of named pages, each page summing to 1."""
    if termblocks.packed(vectors):
        few = cut_lineage(anchors.where(_c("page").isNotNull()).groupBy("site").agg(F.collect_set("page").alias("anchors")))
        page = vectors.schema["page"].dataType

        def made(b: termblocks.Pages, wanted: list) -> list[dict]:
            from pyspark.sql.pandas.types import to_arrow_type

            inside = pc.is_in(b.pages, value_set=pa.array(wanted, to_arrow_type(page))).to_numpy(zero_copy_only=False)[b.of]
            if not inside.any():
                return []
            weight = b.weight()
            share = weight / b.summed(weight)[b.of]
            held = np.unique(b.cells[inside])
            return [{"term": _spelled(b).take(pa.array(held)), "mass": np.bincount(b.cells[inside], share[inside], b.k)[held]}]

        return _over(vectors.join(few, "site"), "term string, mass double", made, "anchors").groupBy("site", "term").agg(F.sum("mass").alias("mass"))
    own = vectors.join(anchors.select("site", "page").distinct(), ["site", "page"], "left_semi")
    total = own.groupBy("site", "page").agg(F.sum("weight").alias("total"))
    return own.join(total, ["site", "page"]).groupBy("site", "term").agg(F.sum(_c("weight") / _c("total")).alias("mass"))


def core_terms(clusters: DataFrame, totals: DataFrame, wanted: DataFrame | None = None, size: int = 40) -> DataFrame:
    """Core cluster per site and its heaviest terms, with the core's share of all weight.

    A cluster that shares a wanted term wins, by the number shared; else the heaviest. ``clusters(site, cluster, term)``.
    """
    rows = cut_lineage(clusters.join(totals, ["site", "term"]))  # read three times
    if wanted is not None:
        rows = rows.join(wanted.select("site", "term").distinct().withColumn("w", F.lit(1)), ["site", "term"], "left")
    else:
        rows = rows.withColumn("w", F.lit(None).cast("int"))
    per = rows.groupBy("site", "cluster").agg(F.sum("weight").alias("mass"), F.count("w").alias("named"))
    best = per.groupBy("site").agg(F.min_by("cluster", F.struct((-_c("named")).alias("a"), (-F.round("mass", 9)).alias("b"), "cluster")).alias("cluster"), F.sum("mass").alias("all"))
    core = rows.join(best, ["site", "cluster"]).join(per.select("site", "cluster", "mass"), ["site", "cluster"])
    return shapes.top_k(core.select("site", "cluster", "term", "weight", (_c("mass") / _c("all")).alias("confidence")), ["site"], size, F.desc(F.round("weight", 9)), _c("term"))


def page_relevance(vectors: DataFrame, clusters: DataFrame, core: DataFrame, mode: str = "semantic") -> DataFrame:
    """0-100 relevance of each page to the core: similarity, core overlap and drift into other clusters.

    A foreign word next to a core word in a two-word term of the page does not count as drift.
    """
    core_cluster = core.select("site", _c("cluster").alias("core")).distinct()
    size = core.groupBy("site").agg(F.count("*").alias("k"), F.sum(_c("weight") * _c("weight")).alias("core_sq"))
    if termblocks.packed(vectors):
        return _relevance(_packed_relevance(vectors, clusters, core).join(size, "site"), mode)
    rows = vectors.join(clusters, ["site", "term"]).join(core_cluster, "site")
    bigram = vectors.where(F.size(F.split("term", " ")) == 2).select("site", "page", F.split("term", " ").alias("p"))
    near = bigram.select("site", "page", F.explode(F.array(F.struct(F.get("p", F.lit(0)).alias("term"), F.get("p", F.lit(1)).alias("other")), F.struct(F.get("p", F.lit(1)).alias("term"), F.get("p", F.lit(0)).alias("other")))).alias("x")).select("site", "page", "x.term", "x.other")
    in_core = clusters.join(core_cluster, "site").where("cluster = core").select("site", _c("term").alias("other"))
    guarded = near.join(in_core, ["site", "other"], "left_semi").select("site", "page", "term").distinct().withColumn("guarded", F.lit(True))
    weight_of = core.select("site", "term", _c("weight").alias("core_weight"))
    joined = rows.join(guarded, ["site", "page", "term"], "left").join(weight_of, ["site", "term"], "left").withColumn("foreign", (_c("cluster") != _c("core")) & _c("guarded").isNull())
    per = joined.groupBy("site", "page").agg(
        F.sum("weight").alias("total"), F.sum(F.when(_c("foreign"), _c("weight")).otherwise(0.0)).alias("foreign_weight"), F.sum("tf").alias("tf"),
        F.sum(F.when(_c("foreign"), _c("tf")).otherwise(0)).alias("foreign_tf"), F.sum(_c("weight") * _c("weight")).alias("sq"), F.sum(_c("weight") * F.coalesce("core_weight", F.lit(0.0))).alias("dot"), F.count("core_weight").alias("present"),
    ).join(size, "site")
    return _relevance(per, mode)


def _packed_relevance(vectors: DataFrame, clusters: DataFrame, core: DataFrame) -> DataFrame:
    """The sums of each page; a term is in one cluster of its site."""
    core_cluster = core.select("site", _c("cluster").alias("core")).distinct()
    placed = clusters.join(core_cluster, "site").withColumn("foreign", _c("cluster") != _c("core"))
    inner = placed.where("cluster = core").select("site", _c("term").alias("part"))
    both = placed.where(F.size(F.split("term", " ")) == 2).select("site", "term", *[F.get(F.split("term", " "), F.lit(i)).alias(f"p{i}") for i in (0, 1)])
    for i in (0, 1):
        both = both.join(inner.select("site", _c("part").alias(f"p{i}"), F.lit(True).alias(f"c{i}")).distinct(), ["site", f"p{i}"], "left")
    known = placed.select("site", "term", "foreign").join(core.select("site", "term", _c("weight").alias("core_weight")), ["site", "term"], "left")
    known = known.join(both.select("site", "term", F.coalesce("c0", F.lit(False)).alias("c0"), F.coalesce("c1", F.lit(False)).alias("c1")), ["site", "term"], "left").fillna(False, ["c0", "c1"])

    def made(b: termblocks.Pages) -> list[dict]:
        weight, spelled = b.weight(), _spelled(b)
        foreign = b.known("foreign").astype(bool)[b.cells]
        guards = []
        for at, (ours, theirs) in enumerate(((1, 0), (0, 1))):  # the other word is in the core
            has = np.flatnonzero(b.known(f"c{ours}").astype(bool))
            if len(has):
                part = pa.array([t.split(" ")[theirs] for t in spelled.take(pa.array(has)).to_pylist()], pa.string())
                to = np.full(b.k, -1)
                to[has] = pc.index_in(part, value_set=spelled).fill_null(-1).to_numpy()
                cell = to[b.cells]
                guards.append((b.of * b.k + cell)[cell >= 0])
        if guards:
            foreign &= ~np.isin(b.of * b.k + b.cells, np.concatenate(guards))
        heavy = b.known("core_weight").astype(float)[b.cells]
        present = ~np.isnan(heavy)
        return [{
            "page": b.pages, "total": b.summed(weight), "foreign_weight": b.summed(weight * foreign), "tf": b.summed(b.tf).astype(np.int64), "foreign_tf": b.summed(b.tf * foreign).astype(np.int64),
            "sq": b.summed(weight * weight), "dot": b.summed(np.where(present, weight * np.nan_to_num(heavy), 0.0)), "present": b.summed(present).astype(np.int64),
        }]

    given = termblocks.looked_up(vectors, "site", cut_lineage(known), ["foreign", "core_weight", "c0", "c1"])
    return _over(given, "page long, total double, foreign_weight double, tf long, foreign_tf long, sq double, dot double, present long", made)


def _relevance(per: DataFrame, mode: str) -> DataFrame:
    similarity = F.coalesce(F.try_divide(_c("dot"), F.sqrt(_c("sq") * _c("core_sq"))), F.lit(0.0))
    overlap = F.least(F.lit(1.0), _c("present") / F.least(F.greatest(_c("k"), F.lit(1)), F.lit(OVERLAP_SATURATION)))
    drift = F.coalesce(F.try_divide(_c("foreign_weight"), _c("total")), F.lit(0.0))
    lexical = F.coalesce(F.try_divide(_c("foreign_tf").cast("double"), _c("tf")), F.lit(0.0))
    raw = (
        SEMANTIC["similarity"] * similarity + SEMANTIC["overlap"] * overlap - SEMANTIC["drift"] * drift
        if mode != "lexical" else LEXICAL["overlap"] * overlap - LEXICAL["drift"] * lexical
    )
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * SCALE)) * 10 + 0.5) / 10
    return per.select("site", "page", score.alias("score"), similarity.alias("similarity"), overlap.alias("overlap"), drift.alias("drift"))


def alignment_rows(vectors: DataFrame, clusters: DataFrame, core: DataFrame, limit: int = 20) -> DataFrame:
    """Heaviest terms of each page with core or foreign class and their cluster's share of the page."""
    core_cluster = core.select("site", _c("cluster").alias("core")).distinct()
    if termblocks.packed(vectors):
        top = _packed_alignment(termblocks.looked_up(vectors, "site", clusters, ["cluster"]), clusters.schema["cluster"], limit)
        return top.join(core_cluster, "site").select("site", "page", "term", "rank", (_c("cluster") == _c("core")).alias("is_core"), "cluster_share")
    rows = vectors.join(clusters, ["site", "term"])
    mass = rows.groupBy("site", "page", "cluster").agg(F.sum("weight").alias("mass"))
    total = mass.groupBy("site", "page").agg(F.sum("mass").alias("all"))
    share = mass.join(total, ["site", "page"]).select("site", "page", "cluster", (_c("mass") / _c("all")).alias("cluster_share"))
    top = shapes.top_k(rows, ["site", "page"], limit, F.desc(F.round("weight", 9)), _c("term"))
    # Only what is listed meets its site's core.
    return top.join(share, ["site", "page", "cluster"]).join(core_cluster, "site").select("site", "page", "term", "rank", (_c("cluster") == _c("core")).alias("is_core"), "cluster_share")


def _packed_alignment(vectors: DataFrame, cluster: StructField, limit: int) -> DataFrame:
    """(page, term, rank, cluster, cluster_share) of the heaviest terms of each page."""
    def made(b: termblocks.Pages) -> list[dict]:
        weight, spelled = b.weight(), _spelled(b)
        coded = b.terms.column("cluster").combine_chunks().dictionary_encode(null_encoding="encode")
        own, m = coded.indices.to_numpy().astype(np.int64)[b.cells], len(coded.dictionary)
        place = np.empty(b.k, np.int64)
        place[pc.sort_indices(spelled).to_numpy()] = np.arange(b.k)
        order = np.lexsort((place[b.cells], -np.floor(weight * 1e9 + 0.5), b.of))
        page = b.of[order]
        n = np.bincount(page, minlength=len(b.pages))
        rank = np.arange(len(page)) - np.repeat(np.cumsum(n) - n, n) + 1
        order, rank = order[rank <= limit], rank[rank <= limit]
        pair, back = np.unique(b.of * m + own, return_inverse=True)
        mass = np.bincount(back, weight)
        share = mass / np.bincount(pair // m, mass, len(b.pages))[pair // m]
        return [{"page": b.pages.take(pa.array(b.of[order])), "term": spelled.take(pa.array(b.cells[order])), "rank": rank.astype(np.int32), "cluster": coded.dictionary.take(pa.array(own[order])), "cluster_share": share[back[order]]}]

    kind = StructType([StructField("page", vectors.schema["page"].dataType), *StructType.fromDDL("term string, rank int").fields, cluster, *StructType.fromDDL("cluster_share double").fields])
    return termblocks.over(vectors, "site", kind, made)


def focus_score(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Type-weighted mean relevance and the share of on-topic pages; ``(…, score, page_type)``."""
    w = status.type_weight(_c("page_type"))
    on_topic = F.when(_c("page_type") != "technical", (_c("score") >= 60).cast("double"))
    return pages.groupBy(*keys).agg(
        (F.sum(w * _c("score")) / F.sum(w)).alias("focus"), F.avg(on_topic).alias("on_topic_ratio"), F.count("*").alias("pages")
    )


def segment_scores(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """Focus of each listed segment; a segment without pages is unavailable."""
    scored = focus_score(pages.where("segment IS NOT NULL"), ["segment"])
    return segments.join(scored, "segment", "left").withColumn("state", F.when(_c("pages").isNull(), "unavailable").otherwise(status.focus_band(_c("focus"))))


def sub_sites(pages: DataFrame, min_share: float = 0.15, min_purity: float = 0.6) -> DataFrame:
    """Clusters of a site that line up with a first path segment of their own; ``(site, page, cluster, segment)``."""
    counts = pages.groupBy("site", "cluster", "segment").agg(F.count("*").alias("n"))
    per = counts.groupBy("site", "cluster").agg(F.sum("n").alias("pages"), F.min_by(F.struct("segment", "n"), F.struct((-_c("n")).alias("a"), "segment")).alias("top"))
    total = per.groupBy("site").agg(F.sum("pages").alias("all"))
    rows = per.join(total, "site").select("site", "cluster", _c("top.segment").alias("segment"), (_c("pages") / _c("all")).alias("share"), (_c("top.n") / _c("pages")).alias("purity"))
    good = rows.where((_c("share") >= min_share) & (_c("purity") >= min_purity) & _c("segment").isNotNull())
    own = good.groupBy("site", "segment").agg(F.count("*").alias("claims")).where("claims = 1").drop("claims")
    many = good.join(own, ["site", "segment"], "left_semi")
    return many.join(many.groupBy("site").agg(F.count("*").alias("found")).where("found >= 2"), "site").drop("found")


def hub_link_suggestions(pages: DataFrame, links: DataFrame, hubs_per_site: int = 5, per_source: int = 2) -> DataFrame:
    """Borderline pages that do not link to the site's best hubs yet; ``pages(site, page, score, page_type)``.

    A site has at most five hubs, carried as one array per site.
    """
    hub = shapes.top_k(pages.where("score >= 75 AND page_type <> 'technical'"), ["site"], hubs_per_site, F.desc("score"), _c("page"))
    table = hub.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rank", _c("page").alias("hub")))).alias("hubs"))
    rows = pages.where("score >= 40 AND score < 75").join(table, "site").select("site", "page", "score", F.explode("hubs").alias("h")).select("site", _c("page").alias("source"), "score", "h.hub", _c("h.rank").alias("hub_rank"))
    open_ = rows.join(links.select("source", _c("target").alias("hub")).distinct(), ["source", "hub"], "left_anti")
    return shapes.top_k(open_, ["site", "source"], per_source, _c("hub_rank")).select("site", "source", "hub", "rank")


def term_gaps(own: DataFrame, competitors: DataFrame, coverage_below: float = 0.15) -> DataFrame:
    """Competitor terms a site never uses, and its own topics that few pages carry; ``(site, page, term)``."""
    mine = own.groupBy("site", "term").agg(F.countDistinct("page").alias("df"))
    size = own.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("n"))
    theirs = competitors.groupBy("site", "term").agg(F.countDistinct("page").alias("pages"))
    absent = theirs.join(mine, ["site", "term"], "left_anti").select("site", "term", F.lit("competitor-term").alias("code"), F.lit(0.0).alias("coverage"))
    thin = theirs.join(mine, ["site", "term"]).join(size, "site").withColumn("coverage", _c("df") / _c("n")).where(_c("coverage") < coverage_below).select("site", "term", F.lit("thin-subtopic").alias("code"), "coverage")
    return absent.unionByName(thin)


def unique_terms(members: DataFrame, limit: int = 6) -> DataFrame:
    """Terms that no other member of the group has; ``(group, url, term, weight)``."""
    only = members.groupBy("group", "term").agg(F.countDistinct("url").alias("n"), F.min("url").alias("url"), F.max("weight").alias("weight")).where("n = 1")
    return shapes.top_k(only, ["group", "url"], limit, F.desc("weight"), _c("term")).select("group", "url", "term", "rank")


def link_opportunities(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Ordered similar pages without a link in that direction; ``pairs(left, right, similarity, shared)``."""
    both = pairs.select(_c("left").alias("source"), _c("right").alias("target"), "similarity", "shared").unionByName(pairs.select(_c("right").alias("source"), _c("left").alias("target"), "similarity", "shared"))
    return both.join(links.select("source", "target").distinct(), ["source", "target"], "left_anti")


def recommendation_deltas(pages: DataFrame) -> DataFrame:
    """Score change of a site if its off-topic pages went, or its borderline pages reached 75; from sums alone."""
    w = status.type_weight(_c("page_type"))
    off = (_c("score") < 40) & (_c("page_type") != "technical")
    mid = (_c("score") >= 40) & (_c("score") < 75)
    s = pages.groupBy("site").agg(
        F.sum(w).alias("w"), F.sum(w * _c("score")).alias("ws"), F.sum(F.when(off, w).otherwise(0.0)).alias("w_off"), F.sum(F.when(off, w * _c("score")).otherwise(0.0)).alias("ws_off"),
        F.sum(F.when(mid, w * (75 - _c("score"))).otherwise(0.0)).alias("lift"), F.count_if(off).alias("off_topic"), F.count_if(mid).alias("borderline"),
    )
    base = _c("ws") / _c("w")
    rows = F.array(
        F.struct(F.lit("remove-off-topic").alias("action"), _c("off_topic").alias("pages"), (F.try_divide(_c("ws") - _c("ws_off"), _c("w") - _c("w_off")) - base).alias("delta")),
        F.struct(F.lit("improve-borderline").alias("action"), _c("borderline").alias("pages"), (_c("lift") / _c("w")).alias("delta")),
    )
    return s.select("site", F.explode(rows).alias("r")).select("site", "r.action", "r.pages", "r.delta").where("pages > 0")


def weekly_tasks(recommendations: DataFrame, limit: int = 3) -> DataFrame:
    return shapes.top_k(recommendations, ["site"], limit, F.desc("delta"), _c("action"))


def brand_terms(terms: DataFrame, own: list[str], competitors: list[str], exceptions: list[str]) -> DataFrame:
    """Terms with the reason they are brand words, null for the others; whole words only."""
    word = lambda names: "(^| )(" + "|".join(names) + ")( |$)" if names else "$^"
    reason = F.when(_c("term").isin(*exceptions), F.lit(None).cast("string")).when(_c("term").rlike(word(own)), "own-brand").when(_c("term").rlike(word(competitors)), "competitor-brand")
    return terms.withColumn("brand_reason", reason)
