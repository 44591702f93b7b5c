"""Typed tables from parsed pages: every one is a projection or an explode of the node array."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions import selectors, text, urls
from pagewright.sources import html

parse = html.with_nodes
_LINK_BLOCKS = ("p", "li", "td", "dd", "blockquote", "div", "section", "article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _keys(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c in ("site_id", "run_id", "page_id")]


def links(pages: DataFrame, url: str = "url") -> DataFrame:
    """Source, target, anchor, rel, internal flag, zone and position of every ``<a href>``."""
    anchors = F.filter(html.elements("a"), lambda n: html.attr(n, "href").isNotNull())
    rows = pages.select(*_keys(pages), F.col(url).alias("source"), F.posexplode(anchors).alias("i", "n"))
    href = F.trim(html.attr(F.col("n"), "href"))
    target = urls.resolve(F.col("source"), href)
    return rows.select(
        *_keys(pages), "source", (F.col("i") + 1).alias("pos"), href.alias("href"), F.col("n.text").alias("anchor"),
        F.coalesce(html.attr(F.col("n"), "rel"), F.lit("")).alias("rel"),
        F.coalesce(html.attr(F.col("n"), "target"), F.lit("")).alias("window"),
        target.alias("target"), html.zone(F.col("n.path")).alias("zone"),
        (urls.host(F.col("source")) == urls.host(target)).alias("is_internal"),
    )


def link_findings(link_rows: DataFrame) -> DataFrame:
    """Unsafe new-window links, plain http targets, empty anchors."""
    rel = F.split(F.lower(F.col("rel")), r"\s+")
    unsafe = (F.lower("window") == "_blank") & ~F.col("is_internal") & ~F.array_contains(rel, "noopener") & ~F.array_contains(rel, "noreferrer")
    codes = F.array_compact(F.array(
        F.when(unsafe, "unsafe-blank-target"),
        F.when(F.lower("target").startswith("http://"), "http-target"),
        F.when(F.trim("anchor") == "", "empty-anchor"),
    ))
    return link_rows.select(*_keys(link_rows), "source", "target", F.explode(codes).alias("code"))


def link_context(pages: DataFrame, url: str = "url", width: int = 15) -> DataFrame:
    """Up to ``width`` words before and after each link in its block, and the nearest H2/H3 before it."""
    nodes = F.col("nodes")
    anchors = F.filter(html.elements("a"), lambda n: html.attr(n, "href").isNotNull())

    def ancestor_block(n: Column) -> Column:
        around = F.filter(html.elements(*_LINK_BLOCKS), lambda b: (b["pos"] < n["pos"]) & (b["last"] >= n["last"]))
        return F.element_at(around, -1)

    def words_between(lo: Column, hi: Column) -> Column:
        inside = F.filter(
            F.slice(nodes, lo + 1, F.greatest(hi - lo + 1, F.lit(0))),
            lambda m: (m["tag"] == "#text") & ~m["path"].rlike(html.UNSEEN),
        )
        joined = F.array_join(F.transform(inside, lambda m: m["text"]), " ")
        return F.filter(F.split(joined, r"\s+"), lambda w: w != "")

    rows = pages.select(*_keys(pages), F.col(url).alias("source"), "nodes", F.posexplode(anchors).alias("i", "n"))
    n = F.col("n")
    rows = rows.withColumn("b", F.when(F.exists(html.elements(*_LINK_BLOCKS), lambda b: (b["pos"] < n["pos"]) & (b["last"] >= n["last"])), ancestor_block(n)))
    before = words_between(F.col("b.pos"), n["pos"] - 1)
    after = words_between(n["last"] + 1, F.col("b.last"))
    heads = F.filter(html.elements("h2", "h3"), lambda h: h["last"] < n["pos"])
    return rows.select(
        *_keys(pages), "source", (F.col("i") + 1).alias("pos"), n["text"].alias("anchor"), before.alias("_before"), after.alias("_after"),
        F.when(F.size(heads) > 0, F.element_at(F.transform(heads, lambda h: h["text"]), -1)).alias("section_heading"),
    ).select(
        *_keys(pages), "source", "pos", "anchor", "section_heading",
        F.array_join(F.when(F.size("_before") > width, F.slice("_before", -width, width)).otherwise(F.col("_before")), " ").alias("before"),
        F.array_join(F.slice("_after", 1, width), " ").alias("after"),
        F.size("_before").alias("anchor_offset"),
        ((F.size("_before") > width) | (F.size("_after") > width)).alias("truncated"),
    )


def title_meta(pages: DataFrame, profile: str = "crawl") -> DataFrame:
    """Title, description, canonical and the finding codes of one of the two length profiles."""
    limits = {"crawl": ((30, 60), (70, 160)), "audit": ((40, 65), (120, 165))}[profile]
    out = pages.select(
        *_keys(pages), "url", html.texts("title").alias("_t"), html.metas("description").alias("_d"),
        html.link_rels("canonical").alias("_c"), html.metas("viewport").alias("_v"), html.metas("robots").alias("_r"),
    ).select(
        *_keys(pages), "url", F.get("_t", F.lit(0)).alias("title"), F.size("_t").alias("title_count"),
        F.get("_d", F.lit(0)).alias("description"), F.size("_d").alias("description_count"),
        F.get("_c", F.lit(0)).alias("canonical"), F.get("_v", F.lit(0)).alias("viewport"), F.get("_r", F.lit(0)).alias("robots"),
    )
    outside = lambda c, r: ~F.length(c).between(*r)
    codes = F.array_compact(F.array(
        F.when(F.coalesce(F.col("title"), F.lit("")) == "", "title-missing"),
        F.when(F.col("title_count") > 1, "title-multiple"),
        F.when(outside("title", limits[0]), "title-length"),
        F.when(F.col("description").isNull(), "description-missing"),
        F.when(F.col("description_count") > 1, "description-multiple"),
        F.when(outside("description", limits[1]), "description-length"),
        F.when(F.col("canonical").isNull() & F.lit(profile == "audit"), "canonical-missing"),
        F.when(F.col("viewport").isNull() & F.lit(profile == "audit"), "viewport-missing"),
        F.when(F.lower("robots").contains("noindex") & F.lit(profile == "audit"), "robots-noindex"),
    ))
    return out.withColumn("codes", codes)


def headings(pages: DataFrame) -> DataFrame:
    """Headings in page order with their level."""
    rows = pages.select(*_keys(pages), F.posexplode(html.elements(*HEADINGS)).alias("pos", "n"))
    return rows.select(
        *_keys(pages), "pos", F.substring("n.tag", 2, 1).cast("int").alias("level"), F.col("n.text").alias("text")
    )


def heading_findings(pages: DataFrame) -> DataFrame:
    """No H1, several H1, skipped levels, repeated texts; computed inside each page's array."""
    levels = F.transform(html.elements(*HEADINGS), lambda n: F.substring(n["tag"], 2, 1).cast("int"))
    base = pages.select(
        *_keys(pages), levels.alias("_l"),
        F.transform(html.elements(*HEADINGS), lambda n: F.lower(F.trim(n["text"]))).alias("_x"),
    )
    h1 = F.size(F.filter("_l", lambda v: v == 1))
    jumps = F.size(F.filter(F.transform("_l", lambda v, i: v - F.coalesce(F.get(F.col("_l"), i - 1), v)), lambda d: d > 1))
    named = F.filter("_x", lambda x: x != "")
    repeated = F.size(named) - F.size(F.array_distinct(named))
    codes = F.array_compact(F.array(
        F.when(h1 == 0, "h1-missing"), F.when(h1 > 1, "h1-multiple"), F.when(jumps > 0, "level-skipped"),
        F.when(repeated > 0, "heading-repeated"),
    ))
    return base.select(*_keys(pages), h1.alias("h1_count"), jumps.alias("jumps"), F.size("_l").alias("headings"), codes.alias("codes"))


def repeated_headings(heading_rows: DataFrame) -> DataFrame:
    """Heading texts used more than once on a page, with their levels."""
    keys = _keys(heading_rows)
    return (
        heading_rows.withColumn("text_key", F.lower(F.trim("text"))).where("text_key <> ''")
        .groupBy(*keys, "text_key").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("level")).alias("levels"))
        .where("occurrences > 1")
    )


def images(pages: DataFrame, url: str = "url") -> DataFrame:
    """Images with size, loading mode, best srcset width and finding codes."""
    rows = pages.select(*_keys(pages), F.col(url).alias("page"), F.posexplode(html.elements("img")).alias("pos", "n"))
    a = lambda name: html.attr(F.col("n"), name)
    width, height = a("width").try_cast("int"), a("height").try_cast("int")
    candidates = F.transform(
        F.filter(F.split(F.coalesce(a("srcset"), F.lit("")), r",\s+"), lambda c: F.trim(c) != ""),
        lambda c: F.regexp_extract(F.trim(c), r"\s([0-9]+)w$", 1).try_cast("int"),
    )
    codes = F.array_compact(F.array(
        F.when(a("alt").isNull(), "alt-missing"),
        F.when(width.isNull() | height.isNull(), "dimensions-missing"),
        F.when(F.coalesce(a("src"), F.lit("")) == "", "src-missing"),
    ))
    return rows.select(
        *_keys(pages), "page", "pos", urls.resolve(F.col("page"), a("src")).alias("src"), a("alt").alias("alt"),
        width.alias("width"), height.alias("height"), (F.lower(a("loading")) == "lazy").eqNullSafe(True).alias("lazy"),
        F.size(candidates).alias("candidates"), F.array_max(candidates).alias("largest_candidate"), codes.alias("codes"),
    )


def declarations(pages: DataFrame, url: str = "url") -> DataFrame:
    """Long table of declared relations: canonical, next/prev, amphtml, alternates, refresh, icons, social, frames."""

    def rel(kind: str) -> Column:
        return F.transform(html.link_rels(kind), lambda v: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("name"), v.alias("value")))

    alternates = F.transform(
        F.filter(html.elements("link"), lambda n: html.attr(n, "hreflang").isNotNull() & html.attr(n, "href").isNotNull()),
        lambda n: F.struct(F.lit("hreflang").alias("kind"), html.attr(n, "hreflang").alias("name"), html.attr(n, "href").alias("value")),
    )
    refresh = F.transform(
        F.filter(html.elements("meta"), lambda n: (F.lower(html.attr(n, "http-equiv")) == "refresh").eqNullSafe(True)),
        lambda n: F.struct(
            F.lit("refresh").alias("kind"), F.regexp_extract(html.attr(n, "content"), r"^\s*([0-9]+)", 1).alias("name"),
            F.regexp_extract(html.attr(n, "content"), r"(?i)url\s*=\s*['\"]?([^'\";]+)", 1).alias("value"),
        ),
    )
    social_name = lambda n: F.lower(F.coalesce(html.attr(n, "property"), html.attr(n, "name"), F.lit("")))
    social = F.transform(
        F.filter(html.elements("meta"), lambda n: social_name(n).rlike("^(og|twitter|article):") & html.attr(n, "content").isNotNull()),
        lambda n: F.struct(F.lit("social").alias("kind"), social_name(n).alias("name"), F.trim(html.attr(n, "content")).alias("value")),
    )
    frames = F.transform(
        F.filter(html.elements("iframe", "frame"), lambda n: html.attr(n, "src").isNotNull()),
        lambda n: F.struct(F.lit("frame").alias("kind"), F.coalesce(html.attr(n, "title"), F.lit("")).alias("name"), html.attr(n, "src").alias("value")),
    )
    every = F.concat(*[rel(k) for k in ("canonical", "next", "prev", "amphtml", "icon")], alternates, refresh, social, frames)
    rows = pages.select(*_keys(pages), F.col(url).alias("page"), F.explode(every).alias("d"))
    value = F.when(F.col("d.kind") == "social", F.col("d.value")).otherwise(urls.resolve(F.col("page"), F.col("d.value")))
    return rows.select(*_keys(pages), "page", "d.kind", "d.name", value.alias("value"))


def canonical_relation(page_url: Column, count: Column, target: Column) -> Column:
    """How the declared canonical relates to the page."""
    page_key, target_key = urls.url_key(page_url, "gate"), urls.url_key(target, "gate")
    return (
        F.when(count == 0, "missing").when(count > 1, "multiple").when(target_key.isNull(), "invalid")
        .when(page_key == target_key, "self").when(urls.host(page_url) == urls.host(target), "same-host").otherwise("different-host")
    )


def layout_signature(pages: DataFrame, depth: int = 5) -> DataFrame:
    """Sorted set of tag paths below body, so repeats and order do not matter; inline tags are left out."""
    # Dynamic or inline tags that follow the text, not the layout.
    skipped = (
        "script", "style", "noscript", "svg", "template", "a", "span", "strong", "em", "b", "i", "u", "s", "br", "wbr",
        "small", "sup", "sub", "code", "abbr", "time", "mark", "img", "picture", "source", "cite", "q", "kbd", "var",
        "bdi", "bdo",
    )
    inline = rf"(^|/)({'|'.join(skipped)})(/|$)"
    plain = F.transform("nodes", lambda n: F.regexp_replace(F.concat_ws("/", n["path"], n["tag"]), r"\[[^\]]*\]", ""))
    below = F.transform(F.filter(plain, lambda p: p.rlike("(^|/)body/")), lambda p: F.regexp_extract(p, "body/(.*)$", 1))
    layout = F.filter(below, lambda p: ~p.contains("#text") & ~p.rlike(inline) & (F.size(F.split(p, "/")) <= depth))
    count = lambda *tags: F.size(F.filter(html.elements(*tags), lambda n: n["path"].rlike("(^|/)body")))
    return pages.select(
        *_keys(pages), F.array_join(F.array_sort(F.array_distinct(layout)), ",").alias("signature"),
        count("table").alias("tables"), count("ol").alias("ordered_lists"), count("ul").alias("unordered_lists"),
        count("input", "select", "textarea").alias("inputs"),
    )


def script_shell(pages: DataFrame, max_words: int = 50) -> DataFrame:
    """Pages whose text is likely filled in by scripts, with the reason."""
    # Marks of framework payloads.
    markers = ("__NEXT_DATA__", "__NUXT__", "__INITIAL_STATE__", "__APOLLO_STATE__")
    words = F.size(F.filter(F.split(html.main_text(), r"\s+"), lambda w: w != ""))
    scripts = html.elements("script")
    payload = F.exists(scripts, lambda n: F.concat_ws(" ", html.attr(n, "id"), n["text"]).rlike("|".join(markers)))
    bundle = F.exists(scripts, lambda n: F.coalesce(html.attr(n, "src"), F.lit("")).rlike(r"(?i)(bundle|main|app|chunk|vendor)[^/]*\.js"))
    root = F.exists(
        html.elements("div"),
        lambda n: F.coalesce(html.attr(n, "id"), F.lit("")).isin("root", "app", "__next", "__nuxt") & (n["last"] == n["pos"]),
    )
    reason = F.when(words >= max_words, F.lit(None)).when(payload, "payload").when(bundle & root, "bundle-empty-root")
    return pages.select(*_keys(pages), words.alias("words"), reason.cast("string").alias("reason"))


def technologies(pages: DataFrame, markers: list[tuple[str, str]]) -> DataFrame:
    """Technologies named by a generator tag or by marker texts in asset addresses and script bodies."""
    source = F.lower(F.array_join(
        F.flatten(F.transform(html.elements("script", "link", "img", "meta"), lambda n: F.array_append(F.map_values(n["attrs"]), F.coalesce(n["text"], F.lit(""))))),
        "\n",
    ))
    generator = F.get(html.metas("generator"), F.lit(0))
    named = F.when(generator.isNotNull(), F.array(F.struct(
        F.lower(F.regexp_extract(generator, r"^(\S+)", 1)).alias("technology"), F.regexp_extract(generator, r"([0-9]+(?:\.[0-9]+)*)", 1).alias("version"),
    ))).otherwise(F.array().cast("array<struct<technology:string,version:string>>"))
    marked = F.array_compact(F.array(*[
        F.when(source.contains(mark.lower()), F.struct(F.lit(name).alias("technology"), F.lit("").alias("version"))) for name, mark in markers
    ]))
    return pages.select(*_keys(pages), F.explode(F.array_distinct(F.concat(named, marked))).alias("t")).select(*_keys(pages), "t.technology", "t.version")


def sections(pages: DataFrame) -> DataFrame:
    """Heading-delimited sections of the main content, lead first, with paragraphs and list counts."""
    tags = ("h1", "h2", "h3", "p", "li", "dd", "blockquote", "table", "ol", "ul", "dl")
    inside = F.filter(html.elements(*tags), lambda n: ~n["path"].rlike(html.CHROME) & ~n["path"].rlike(html.UNSEEN))
    rooted = F.exists("nodes", lambda n: n["path"].rlike(html.PRIMARY))
    kept = F.when(rooted, F.filter(inside, lambda n: n["path"].rlike(html.PRIMARY))).otherwise(inside)
    base = pages.select(*_keys(pages), kept.alias("_e"))
    starts = F.concat(
        F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("heading"), F.lit(0).alias("level"))),
        F.transform(
            F.filter("_e", lambda n: n["tag"].isin("h1", "h2", "h3") & (F.coalesce(n["text"], F.lit("")) != "")),
            lambda n: F.struct(n["pos"].alias("pos"), n["text"].alias("heading"), F.substring(n["tag"], 2, 1).cast("int").alias("level")),
        ),
    )
    rows = base.withColumn("_s", starts).select(*_keys(pages), "_e", "_s", F.posexplode("_s").alias("section", "s"))
    end = F.coalesce(F.get(F.col("_s"), F.col("section") + 1)["pos"], F.lit(2147483647))
    own = F.filter("_e", lambda n: (n["pos"] > F.col("s.pos")) & (n["pos"] < end))
    count = lambda *tags: F.size(F.filter("own", lambda n: n["tag"].isin(*tags)))
    nested = r"(^|/)(table|li|dd)(\[[^\]]*\])?(/|$)"
    paragraphs = F.transform(
        F.filter("own", lambda n: n["tag"].isin("p", "li", "dd", "blockquote") & ~((n["tag"] == "p") & n["path"].rlike(nested)) & (F.coalesce(n["text"], F.lit("")) != "")),
        lambda n: n["text"],
    )
    out = rows.withColumn("own", own).select(
        *_keys(pages), "section", "s.heading", "s.level", paragraphs.alias("paragraphs"), count("table").alias("tables"),
        count("ol").alias("ordered_lists"), count("ul").alias("unordered_lists"), count("dl").alias("definition_lists"),
    )
    return out.where("heading <> '' OR size(paragraphs) > 0 OR tables + ordered_lists + definition_lists > 0")


def regex_extractions(pages: DataFrame, definitions: list[tuple[str, str]], body: str = "html") -> DataFrame:
    """User-defined extraction: per definition every match, group 1 where the pattern has one, else the whole."""

    def hits(name: str, pattern: str) -> Column:
        group = 1 if "(" in pattern.replace("\\(", "").replace("(?", "") else 0
        found = F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(group))
        return F.transform(found, lambda v, i: F.struct(F.lit(name).alias("definition"), i.alias("nr"), v.alias("value")))

    rows = pages.select(*_keys(pages), F.explode(F.concat(*[hits(n, p) for n, p in definitions])).alias("x"))
    return rows.select(*_keys(pages), "x.definition", "x.nr", "x.value")


@dataclass(frozen=True)
class Search:
    """A user's extraction: by css, xpath or regex, of text or an attribute."""

    id: str
    kind: str
    query: str
    result: str = "text"
    attribute: str | None = None


def _values(search: Search, body: str | None) -> tuple[Column | None, str | None]:
    """(array of what a search finds, None) or (None, why it can't run)."""
    kind = search.kind.strip().lower()
    if kind == "regex":
        if body is None:
            return None, "a pattern needs the page text"
        try:
            pattern = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(search.query.strip())
        except Exception as err:  # the pattern's own message
            return None, f"not a pattern: {str(getattr(err, 'java_exception', err)).splitlines()[0]}"
        return F.regexp_extract_all(F.col(body), F.lit(search.query.strip()), F.lit(min(1, pattern.matcher("").groupCount()))), None
    if kind not in ("css", "xpath") or search.result not in ("text", "attribute"):
        return None, f"{kind} searches for {search.result} are not known"
    try:
        paths = selectors.css(search.query) if kind == "css" else selectors.xpath(search.query)
    except selectors.SelectorError as err:
        return None, str(err)
    ends = paths[0].ends
    attribute = ends[1:] if ends.startswith("@") else (search.attribute or "").strip().lower() if search.result == "attribute" else None
    shown = (lambda n: html.attr(n, attribute)) if attribute is not None else lambda n: F.regexp_replace(selectors.text_of(n, F.col("nodes")), r"^\s+|\s+$", "")
    return F.transform(selectors.selected_by_any(paths, F.col("nodes")), shown), None


def custom_extractions(pages: DataFrame, searches: list[Search], most: int = 5, longest: int = 1000, body: str = "html") -> DataFrame:
    """(page keys, id, values, error, truncated): one row for each page and search.

    Values are the first ``most`` that aren't blank, cut to ``longest`` letters, which ``truncated`` tells. A search that can't be
    read has an error and no values, and doesn't keep the others from running. Selectors run as expressions over the node array
    of :func:`parse`, patterns over the page text in ``body``.
    """
    empty = F.array().cast("array<string>")

    def row(search: Search) -> Column:
        found, error = _values(search, body if body in pages.columns else None)
        if error is not None:
            return F.struct(F.lit(search.id).alias("id"), empty.alias("values"), F.lit(error).alias("error"), F.lit(False).alias("truncated"))
        kept = F.filter(found, lambda v: v.isNotNull() & v.rlike(r"\S"))
        return urls.let(F.coalesce(kept, empty), lambda v: F.struct(
            F.lit(search.id).alias("id"), F.transform(F.slice(v, 1, most), lambda x: F.substring(x, 1, longest)).alias("values"), F.lit(None).cast("string").alias("error"),
            ((F.size(v) > most) | F.exists(F.slice(v, 1, most), lambda x: F.length(x) > longest)).alias("truncated"),
        ))

    rows = pages.select(*_keys(pages), F.explode(F.array(*[row(s) for s in searches])).alias("x"))
    return rows.select(*_keys(pages), "x.*")


def selector_extractions(pages: DataFrame, definitions: list[tuple[str, str, str]]) -> DataFrame:
    """One row for each value that CSS selectors find; the result is text or the name of an attribute. A bad selector is a row with an error."""
    searches = [Search(name, "css", query, "text" if result == "text" else "attribute", result) for name, query, result in definitions]
    rows = custom_extractions(pages, searches, most=2**31 - 1, longest=2**31 - 1)
    return rows.select(*_keys(pages), F.col("id").alias("definition"), F.posexplode_outer("values").alias("nr", "value"), "error").where("value IS NOT NULL OR error IS NOT NULL")


def page_text(pages: DataFrame) -> DataFrame:
    """Main-content text of each page with its word count."""
    return pages.select(*_keys(pages), *[c for c in ("url",) if c in pages.columns], html.main_text().alias("text")).withColumn(
        "word_count", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    )


def markup_findings(pages: DataFrame) -> DataFrame:
    """Rule codes on raw markup: language, duplicate ids, labels, names, obsolete tags, frame titles."""
    ids = F.filter(F.transform("nodes", lambda n: html.attr(n, "id")), lambda v: v.isNotNull() & (v != ""))
    lang = F.get(F.transform(html.elements("html"), lambda n: html.attr(n, "lang")), F.lit(0))
    nameless = lambda n: (F.coalesce(n["text"], F.lit("")) == "") & html.attr(n, "aria-label").isNull() & html.attr(n, "title").isNull()
    labels = F.transform(html.elements("label"), lambda n: F.coalesce(html.attr(n, "for"), F.lit("")))
    unlabelled = F.filter(
        html.elements("input", "select", "textarea"),
        lambda n: ~F.coalesce(html.attr(n, "type"), F.lit("")).isin("hidden", "submit", "button", "image", "reset")
        & ~F.array_contains(labels, F.coalesce(html.attr(n, "id"), F.lit(" "))) & html.attr(n, "aria-label").isNull()
        & ~n["path"].rlike(r"(^|/)label"),
    )
    counted = (
        ("lang-missing", F.when(F.coalesce(lang, F.lit("")) == "", 1).otherwise(0)),
        ("charset-missing", F.when(F.exists(html.elements("meta"), lambda n: html.attr(n, "charset").isNotNull()), 0).otherwise(1)),
        ("id-duplicate", F.size(ids) - F.size(F.array_distinct(ids))),
        ("control-unlabelled", F.size(unlabelled)),
        ("link-nameless", F.size(F.filter(html.elements("a"), lambda n: html.attr(n, "href").isNotNull() & nameless(n)))),
        ("button-nameless", F.size(F.filter(html.elements("button"), nameless))),
        ("frame-untitled", F.size(F.filter(html.elements("iframe"), lambda n: html.attr(n, "title").isNull()))),
        ("tag-obsolete", F.size(html.elements("center", "font", "marquee", "blink", "strike", "big", "tt"))),
        ("image-alt-missing", F.size(F.filter(html.elements("img"), lambda n: html.attr(n, "alt").isNull()))),
        ("nested-anchor", F.size(F.filter(html.elements("a"), lambda n: n["path"].rlike(r"(^|/)a(\[[^\]]*\])?(/|$)")))),
    )
    found = F.filter(
        F.array(*[F.struct(F.lit(code).alias("code"), n.cast("long").alias("occurrences")) for code, n in counted]), lambda s: s["occurrences"] > 0
    )
    return pages.select(*_keys(pages), F.explode(found).alias("f")).select(*_keys(pages), "f.code", "f.occurrences")


def page_features(pages: DataFrame) -> DataFrame:
    """Structure counts used to tell what a page is for."""
    count = lambda *tags: F.size(html.elements(*tags)).cast("long")
    marked = lambda pattern: F.size(F.filter("nodes", lambda n: (n["tag"] != "#text") & F.lower(F.concat_ws(" ", html.attr(n, "class"), html.attr(n, "id"))).rlike(pattern))).cast("long")
    heading_text = F.lower(F.array_join(html.texts("title", "h1", "h2", "h3"), " "))
    return pages.select(
        *_keys(pages), heading_text.alias("heading_text"), F.size(html.elements("h1", "h2", "h3")).cast("long").alias("headings"),
        count("table").alias("tables"), count("ol").alias("ordered_lists"), count("ul").alias("unordered_lists"),
        count("input", "select", "textarea").alias("form_inputs"), marked("calculator|calc").alias("calculators"),
        marked("product|price|card").alias("product_cards"), marked("cta|button").alias("ctas"), marked("address|map|opening").alias("local_signals"),
        F.size(F.filter(F.split(html.main_text(), r"\s+"), lambda w: w != "")).cast("long").alias("words"),
    )
