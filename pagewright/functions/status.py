"""Status, indexability, type and band rules as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagewright.functions import numbers, urls

NOINDEX = r"(?i)(^|[\s,;])(noindex|none)([\s,;]|$)"

# Words of paths and titles that mark technical and listing pages.
TECHNICAL_WORDS = (
    "privacy", "polityka", "regulamin", "terms", "contact", "kontakt", "o nas", "about us", "login", "logowanie",
    "cookie", "impressum", "datenschutz", "cart", "koszyk", "checkout", "rodo", "gdpr", "kariera", "career", "jobs",
    "reklama", "register", "rejestracja",
)
CATEGORY_WORDS = (
    "category", "categories", "kategoria", "kategorie", "tag", "tags", "temat", "tematy", "blog", "produkty",
    "products", "shop", "sklep", "collection", "collections", "archiwum",
)
TAXONOMY_WORDS = (
    "category", "categories", "kategoria", "kategorie", "tag", "tags", "temat", "tematy", "collection", "collections",
)
TYPE_WEIGHT = {"homepage": 3.0, "category": 2.0, "article": 1.0, "technical": 0.1}
TRUSTED_SUFFIX = r"(?i)(^|\.)(gov|edu|mil|int)$|\.(gov|edu|ac|go|gouv)\.[a-z]{2}$|\.bund\.de$"

FOCUS_BANDS = [(90, "excellent"), (75, "good"), (60, "moderate"), (40, "weak")]
PAGE_BANDS = [(75, "strong"), (60, "moderate"), (50, "borderline"), (40, "weak")]
PRIORITY_BANDS = [(75, "low"), (60, "medium"), (40, "high")]


def matches_any(value: Column, patterns: list[str]) -> Column:
    return value.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def filter_reason(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Why a URL is kept or left out."""
    included = matches_any(url, include) if include else F.lit(True)
    return F.when(~included, "no-include-match").when(matches_any(url, exclude), "exclude-match").otherwise("accepted")


def in_scope(url: Column, base_host: str, subdomains: bool = False, path: str | None = None, allowed: tuple[str, ...] = ()) -> Column:
    """Host is the base (path prefix applies) or an allowed one (path does not apply)."""
    u = urls.parts(url)

    def under(root: str) -> Column:
        same = u.host == root.lower()
        return same | u.host.endswith("." + root.lower()) if subdomains else same

    prefix = "/" + path.strip("/") if path and path.strip("/") else None
    inside = (u.path == prefix) | u.path.startswith(prefix + "/") if prefix else F.lit(True)
    others = F.lit(False)
    for host in allowed:
        others = others | under(host)
    return F.when(under(base_host), inside).otherwise(others)


def canonical_target(url: Column, canonical: Column) -> Column:
    """Declared canonical where it names another page."""
    pair = F.struct(urls.url_key(urls.resolve(url, canonical), "gate").alias("t"), urls.url_key(url, "gate").alias("o"))
    return F.when(F.trim(canonical) != "", urls.let(pair, lambda v: F.when(v["t"] != v["o"], v["t"])))


def index_state(status: Column, robots: Column, x_robots: Column, url: Column, canonical: Column, verdict: Column | None = None) -> Column:
    """error-status, noindex, canonicalized, then a stated verdict, then the status alone."""
    noindex = F.coalesce(robots, F.lit("")).rlike(NOINDEX) | F.coalesce(x_robots, F.lit("")).rlike(NOINDEX)
    out = F.when(status >= 400, "error-status").when(noindex, "noindex").when(canonical_target(url, canonical).isNotNull(), "canonicalized")
    if verdict is not None:
        out = (
            out.when(verdict == "blocked", "noindex").when(verdict == "indexable", "indexable").when(verdict.isNotNull(), "unknown")
        )
    return out.when(status >= 200, "indexable").otherwise("unknown")


def index_reasons(status: Column, robots: Column, x_robots: Column, url: Column, canonical: Column) -> tuple[Column, Column]:
    """(status, reason codes): blocked by response or directive, else uncertain without a self canonical."""
    token = r"(?i)(^|[\s,])(noindex|none)([\s,]|$)"
    blocking = F.array_compact(F.array(
        F.when(~status.between(200, 299), "status-not-2xx"),
        F.when(robots.rlike(token), "meta-noindex"),
        F.when(x_robots.rlike(token), "header-noindex"),
    ))
    other = F.array_compact(F.array(
        F.when(canonical.isNull(), "canonical-missing"),
        F.when(canonical_target(url, canonical).isNotNull(), "canonical-elsewhere"),
    ))
    reasons = F.concat(blocking, other)
    return F.when(F.size(blocking) > 0, "blocked").when(F.size(reasons) == 0, "indexable").otherwise("uncertain"), reasons


def link_status(error: Column, status: Column, redirect: Column) -> Column:
    return (
        F.when(error.isin("dns", "broken"), "broken").when(error.isNotNull(), "unverifiable")
        .when(status.isin(404, 410), "broken").when(status >= 400, "unverifiable")
        .when((status >= 300) | redirect.isNotNull(), "redirect").when(status >= 200, "ok").otherwise("unchecked")
    )


def skip_reason(error: Column, status: Column, content_type: Column, has_terms: Column) -> Column:
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    return (
        F.when(error.rlike("(?i)timeout|timed_out|timed-out"), "render-timeout").when(error.isNotNull(), "request-error")
        .when(status.isNull() | ~status.between(200, 299), "non-topical-status")
        .when(~kind.isin("text/html", "application/xhtml+xml"), "non-html").when(~has_terms, "no-content")
    )


def looks_like_listing(word_count: Column, linked: Column) -> Column:
    """At least five linked documents and fewer than 45 words per link."""
    return F.coalesce((linked >= 5) & (F.try_divide(word_count.cast("double"), linked) < 45), F.lit(False))


def page_type(url: Column, title: Column, start_url: Column, downward: Column, linked: Column, inlinks: Column,
              word_count: Column, depth: Column, page_count: Column) -> Column:
    segs = urls.path_segments(url)
    last = F.element_at(segs, -1)
    technical = F.exists(segs, lambda s: s.isin(*TECHNICAL_WORDS)) | F.coalesce(F.lower(title), F.lit("")).rlike("^(" + "|".join(TECHNICAL_WORDS) + ")")
    popular = (depth <= 1) & (inlinks >= F.greatest(F.lit(5), F.ceil(page_count * 0.15)))
    listing = last.isin(*CATEGORY_WORDS) | F.exists(segs, lambda s: s.isin(*TAXONOMY_WORDS)) | looks_like_listing(word_count, linked) | popular
    home = (F.size(segs) == 0) | (urls.url_key(url, "gate") == urls.url_key(start_url, "gate"))
    return F.when(home, "homepage").when(technical, "technical").when(F.coalesce(downward, F.lit(0)) < 3, "article").when(listing, "category").otherwise("article")


def type_weight(kind: Column) -> Column:
    out = None
    for name, weight in TYPE_WEIGHT.items():
        out = F.when(kind == name, weight) if out is None else out.when(kind == name, weight)
    return out


def is_trusted_host(host: Column, seeds: tuple[str, ...] = ()) -> Column:
    """Public-body and school suffixes, or a seed host and what lies below it."""
    ok = host.rlike(TRUSTED_SUFFIX)
    for seed in seeds:
        ok = ok | (host == seed) | host.endswith("." + seed)
    return (host != "") & ok


def is_dead_link(error: Column, status: Column) -> Column:
    return error.isNotNull() | F.coalesce(status >= 400, F.lit(False))


def focus_band(score: Column) -> Column:
    return numbers.ladder(score, FOCUS_BANDS, "critical")


def page_band(score: Column) -> Column:
    return numbers.ladder(score, PAGE_BANDS, "off-topic")


def priority_band(score: Column) -> Column:
    return numbers.ladder(score, PRIORITY_BANDS, "critical")
