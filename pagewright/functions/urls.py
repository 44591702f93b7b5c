"""URL column functions. Each caller names the key flavour it needs; flavours are never unified."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Query parameters that only track visits.
TRACKING_NAMES = ("gclid", "dclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl")
TRACKING_PREFIX = "utm_"

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Parameters each comparison key drops, and the words that mark a paged listing.
RANKED_TRACKING = r"^(?i)(utm_[^=]+|gclid|dclid|fbclid|msclkid)$"
SNAPSHOT_TRACKING = r"^(?i)(utm_[a-z]+|gclid|fbclid|msclkid|yclid|mc_cid|mc_eid|ref|srsltid)$"
PAGED_PATH = r"^(?i)(.*?)/(page|strona|seite|pagina)/([0-9]+)/?$"
PAGE_PARAMETER = r"^(?i)(page|paged|pg|strona|seite|pagina)=[0-9]+$"


@dataclass(frozen=True)
class UrlPolicy:
    """Choices of the crawl URL normaliser."""

    lowercase_path: bool = False
    trim_trailing_slash: bool = False
    keep_query: bool = True
    strip_tracking: bool = True
    allowed: tuple[str, ...] = ()
    denied: tuple[str, ...] = ()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for an expression that uses it often; keeps plans small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class UrlParts:
    """Named parts of a parsed URL."""

    def __init__(self, parsed: Column):
        for name in ("scheme", "authority", "host", "port", "path", "query", "fragment"):
            setattr(self, name, parsed[name])

    @property
    def origin(self) -> Column:
        return F.concat(self.scheme, F.lit("://"), self.host, self.port_suffix)

    @property
    def port_suffix(self) -> Column:
        default = ((self.scheme == "http") & (self.port == "80")) | ((self.scheme == "https") & (self.port == "443"))
        return F.when((self.port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), self.port))

    @property
    def search(self) -> Column:
        return F.when(self.query != "", F.concat(F.lit("?"), self.query)).otherwise(F.lit(""))

    @property
    def is_web(self) -> Column:
        return self.scheme.isin("http", "https") & (self.host != "")


def _parse(url: Column) -> Column:
    def named(m: Column) -> Column:
        hostport = F.regexp_replace(m["authority"], r"^[^@]*@", "")
        return F.struct(
            F.lower(m["scheme"]).alias("scheme"), m["authority"].alias("authority"),
            F.regexp_replace(F.lower(F.regexp_replace(hostport, r":[0-9]*$", "")), r"\.$", "").alias("host"),
            F.regexp_extract(hostport, r":([0-9]+)$", 1).alias("port"),
            F.when((m["path"] == "") & (m["authority"] != ""), F.lit("/")).otherwise(m["path"]).alias("path"),
            m["query"].alias("query"), m["fragment"].alias("fragment"),
        )

    names = ("scheme", "authority", "path", "query", "fragment")
    return let(F.struct(*[F.regexp_extract(F.trim(url), _SPLIT, i + 1).alias(n) for i, n in enumerate(names)]), named)


def parts(url: Column) -> UrlParts:
    return UrlParts(_parse(url))


def with_parts(url: Column, body: Callable[[UrlParts], Column]) -> Column:
    """Expression over the parts of a URL that is parsed once."""
    return let(_parse(url), lambda p: body(UrlParts(p)))


def host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^@/?#]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(authority), r"\.$", "")


def _collapse_dots(path: Column) -> Column:
    """RFC 3986 dot-segment removal."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.array_join(folded, "/"), tail)).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """Absolute URL of a link found on ``base``; fragment kept out, null for other schemes."""

    def absolute(v: Column) -> Column:
        b, ref = UrlParts(v["b"]), v["r"]
        own_scheme = ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
        bare = F.regexp_extract(ref, r"^([^?]*)", 1)
        folder = F.when(ref.startswith("/"), F.lit("")).otherwise(F.regexp_extract(b.path, r"^(.*/)", 1))
        return (
            F.when(own_scheme & ~ref.rlike(r"^(?i)https?:"), F.lit(None).cast("string"))
            .when(own_scheme, ref)
            .when(ref.startswith("//"), F.concat(b.scheme, F.lit(":"), ref))
            .when(ref == "", F.concat(b.origin, b.path, b.search))
            .when(ref.startswith("?"), F.concat(b.origin, b.path, ref))
            .otherwise(F.concat(b.origin, _collapse_dots(F.concat(folder, bare)), F.regexp_extract(ref, r"(\?.*)$", 1)))
        )

    clean = F.regexp_replace(F.trim(reference), "#.*$", "")
    return let(F.struct(_parse(base).alias("b"), clean.alias("r")), absolute)


def _pair_name(pair: Column) -> Column:
    return F.lower(F.regexp_extract(pair, r"^([^=]*)", 1))


def is_tracking(name: Column) -> Column:
    return name.isin(*TRACKING_NAMES) | name.startswith(TRACKING_PREFIX)


def decode_unreserved(value: Column) -> Column:
    """Decode only the percent escapes of unreserved characters; upper-case the others."""

    def piece(p: Column) -> Column:
        code = F.upper(F.substring(p, 1, 2))
        char = F.char(F.conv(code, 16, 10).cast("int"))
        rest = F.substring(p, F.lit(3), F.length(p))
        return (
            F.when(~code.rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), p))
            .when(char.rlike(r"^[A-Za-z0-9\-._~]$"), F.concat(char, rest))
            .otherwise(F.concat(F.lit("%"), code, rest))
        )

    pieces = F.split(value, "%")
    decoded = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece)
    return F.when(value.contains("%"), F.concat(F.get(pieces, F.lit(0)), F.array_join(decoded, ""))).otherwise(value)


def crawl_key(url: Column, policy: UrlPolicy = UrlPolicy()) -> Column:
    """Address a crawl stores: no fragment, lower host, chosen path and query rules."""
    return with_parts(url, lambda u: _crawl_key(u, policy))


def _crawl_key(u: UrlParts, policy: UrlPolicy) -> Column:
    path = F.lower(u.path) if policy.lowercase_path else u.path
    if policy.trim_trailing_slash:
        path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
        path = F.when(path == "", F.lit("/")).otherwise(path)
    if not policy.keep_query:
        search = F.lit("")
    elif policy.strip_tracking or policy.allowed or policy.denied:
        def keep(pair: Column) -> Column:
            name, ok = _pair_name(pair), pair != ""
            if policy.strip_tracking:
                ok = ok & ~is_tracking(name)
            if policy.allowed:
                ok = ok & name.isin(*[a.lower() for a in policy.allowed])
            if policy.denied:
                ok = ok & ~name.isin(*[d.lower() for d in policy.denied])
            return ok

        # A bare name is written back with "=", the form-encoded spelling.
        kept = F.transform(
            F.filter(F.split(u.query, "&"), keep),
            lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))),
        )
        search = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    else:
        search = u.search
    return F.when(u.is_web, decode_unreserved(F.concat(u.origin, path, search)))


def _clean_query(u: UrlParts, tracking: str) -> Column:
    kept = F.array_sort(F.filter(F.split(u.query, "&"), lambda p: (p != "") & ~_pair_name(p).rlike(tracking)))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))


def url_key(url: Column, flavour: str) -> Column:
    """Comparison key of a URL. Flavours differ on purpose:

    ``gate``      scheme kept, www kept, trailing slash trimmed, query kept
    ``identity``  as gate, www dropped, unparsable text kept
    ``ranked``    no scheme, www dropped, doubled slashes folded, tracking out, query sorted
    ``snapshot``  no scheme, www dropped, root path empty, tracking out, query sorted
    ``alternate`` only fragment and one trailing slash dropped
    """
    return with_parts(url, lambda u: _url_key(u, url, flavour))


def _url_key(u: UrlParts, url: Column, flavour: str) -> Column:
    trimmed = F.regexp_replace(u.path, "/+$", "")
    bare_host = F.regexp_replace(u.host, r"^www\.", "")
    if flavour == "gate":
        path = F.when(u.path == "/", F.lit("/")).otherwise(trimmed)
        return F.when(u.is_web, F.concat(u.origin, path, u.search))
    if flavour == "identity":
        key = F.concat(u.scheme, F.lit("://"), bare_host, u.port_suffix, trimmed, u.search)
        return F.when(u.is_web, key).otherwise(F.regexp_replace(F.trim(url), "/+$", ""))
    if flavour == "ranked":
        path = F.regexp_replace(F.regexp_replace(u.path, "/{2,}", "/"), "/+$", "")
        path = F.when(path == "", F.lit("/")).otherwise(path)
        open_login = ~u.authority.contains("@")
        return F.when(u.is_web & open_login, F.concat(bare_host, u.port_suffix, path, _clean_query(u, RANKED_TRACKING)))
    if flavour == "snapshot":
        return F.when(u.is_web, F.concat(bare_host, u.port_suffix, trimmed, _clean_query(u, SNAPSHOT_TRACKING)))
    if flavour == "alternate":
        key = F.regexp_replace(F.concat(u.origin, u.path, u.search), "/$", "")
        return F.when(u.is_web, key).otherwise(F.trim(url))
    raise ValueError(f"unknown key flavour {flavour}")


def registrable_domain(host_col: Column, long_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "com.au", "com.br", "co.jp", "com.pl")) -> Column:
    """Domain one level below its public suffix.

    ``long_suffixes`` names the public suffixes of two labels; every other suffix counts as one label,
    so the result is approximate unless the caller passes the full list.
    """
    clean = F.regexp_replace(F.lower(F.trim(host_col)), r"\.$", "")
    tail = F.substring_index(clean, ".", -2)
    long_tail = tail.isin(*long_suffixes) if long_suffixes else F.lit(False)
    return (
        F.when(clean.rlike(r"^[0-9.]+$"), clean)
        .when(long_tail, F.substring_index(clean, ".", -3))
        .otherwise(tail)
    )


def independent_sites(left: Column, right: Column) -> Column:
    a, b = registrable_domain(left), registrable_domain(right)
    return (a != "") & (b != "") & (a != b)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(parts(url).path), "/"), lambda s: s != "")


def section(url: Column) -> Column:
    """First path segment after a language segment."""
    segs = F.filter(F.split(parts(url).path, "/"), lambda s: s != "")
    rest = F.when(F.get(segs, F.lit(0)).rlike("^(?i)[a-z]{2}(-[a-z]{2})?$"), F.slice(segs, F.lit(2), F.size(segs))).otherwise(segs)
    return F.coalesce(F.get(rest, F.lit(0)), F.lit("(root)"))


def listing_base(url: Column) -> Column:
    """Address of the first page of a paged listing: page path part and page parameters removed."""
    return with_parts(url, _listing_base)


def _listing_base(u: UrlParts) -> Column:
    path = F.when(u.path.rlike(PAGED_PATH), F.concat(F.regexp_extract(u.path, PAGED_PATH, 1), F.lit("/"))).otherwise(u.path)
    kept = F.filter(F.split(u.query, "&"), lambda p: (p != "") & ~p.rlike(PAGE_PARAMETER))
    search = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(u.is_web, F.concat(u.origin, path, search))


def template_pattern(url: Column, keep_tokens: int = 2) -> Column:
    """Folder plus the first tokens of the last slug, the rest as ``{var}``."""
    segs = F.filter(F.split(parts(url).path, "/"), lambda s: s != "")
    slug = F.regexp_replace(F.element_at(segs, -1), r"(?i)\.[a-z0-9]{2,5}$", "")
    tokens = F.filter(F.split(slug, "-"), lambda s: s != "")
    keep = F.greatest(F.least(F.lit(keep_tokens), F.size(tokens) - 1), F.lit(0))
    head = F.array_join(F.slice(tokens, F.lit(1), keep), "-")
    folder = F.array_join(F.transform(F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0))), lambda s: F.concat(F.lit("/"), s)), "")
    body = F.concat(folder, F.lit("/"), F.when(head != "", F.concat(head, F.lit("-"))).otherwise(F.lit("")), F.lit("{var}"))
    return F.when(F.size(segs) == 0, F.lit("/")).otherwise(body)


def path_prefixes(url: Column) -> Column:
    """Every directory prefix of the path, root first; the page's own segment is not a directory."""
    segs = F.filter(F.split(parts(url).path, "/"), lambda s: s != "")
    depth = F.greatest(F.size(segs) - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), depth),
        lambda n: F.concat(F.lit("/"), F.array_join(F.transform(F.slice(segs, F.lit(1), n), lambda s: F.concat(s, F.lit("/"))), "")),
    )


def query_changes(source: Column, target: Column) -> Column:
    """Sorted ``name: old → new`` list of query parameters that differ."""

    def grouped(u: UrlParts) -> Column:
        pairs = F.filter(F.split(u.query, "&"), lambda p: p != "")
        return F.transform(
            pairs,
            lambda p: F.struct(
                F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")
            ),
        )

    a, b = grouped(parts(source)), grouped(parts(target))
    names = F.array_sort(F.array_distinct(F.concat(F.transform(a, lambda s: s["k"]), F.transform(b, lambda s: s["k"]))))
    values = lambda arr, k: F.transform(F.filter(arr, lambda s: s["k"] == k), lambda s: s["v"])
    shown = lambda arr: F.when(F.size(arr) == 0, F.lit("∅")).otherwise(F.array_join(arr, ", "))
    changed = F.filter(names, lambda k: ~values(a, k).eqNullSafe(values(b, k)))
    return F.transform(
        changed, lambda k: F.concat(k, F.lit(": "), shown(values(a, k)), F.lit(" → "), shown(values(b, k)))
    )
