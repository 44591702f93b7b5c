"""One parse pass over landed HTML.

``with_nodes`` turns each page into a flat, ordered array of nodes. The Python part only tokenises; titles,
links, zones, headings, sections and findings are Spark expressions over that array, so pages never shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Tasks get the parse helper with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = T.ArrayType(T.StructType([
    *[T.StructField(name, T.IntegerType()) for name in ("pos", "last", "parent", "depth")],
    T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("path", T.StringType()),
]))
_ARROW_NODE = pa.struct([
    ("pos", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("path", pa.string()),
])
#: Bytes of HTML whose nodes a worker holds at once.
_PART = 1 << 18
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TEXT_OF = frozenset(
    "title h1 h2 h3 h4 h5 h6 a p li dt dd td th button label option figcaption blockquote script style caption "
    "summary strong b em".split()
)
_CLOSES = {  # start tag -> open elements it ends
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
_BLOCK = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)


def _mark(tag: str, attrs: dict) -> str:
    """Path step: tag and, in brackets, class and id tokens, @role and ~hidden."""
    marks = []
    for name in ("id", "class"):
        marks += "".join(c if c.isalnum() else " " for c in (attrs.get(name) or "").lower()).split()
    if attrs.get("role"):
        marks.append("@" + attrs["role"].lower().strip())
    style = (attrs.get("style") or "").lower().replace(" ", "")
    if ("hidden" in attrs or "inert" in attrs or (attrs.get("aria-hidden") or "").strip().lower() in ("true", "1", "yes")
            or "display:none" in style or "visibility:hidden" in style):
        marks.append("~hidden")
    return tag + ("[" + " ".join(marks) + "]" if marks else "")


class _Flat(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def _end_to(self, depth: int):
        while len(self.open) > depth:
            row, _, texts = self.open.pop()
            row["last"] = len(self.rows) - 1
            if texts is not None:
                row["text"] = " ".join("".join(texts).split()) if row["tag"] not in ("script", "style") else "".join(texts)

    def handle_starttag(self, tag, attrs):
        attrs = {k: v if v is not None else "" for k, v in reversed(attrs)}
        ends = _CLOSES.get(tag, ()) + (("p",) if tag in _BLOCK else ())
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][0]["tag"]
            if name in ends:
                self._end_to(depth)
                break
            if name in ("ul", "ol", "dl", "table", "body", "div"):
                break
        row = {
            "pos": len(self.rows), "last": len(self.rows), "parent": self.open[-1][0]["pos"] if self.open else -1,
            "depth": len(self.open), "tag": tag, "attrs": list(attrs.items()), "text": None,
            "path": "/".join(step for _, step, _ in self.open),
        }
        self.rows.append(row)
        if tag not in _VOID:
            self.open.append((row, _mark(tag, attrs), [] if tag in _TEXT_OF else None))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0]["tag"] == tag:
                self._end_to(depth)
                return

    def handle_data(self, data):
        for _, _, texts in self.open:
            if texts is not None:
                texts.append(data)
        if data.strip():
            self.rows.append({
                "pos": len(self.rows), "last": len(self.rows), "parent": self.open[-1][0]["pos"] if self.open else -1,
                "depth": len(self.open), "tag": "#text", "attrs": [], "text": data,
                "path": "/".join(step for _, step, _ in self.open),
            })


def _flatten(html: str | None):
    if html is None:
        return None
    parser = _Flat()
    parser.feed(html)
    parser.close()
    parser._end_to(0)
    return parser.rows


def _few(html: pa.Array) -> Iterator[pa.Array]:
    """The pages in turn, in parts of about ``_PART`` bytes; a larger page is a part of its own."""
    first, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(html), 0).to_pylist()):
        if i > first and size + n > _PART:
            yield html.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(html):
        yield html.slice(first)


@F.arrow_udf(NODES)
def parse_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # Few pages at a time become objects, and what they leave goes back before the next ones.
    for batch in batches:
        for html in _few(batch):
            yield pa.array([_flatten(h.as_py()) for h in html], type=pa.list_(_ARROW_NODE))
            pa.default_memory_pool().release_unused()


def with_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their node array; the HTML text is dropped from the row."""
    return pages.withColumn("nodes", parse_nodes(F.col(html))).withColumn("html_bytes", F.octet_length(html)).drop(html)


# --- expressions over the node array -------------------------------------------------------------------------

def elements(*tags: str, nodes: Column | None = None) -> Column:
    return F.filter(F.col("nodes") if nodes is None else nodes, lambda n: n["tag"].isin(*tags))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def first_text(tag: str) -> Column:
    return F.get(F.transform(elements(tag), lambda n: n["text"]), F.lit(0))


def texts(*tags: str) -> Column:
    return F.transform(elements(*tags), lambda n: n["text"])


def metas(name: str) -> Column:
    """Non-empty contents of ``<meta name=…>`` or ``<meta property=…>``, in page order."""
    hits = F.filter(
        elements("meta"), lambda n: (F.lower(attr(n, "name")) == name).eqNullSafe(True) | (F.lower(attr(n, "property")) == name).eqNullSafe(True)
    )
    return F.filter(F.transform(hits, lambda n: F.trim(attr(n, "content"))), lambda c: c.isNotNull() & (c != ""))


def link_rels(rel: str) -> Column:
    """href values of ``<link rel=…>``, in page order."""
    hits = F.filter(elements("link"), lambda n: F.array_contains(F.split(F.lower(F.coalesce(attr(n, "rel"), F.lit(""))), r"\s+"), rel))
    return F.filter(F.transform(hits, lambda n: F.trim(attr(n, "href"))), lambda c: c.isNotNull() & (c != ""))


def _step(pattern: str) -> str:
    return rf"(^|/)({pattern})(\[[^\]]*\])?(/|$)"


def _has_mark(pattern: str) -> str:
    return rf"[\[ ]({pattern})[\] ]"


# Path steps and marks that make a zone.
NAV_ZONE = "|".join((_step("nav|header"), _has_mark("@navigation|@banner|breadcrumb|breadcrumbs|navbar|menu")))
SIDE_ZONE = "|".join((_step("aside|footer"), _has_mark("@complementary|@contentinfo|sidebar|footer")))
WIDGET_ZONE = _has_mark("widget")
MAIN_ZONE = "|".join((_step("main"), _has_mark("@main")))
CHROME = "|".join((
    _step("header|nav|footer|aside|form"),
    _has_mark("~hidden|@banner|@navigation|@contentinfo|@complementary|@form|@search|header|footer|sidebar|side|"
              "navigation|navbar|navmenu|menu|breadcrumb|cookie|consent|banner"),
))
PRIMARY = "|".join((_step("main|article"), _has_mark("@main|maincontent|articlebody|postbody|entrycontent")))
UNSEEN = _step("script|style|noscript|svg|template")


def zone(path: Column) -> Column:
    """Strongest zone among the ancestors."""
    return (
        F.when(path.rlike(NAV_ZONE), "nav_breadcrumb").when(path.rlike(SIDE_ZONE), "sidebar_footer")
        .when(path.rlike(WIDGET_ZONE), "widget").when(path.rlike(MAIN_ZONE), "main").otherwise("unknown")
    )


def main_text() -> Column:
    """Visible text of the primary region, or of the whole body where the page names none."""
    seen = F.filter(
        F.col("nodes"),
        lambda n: (n["tag"] == "#text") & n["path"].rlike(_step("body")) & ~n["path"].rlike(UNSEEN) & ~n["path"].rlike(CHROME),
    )
    rooted = F.exists(F.col("nodes"), lambda n: n["path"].rlike(PRIMARY))
    kept = F.when(rooted, F.filter(seen, lambda n: n["path"].rlike(PRIMARY))).otherwise(seen)
    joined = F.array_join(F.transform(kept, lambda n: n["text"]), " ")
    return F.trim(F.regexp_replace(joined, r"\s+", " "))
