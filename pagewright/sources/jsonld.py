"""Structured data of pages: JSON-LD scripts as rows of (page, decl, path, property, value)."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pagewright.sources import html

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TRIPLES = "array<struct<path:string,property:string,value:string>>"


def facts(text: str | None) -> Iterator[tuple[str, str, str | None]]:
    """(path of the object, property, value) of every object in a JSON text, outer ones first.

    A value is the text of a scalar, the ``@id`` of an object that has one, and null for other objects; a list has a row for
    each of its values. Malformed texts have none.
    """
    try:
        todo = [("$", json.loads(text or ""))]
    except (ValueError, RecursionError):
        return
    at = 0
    while at < len(todo):
        path, value = todo[at]
        at += 1
        if isinstance(value, list):
            todo += [(f"{path}[{i}]", x) for i, x in enumerate(value)]
        elif isinstance(value, dict):
            for name, inner in value.items():
                listed = isinstance(inner, list)
                for i, x in enumerate(inner if listed else [inner]):
                    if isinstance(x, dict):
                        own = x.get("@id")
                        yield path, name, own if isinstance(own, str) else None
                        todo.append((f"{path}.{name}[{i}]" if listed else f"{path}.{name}", x))
                    elif x is not None and not isinstance(x, list):
                        yield path, name, x if isinstance(x, str) else json.dumps(x)


def json_ld(pages: DataFrame, url: str = "url") -> DataFrame:
    """Facts of the JSON-LD scripts of parsed pages; ``decl`` numbers the scripts of a page from 0."""

    @F.pandas_udf(_TRIPLES)
    def read(text):
        return text.map(lambda t: [{"path": p, "property": k, "value": v} for p, k, v in facts(t)])

    scripts = F.filter(html.elements("script"), lambda n: (F.lower(F.trim(html.attr(n, "type"))) == "application/ld+json").eqNullSafe(True))
    keys = [c for c in ("site_id", "run_id", "page_id") if c in pages.columns]
    each = pages.select(*keys, F.col(url).alias("page"), F.posexplode(F.transform(scripts, lambda n: n["text"])).alias("decl", "text"))
    return each.select(*keys, "page", "decl", F.explode(read("text")).alias("t")).select(*keys, "page", "decl", "t.*")
