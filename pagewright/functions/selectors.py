"""Selectors as data: CSS and a part of XPath are read into steps, which become expressions over the node array."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from pagewright.functions.urls import let
from pagewright.sources import html

_NAME = r"[A-Za-z_][\w-]*"
_QUOTED = r"'[^']*'|\"[^\"]*\""


class SelectorError(ValueError):
    """A selector that can't be read."""


@dataclass(frozen=True)
class Test:
    """A condition on an element: kind is attribute, nth or text; ``how`` is the comparison; ``wanted`` False turns it around."""

    kind: str
    name: str = ""
    how: str = ""
    value: str = ""
    wanted: bool = True


@dataclass(frozen=True)
class Step:
    """An element that stands in relation ``before`` (a space, >, + or ~) to one of the step before."""

    before: str
    tag: str
    tests: tuple[Test, ...] = ()


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]
    text: Test | None = None
    ends: str = "element"  # element, text or @attribute


_SIMPLE = re.compile(
    rf"\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>{_QUOTED}|[^\s\]]+)\s*)?\]"
    r"|:(?P<pseudo>first-child|last-child|first-of-type|last-of-type|nth-child\(\s*(?P<nc>\d+)\s*\)|nth-of-type\(\s*(?P<nt>\d+)\s*\))"
    r"|:not\((?P<no>[^()]*)\)"
)


def _unquoted(value: str) -> str:
    return value[1:-1] if value[:1] in "'\"" and value[:1] == value[-1:] and len(value) > 1 else value


def _compound(text: str, before: str) -> Step:
    tag = re.match(rf"\*|{_NAME}", text)
    at, tests = tag.end() if tag else 0, []
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise SelectorError(f"can't read {text[at:]!r}")
        at = m.end()
        if m["no"] is not None:
            inner = _compound(m["no"].strip(), "")
            if len(inner.tests) != 1 or inner.tag != "*":
                raise SelectorError(":not takes one class, id, attribute or place")
            one = inner.tests[0]
            tests.append(Test(one.kind, one.name, one.how, one.value, not one.wanted))
        elif m["cls"]:
            tests.append(Test("attribute", "class", "~=", m["cls"]))
        elif m["id"]:
            tests.append(Test("attribute", "id", "=", m["id"]))
        elif m["attr"]:
            tests.append(Test("attribute", m["attr"].lower(), m["op"] or "", _unquoted(m["val"] or "")))
        else:
            kind = "type" if "type" in m["pseudo"] else "child"
            place = m["nc"] or m["nt"] or ("last" if m["pseudo"].startswith("last") else "1")
            if place == "0":
                raise SelectorError("places count from 1")
            tests.append(Test("nth", kind, "", place))
    if not text:
        raise SelectorError("a step is empty")
    return Step(before, tag.group().lower() if tag else "*", tuple(tests))


def _pieces(text: str, marks: str) -> list[str]:
    """Text cut at the marks that stand outside brackets and quotes, the marks among the pieces."""
    out, depth, quote, piece = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c in marks and not depth:
            out += [piece, c]
            piece = ""
            continue
        piece += c
    if quote or depth:
        raise SelectorError("a bracket or quote stays open")
    return [*out, piece]


def css(query: str) -> list[Path]:
    """The alternatives of a CSS selector: tags, classes, ids, attributes, places and :not, related by space, >, + and ~."""
    found = []
    for part in _pieces(query.strip(), ",")[0::2]:
        tight = re.sub(r"\s+", " ", part.strip())
        steps, before = [], ""
        for piece in _pieces(tight, " >+~"):
            if piece in (">", "+", "~"):
                if before.strip() or not steps:
                    raise SelectorError(f"nothing stands before {piece!r}")
                before = piece
            elif piece == " ":
                before = before or " "
            elif piece:
                steps.append(_compound(piece, before or " "))
                before = ""
        if not steps or before.strip():
            raise SelectorError("a step is empty")
        found.append(Path(tuple(steps)))
    return found


_PREDICATES = (
    (rf"@({_NAME})", lambda m: Test("attribute", m[1].lower())),
    (rf"@({_NAME})\s*=\s*({_QUOTED})", lambda m: Test("attribute", m[1].lower(), "=", _unquoted(m[2]))),
    (rf"@({_NAME})\s*!=\s*({_QUOTED})", lambda m: (Test("attribute", m[1].lower()), Test("attribute", m[1].lower(), "=", _unquoted(m[2]), False))),
    (rf"starts-with\(\s*@({_NAME})\s*,\s*({_QUOTED})\s*\)", lambda m: Test("attribute", m[1].lower(), "^=", _unquoted(m[2]))),
    (rf"contains\(\s*@({_NAME})\s*,\s*({_QUOTED})\s*\)", lambda m: Test("attribute", m[1].lower(), "*=", _unquoted(m[2]))),
    (rf"not\(\s*@({_NAME})\s*\)", lambda m: Test("attribute", m[1].lower(), wanted=False)),
    (r"(?:position\(\)\s*=\s*)?([1-9]\d*)", lambda m: Test("nth", "type", "", m[1])),
    (r"(?:position\(\)\s*=\s*)?last\(\)", lambda m: Test("nth", "type", "", "last")),
    (rf"contains\(\s*(?:text\(\)|\.)\s*,\s*({_QUOTED})\s*\)", lambda m: Test("text", "", "*=", _unquoted(m[1]))),
    (rf"contains\(\s*normalize-space\((?:text\(\)|\.)\)\s*,\s*({_QUOTED})\s*\)", lambda m: Test("text", "normal", "*=", _unquoted(m[1]))),
    (rf"text\(\)\s*=\s*({_QUOTED})", lambda m: Test("text", "", "=", _unquoted(m[1]))),
    (rf"normalize-space\((?:text\(\)|\.)\)\s*=\s*({_QUOTED})", lambda m: Test("text", "normal", "=", _unquoted(m[1]))),
)


def xpath(query: str) -> list[Path]:
    """An XPath of steps by / and // with predicates on attributes, places and, once, text; ends in an element, text() or @attribute.

    The first step may be any element of its name, wherever the path starts.
    """
    text, ends = query.strip(), "element"
    if m := re.search(rf"/@({_NAME})$", text):
        text, ends = text[: m.start()], "@" + m[1].lower()
    elif text.endswith("/text()"):
        text, ends = text[: -len("/text()")], "text"
    if not re.match(r"\.?/", text):
        raise SelectorError("an XPath starts with /, // or .")
    steps, about, before, last = [], None, ">", ""
    pieces = _pieces(text.lstrip("."), "/")
    for piece in pieces[1:]:
        if piece == "/":
            before = " " if last == "" else ">"
        elif piece:
            m = re.match(rf"(\*|{_NAME})((?:\[.*\])?)$", piece.strip(), re.S)
            if not m:
                raise SelectorError(f"can't read the step {piece!r}")
            tests = []
            raws = re.findall(rf"\[((?:{_QUOTED}|[^\]'\"])*)\]", m[2])
            if "".join(f"[{raw}]" for raw in raws) != m[2]:
                raise SelectorError(f"can't read the step {piece!r}")
            for raw in raws:
                for part in re.split(r"\s+and\s+", raw.strip()):
                    made = next((make(x) for pattern, make in _PREDICATES if (x := re.fullmatch(pattern, part.strip(), re.S))), None)
                    if made is None:
                        raise SelectorError(f"can't read the predicate {part!r}")
                    for one in made if isinstance(made, tuple) else (made,):
                        if one.kind != "text":
                            tests.append(one)
                        elif about or " and " in raw:
                            raise SelectorError("one predicate on text is allowed, by itself")
                        else:
                            about = one
            steps.append(Step(before if steps else " ", m[1].lower(), tuple(tests)))
        last = piece
    if not steps:
        raise SelectorError("the path names no element")
    return [Path(tuple(steps), about, ends)]


def _compare(value: Column, how: str, wanted: str) -> Column:
    if how == "":
        return value.isNotNull()
    if how == "~=":
        return F.array_contains(F.split(value, r"\s+"), wanted) if wanted else F.lit(False)
    if how == "|=":
        return (value == wanted) | value.startswith(wanted + "-")
    if how == "=":
        return value == wanted
    if not wanted:
        return F.lit(False)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[how](wanted)


def _fits(step: Step, n: Column, elements: Column) -> Column:
    ok = F.lit(True) if step.tag == "*" else n["tag"] == step.tag
    for t in step.tests:
        if t.kind == "attribute":
            hit = F.coalesce(_compare(html.attr(n, t.name), t.how, t.value), F.lit(False))
        else:
            last = t.value == "last"
            alike = lambda s: (s["parent"] == n["parent"]) & ((s["pos"] > n["pos"]) if last else (s["pos"] < n["pos"]))  # noqa: B023, E731
            near = F.filter(elements, lambda s: alike(s) & (s["tag"] == n["tag"])) if t.name == "type" else F.filter(elements, alike)
            hit = F.size(near) == (0 if last else int(t.value) - 1)
        ok = ok & (hit if t.wanted else ~hit)
    return ok


def _related(step: Step, n: Column, earlier: Column, elements: Column) -> Column:
    if step.before == ">":
        return F.exists(earlier, lambda s: s["pos"] == n["parent"])
    if step.before == " ":
        return F.exists(earlier, lambda s: (s["pos"] < n["pos"]) & (n["pos"] <= s["last"]))
    beside = lambda s: (s["parent"] == n["parent"]) & (s["pos"] < n["pos"])
    if step.before == "~":
        return F.exists(earlier, beside)
    between = lambda s: F.exists(elements, lambda m: (m["parent"] == n["parent"]) & (m["pos"] > s["pos"]) & (m["pos"] < n["pos"]))
    return F.exists(earlier, lambda s: beside(s) & ~between(s))


def text_of(n: Column, nodes: Column) -> Column:
    """All text inside an element, as it stands."""
    inside = F.filter(nodes, lambda t: (t["tag"] == "#text") & (t["pos"] > n["pos"]) & (t["pos"] <= n["last"]))
    return F.array_join(F.transform(inside, lambda t: t["text"]), "")


def selected(path: Path, nodes: Column) -> Column:
    """The elements of a node array that a path leads to, in page order."""
    def walk(elements: Column, steps: tuple[Step, ...], earlier: Column | None) -> Column:
        step, rest = steps[0], steps[1:]
        found = F.filter(elements, lambda n: _fits(step, n, elements) if earlier is None else _fits(step, n, elements) & _related(step, n, earlier, elements))
        return let(found, lambda now: walk(elements, rest, now)) if rest else found

    found = let(F.filter(nodes, lambda n: n["tag"] != "#text"), lambda elements: walk(elements, path.steps, None))
    if path.text is None:
        return found

    def says(n: Column) -> Column:
        text = text_of(n, nodes)
        text = F.trim(F.regexp_replace(text, r"\s+", " ")) if path.text.name else F.regexp_replace(text, r"^\s+|\s+$", "")
        return F.coalesce(_compare(text, path.text.how, path.text.value), F.lit(False)) if path.text.value or path.text.how == "=" else F.lit(True)

    return F.filter(found, says)


def selected_by_any(paths: list[Path], nodes: Column) -> Column:
    """The elements that any of the alternatives leads to, each once, in page order."""
    if len(paths) == 1:
        return selected(paths[0], nodes)
    places = F.array_distinct(F.flatten(F.array(*[F.transform(selected(p, nodes), lambda n: n["pos"]) for p in paths])))
    return let(places, lambda p: F.filter(nodes, lambda n: F.array_contains(p, n["pos"])))
