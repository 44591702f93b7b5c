"""Licence scans by ordered signature rules.

A rule is a regular expression over the lower-case bytes of a text, gated by keywords that the text must hold, with a
priority. Of overlapping finds the one inside another of at least its priority is dropped; finds of base rules stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from pagewright.llm import words

FOUND = "struct<n_words:bigint,finds:array<struct<label:string,rule:string,start:bigint,n:bigint,weight:double,base:boolean>>>"

_IN, _OUT = r"[0-9a-z\x80-\xff]", r"[^0-9a-z\x80-\xff]"

#: Phrases whose words must stand in a row, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label | words of the name, where ~ stands for an optional "version"/"v" and further marks | identifier | a word any mention holds
_FAMILIES = """
mit | mit(?: x11| expat)? | mit | mit
mit-0 | mit no attribution | mit-0 | attribution
x11 | x11 | x11 | x11
apache-1.1 | apache (?:software )?(?:license )?~1[.]1 | apache-1[.]1 | apache
apache-2.0 | apache (?:software )?(?:license )?~2(?:[.]0)? | apache-2[.]0 | apache
bsd | bsd | bsd | bsd
bsd-2-clause | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd) | bsd-2-clause | bsd
bsd-3-clause | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) | bsd-3-clause | bsd
bsd-4-clause | (?:original bsd|bsd 4 clause|4 clause bsd) | bsd-4-clause | bsd
0bsd | (?:zero clause bsd|0bsd|bsd zero clause) | 0bsd | bsd
isc | isc | isc | isc
gpl-1.0 | (?:gnu )?(?:gpl|general public license) ~1(?:[.]0)? | gpl-1[.]0(?:-only|-or-later)? | gnu
gpl-2.0 | (?:gnu )?(?:gpl|general public license) ~2(?:[.]0)? | gpl-2[.]0(?:-only|-or-later|[+])? | g
gpl-3.0 | (?:gnu )?(?:gpl|general public license) ~3(?:[.]0)? | gpl-3[.]0(?:-only|-or-later|[+])? | g
lgpl | (?:gnu )?(?:lgpl|(?:lesser|library) general public license) | lgpl | g
lgpl-2.1 | (?:gnu )?(?:lgpl|(?:lesser|library) general public license) ~2[.][01] | lgpl-2[.][01](?:-only|-or-later|[+])? | g
lgpl-3.0 | (?:gnu )?(?:lgpl|lesser general public license) ~3(?:[.]0)? | lgpl-3[.]0(?:-only|-or-later|[+])? | g
agpl-3.0 | (?:gnu )?(?:agpl|affero general public license)(?: ~3(?:[.]0)?)? | agpl-3[.]0(?:-only|-or-later|[+])? | a
gfdl | (?:gnu )?(?:gfdl|free documentation license)(?: ~1[.][123])? | gfdl-1[.][123](?:-only|-or-later)? | d
mpl-1.1 | (?:mpl|mozilla public license) ~1[.][01] | mpl-1[.][01] | m
mpl-2.0 | (?:mpl|mozilla public license) ~2(?:[.]0)? | mpl-2[.]0 | m
epl-1.0 | (?:epl|eclipse public license) ~1(?:[.]0)? | epl-1[.]0 | e
epl-2.0 | (?:epl|eclipse public license) ~2(?:[.]0)? | epl-2[.]0 | e
edl-1.0 | eclipse distribution license(?: ~1(?:[.]0)?)? | edl-1[.]0 | eclipse
cddl-1.0 | (?:cddl|common development and distribution license)(?: ~1[.]0)? | cddl-1[.]0 | c
cddl-1.1 | (?:cddl|common development and distribution license) ~1[.]1 | cddl-1[.]1 | c
cpl-1.0 | common public license(?: ~1(?:[.]0)?)? | cpl-1[.]0 | common
cpal-1.0 | common public attribution license(?: ~1(?:[.]0)?)? | cpal-1[.]0 | common
ipl-1.0 | ibm public license(?: ~1(?:[.]0)?)? | ipl-1[.]0 | ibm
spl-1.0 | sun public license(?: ~1(?:[.]0)?)? | spl-1[.]0 | sun
eupl | (?:eupl|european union public licen[cs]e)(?: ~1[.][012])? | eupl-1[.][012] | eu
osl-3.0 | open software license(?: ~[123](?:[.]0)?)? | osl-[123][.]0 | software
afl-3.0 | academic free license(?: ~[123](?:[.][01])?)? | afl-[123][.][01] | academic
artistic | artistic license(?: ~[12](?:[.]0)?)? | artistic-[12][.]0 | artistic
bsl-1.0 | boost software license(?: ~1(?:[.]0)?)? | bsl-1[.]0 | boost
busl-1.1 | business source license(?: ~1[.]1)? | busl-1[.]1 | business
sspl-1.0 | (?:sspl|server side public license)(?: ~1(?:[.]0)?)? | sspl-1[.]0 | s
elastic-2.0 | elastic license(?: ~?2(?:[.]0)?)? | elastic-2[.]0 | elastic
commons-clause | commons clause | commons-clause | commons
unlicense | unlicense | unlicense | unlicense
wtfpl | (?:wtfpl|do what the fuck you want to public license) | wtfpl | w
zlib | zlib(?: libpng)? | zlib | zlib
libpng | libpng | libpng(?:-2[.]0)? | libpng
curl | curl | curl | curl
postgresql | postgresql | postgresql | postgresql
python-2.0 | (?:python software foundation|psf)(?: license)?(?: ~2(?:[.]0)?)? | (?:python-2[.]0|psf-2[.]0) | p
php-3.0 | php license(?: ~3[.]0[01]?)? | php-3[.]0[01]? | php
ruby | ruby | ruby | ruby
openssl | openssl | openssl | openssl
ncsa | (?:ncsa|university of illinois ncsa open source) | ncsa | ncsa
ms-pl | microsoft public license | ms-pl | microsoft
ms-rl | microsoft reciprocal license | ms-rl | microsoft
upl-1.0 | universal permissive license(?: ~1(?:[.]0)?)? | upl-1[.]0 | universal
ofl-1.1 | (?:sil )?open font license(?: ~1[.][01])? | ofl-1[.][01] | font
odbl-1.0 | open (?:data commons )?open database license(?: ~1(?:[.]0)?)? | odbl-1[.]0 | database
odc-by-1.0 | open data commons attribution license(?: ~1(?:[.]0)?)? | odc-by-1[.]0 | data
pddl-1.0 | (?:pddl|public domain dedication and license)(?: ~1(?:[.]0)?)? | pddl-1[.]0 | d
cdla-permissive | community data license agreement permissive(?: ~[12][.]0)? | cdla-permissive-[12][.]0 | community
cdla-sharing | community data license agreement sharing(?: ~1[.]0)? | cdla-sharing-1[.]0 | community
cc0-1.0 | (?:cc0|creative commons zero)(?: ~1(?:[.]0)?)?(?: universal)? | cc0-1[.]0 | c
cc-by-2.0 | (?:cc by|creative commons attribution) ~2[.][05](?: generic)? | cc-by-2[.][05] | c
cc-by-3.0 | (?:cc by|creative commons attribution) ~3[.]0(?: unported)? | cc-by-3[.]0 | c
cc-by-4.0 | (?:cc by|creative commons attribution) ~4[.]0(?: international)? | cc-by-4[.]0 | c
cc-by-sa | (?:cc by sa|creative commons attribution share ?alike)(?: ~[234][.][05])? | cc-by-sa-[234][.][05] | c
cc-by-nc | (?:cc by nc|creative commons attribution non ?commercial)(?: ~[234][.][05])? | cc-by-nc-[234][.][05] | c
cc-by-nd | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: ~[234][.][05])? | cc-by-nd-[234][.][05] | c
cc-by-nc-sa | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: ~[234][.][05])? | cc-by-nc-sa-[234][.][05] | c
cc-by-nc-nd | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: ~[234][.][05])? | cc-by-nc-nd-[234][.][05] | c
open-government | open government licen[cs]e(?: ~[123](?:[.]0)?)? | ogl-uk-[123][.]0 | government
rail | (?:open|responsible ai|bigscience|creativeml open) rail(?: m)? | openrail(?:-m)? | rail
llama | llama(?: [234](?:[.][0-9])?)? community | llama[234](?:[.][0-9])? | llama
vim | vim | vim | vim
tcl | tcl(?: tk)? | tcl | tcl
w3c | w3c(?: software(?: notice)?)? | w3c | w3c
icu | (?:icu|unicode) | (?:icu|unicode-3[.]0) | u
""".strip().split("\n")

#: label | expression | keywords (all must be in the text) | weight: whole signatures that aren't a family's name
_SIGNATURES = """
copyright | copyright (?:c )?(?:19|20)[0-9][0-9] | copyright | 0.6
copyright | c (?:19|20)[0-9][0-9] [^\\n]{0,80}?all rights reserved | reserved | 0.7
public-domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain | public domain | 0.8
public-domain | this (?:work|text|file) is in the public domain | public domain | 0.8
non-commercial | (?:for )?non ?commercial (?:use|purposes) only | commercial | 0.7
proprietary | proprietary and confidential | proprietary confidential | 0.8
proprietary | unauthori[sz]ed (?:copying|use|distribution|reproduction) [^\\n]{0,60}?prohibited | prohibited | 0.7
mit | permission is hereby granted free of charge to any person obtaining a copy | hereby granted | 0.95
isc | permission to use copy modify and or distribute this software for any purpose | permission distribute | 0.9
bsd | redistribution and use in source and binary forms with or without modification | redistribution binary | 0.9
bsd-3-clause | neither the name of [^\\n]{0,80}?may be used to endorse or promote | neither endorse | 0.9
zlib | this software is provided as is without any express or implied warranty in no event will the authors | as warranty authors | 0.8
no-warranty | (?:provided|distributed) as is without (?:any )?warrant(?:y|ies) | warrant | 0.4
unlicense | this is free and unencumbered software released into the public domain | unencumbered | 0.95
gpl-3.0 | gnu org licenses gpl 3 0 | gnu.org licenses | 0.9
gpl-2.0 | gnu org licenses (?:old licenses )?gpl 2 0 | gnu.org licenses | 0.9
lgpl | gnu org licenses (?:old licenses )?lgpl | gnu.org licenses | 0.9
agpl-3.0 | gnu org licenses agpl | gnu.org licenses | 0.9
apache-2.0 | apache org licenses license 2 0 | apache.org licenses | 0.95
mit | opensource org licenses? mit | opensource.org | 0.9
bsd-3-clause | opensource org licenses? bsd 3 clause | opensource.org | 0.9
cc-by-4.0 | creativecommons org licenses by 4 0 | creativecommons.org | 0.95
cc-by-sa | creativecommons org licenses by sa | creativecommons.org | 0.95
cc-by-nc | creativecommons org licenses by nc(?! sa| nd) | creativecommons.org | 0.95
cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons.org | 0.95
cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons.org | 0.95
cc-by-nd | creativecommons org licenses by nd | creativecommons.org | 0.95
cc0-1.0 | creativecommons org publicdomain zero | creativecommons.org | 0.95
mpl-2.0 | mozilla org mpl 2 0 | mozilla.org | 0.9
""".strip().split("\n")

#: priority, weight, keywords, expression around a family's name (N) or identifier (I)
_FORMS = (
    (4, 0.95, "licen under", r"(?:licen[cs]ed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?N(?: public)?(?: licen[cs]e)?(?: ~?[0-9](?:[.][0-9])?)?"),
    (4, 0.98, "spdx", r"spdx license identifier I"),
    (3, 0.9, "licen", r"licen[cs]e (?:is )?I"),
    (2, 0.8, "licen", r"N licen[cs]e(?: ~?[0-9](?:[.][0-9])?)?"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: re.Pattern
    keywords: tuple[bytes, ...]
    priority: int
    weight: float
    base: bool = False


def _compiled(expression: str) -> re.Pattern:
    """Spaces and hyphens stand for anything between words; the find begins and ends with whole words."""
    bits = []
    for inside, bit in re.findall(r"(\[[^\]]*\])|([^\[]+)", expression.strip()):
        bit = bit.replace("-", " ").replace(" ?", "<may>").replace(" ", "<gap>").replace("~", "(?:version<gap>|v<may>)?")
        bit = bit.replace("<may>", f"{_OUT}*").replace("<gap>", f"{_OUT}+")
        bits.append(inside.replace("[.]", rf"{_OUT}").replace("[+]", r"\+") if inside else bit)
    return re.compile(rf"(?<!{_IN})(?:{''.join(bits)})(?!{_IN})".encode("latin-1"))


def rules() -> list[Rule]:
    """All rules, first the base ones, then by falling priority."""
    out = [Rule(f"base:{label}", label, _compiled(phrase), tuple(w.encode() for w in phrase.split()), 9, 0.9, True) for phrase, label in BASE.items()]
    for i, line in enumerate(_SIGNATURES):
        label, expression, keywords, weight = (x.strip() for x in line.split(" | "))
        out.append(Rule(f"signature:{label}:{i}", label, _compiled(expression), tuple(k.encode() for k in keywords.split()), 5, float(weight)))
    for line in _FAMILIES:
        label, name, identifier, word = (x.strip() for x in line.split(" | "))
        for k, (priority, weight, keywords, form) in enumerate(_FORMS):
            expression = form.replace("N", f"(?:{name})").replace("I", f"(?:{identifier})")
            keys = tuple(x.encode() for x in (*keywords.split(), *([word] if len(word) > 2 else [])))
            out.append(Rule(f"family:{label}:{k}", label, _compiled(expression), keys, priority, weight))
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    """The rules with an index of their keywords."""

    def __init__(self, all_rules: list[Rule] | None = None):
        self.rules = rules() if all_rules is None else all_rules
        self.keywords = sorted({r.keywords[0] for r in self.rules} | {k for r in self.rules for k in r.keywords})
        self.gates = sorted({min(r.keywords, key=lambda k: (k not in _COMMON, k)) for r in self.rules})

    def finds(self, text: bytes) -> list[tuple[Rule, int, int]]:
        """(rule, start, end) of what stays, by start, in a lower-case text."""
        if not any(g in text for g in self.gates):
            return []
        held = {k for k in self.keywords if k in text}
        found = [(r, *m.span()) for r in self.rules if held.issuperset(r.keywords) for m in r.pattern.finditer(text)]
        found.sort(key=lambda f: (-f[0].priority, f[1] - f[2], -len(f[0].label)))  # of equal ones the more special name first
        starts = sorted({a for _, a, _ in found})
        kept, own, base = [], Reach(starts), {}
        for rule, a, b in found:
            if not rule.base and (own.covers(a, b) or rule.label in base and base[rule.label].covers(a, b)):
                continue
            kept.append((rule, a, b))
            (base.setdefault(rule.label, Reach(starts)) if rule.base else own).add(a, b)
        return sorted(kept, key=lambda f: (f[1], f[2]))


class Reach:
    """How far intervals reach that start at or before a place: sums over halves of the starts, so each step takes their logarithm."""

    def __init__(self, starts: list[int]):
        self.starts, self.most = starts, [-1] * (len(starts) + 1)

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a) + 1
        while i < len(self.most):
            self.most[i] = max(self.most[i], b)
            i += i & -i

    def covers(self, a: int, b: int) -> bool:
        """Whether an interval that was added holds a..b."""
        i = bisect_left(self.starts, a) + 1
        while i:
            if self.most[i] >= b:
                return True
            i -= i & -i
        return False


#: Words that most licence lines hold: one of each rule's keywords is among them, where that can be.
_COMMON = (b"licen", b"spdx", b"copyright", b"reserved", b"public", b"cc", b"licenses")

_scanner: Scanner | None = None


def scan(texts: list[bytes]) -> list[tuple[int, list[dict]]]:
    """(number of words, finds) of each whole text (UTF-8); a find's start and length count words."""
    global _scanner
    _scanner = _scanner or Scanner()
    out = []
    for lo, hi in words.groups(texts):
        w = words.find(texts[lo:hi], words.ALNUM)
        for t in range(hi - lo):
            text, at, first = texts[lo + t].lower(), int(w.text_at[t]), int(w.first[t])
            finds = []
            for rule, a, b in _scanner.finds(text):
                i, j = np.searchsorted(w.starts, [at + a, at + b])
                finds.append({"label": rule.label, "rule": rule.name, "start": int(i) - first, "n": int(j - i), "weight": rule.weight, "base": rule.base})
            out.append((int(w.first[t + 1]) - first, finds))
    return out


def find(text_col: str = "text") -> Column:
    """A column of the number of words of a whole text and its licence finds in order; null and empty texts have none.

    Finds inside a find of the same or a higher priority are left out; of finds in the same place the longer label stays, and what
    a phrase of the base finds always stays. Time grows with the text's length and its number of finds times its logarithm. Each
    row is judged by itself, repeated ones too; no rows give no rows.
    """

    @F.arrow_udf(FOUND)
    def found(text):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("weight", pa.float64()), ("base", pa.bool_())]))
        rows = [r for a, n in words.cuts(text) for r in scan(words.raw_texts(text.slice(a, n)))]
        words.give_back()
        return pa.StructArray.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], kind)], names=["n_words", "finds"])

    return found(F.col(f"`{text_col}`").cast("string"))
