import random
import re

from pagewright.llm import licences

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall((text or "").encode().lower())
    places = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    return len(words), sorted(places)


def test_hundreds_of_rules():
    found = licences.rules()
    assert 300 <= len(found) and len({r.name for r in found}) == len(found) and all(r.keywords for r in found)


def labels(text):
    return sorted({f["label"] for f in licences.scan([text.encode()])[0][1]})


def test_known_lines():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl", "gpl-3.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc"]
    assert labels("All rights reserved.") == ["reserved"]
    assert labels("// SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert labels('"license": "MPL-2.0"') == ["mpl-2.0"]
    assert labels("see https://creativecommons.org/licenses/by-sa/4.0/") == ["cc-by-sa"]
    assert labels("Mit der Lizenz hat das nichts zu tun, the public gave general praise") == []
    assert labels("\u00a9 2019 Some Firm. All rights reserved.") == ["reserved"]
    assert labels("distributed under the terms of the GNU Lesser General Public License v2.1") == ["gpl", "lgpl-2.1"]


def test_equals_brute_force(docs):
    rng = random.Random(8)
    bits = ["cc", "by", "CC-BY", "General Public\nLicense", "general", "public", "license", "all rights", "reserved", "ALL RIGHTS RESERVED", "é", "x", "\x7f", "cc\x80by", "licensed under", "MIT"]
    texts = [rng.choice([" ", "-", ". "]).join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "cc" + " " * 50_000 + "by", "all rights reserved " * 4000, "word " * 40_000 + "cc by", "cc" * 100_000, "cc " * 60_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by"), (0, texts[0]), (0, texts[0])]
    for r in docs(rows).selectExpr("*", "1 AS finds", "2 AS n_words").select("text", licences.find().alias("f")).collect():
        assert (r.f.n_words, sorted((x.start, x.label) for x in r.f.finds if x.base)) == brute(r.text)
    assert docs([]).select(licences.find()).count() == 0


def test_containment_equals_comparing_all(monkeypatch):
    """What stays is what comparing each find with all kept ones leaves; a text of many finds takes no time."""
    import random
    import time

    from pagewright.llm import licences

    rng = random.Random(5)
    scanner = licences.Scanner()
    words = ["licensed under", "mit", "license", "apache", "2.0", "cc by", "sa 4.0", "gpl", "v3", "all rights reserved", "general public license", "or later", "version 2", "spdx-license-identifier:", "bsd", "3-clause", "x"]
    for _ in range(60):
        text = " ".join(rng.choices(words, k=60)).encode()
        held = {k for k in scanner.keywords if k in text}
        found = [(r, *m.span()) for r in scanner.rules if held.issuperset(r.keywords) for m in r.pattern.finditer(text)]
        found.sort(key=lambda f: (-f[0].priority, f[1] - f[2], -len(f[0].label)))
        kept = []
        for rule, a, b in found:
            if rule.base or not any(x <= a and b <= y for other, x, y in kept if not other.base or other.label == rule.label):
                kept.append((rule, a, b))
        assert scanner.finds(text) == sorted(kept, key=lambda f: (f[1], f[2]))
    long = " ".join(rng.choices(words, k=60_000)).encode()
    begin = time.time()
    assert len(scanner.finds(long)) > 1000 and time.time() - begin < 20
