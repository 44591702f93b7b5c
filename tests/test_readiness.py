"""Passage windows and scores against plain Python."""

import math
import random
import re
import unicodedata

import pytest

from pagewright.operators import readiness as ops

SECTIONS = "page_id long, lang string, section int, heading string, level int, paragraphs array<string>"
POOL = (
    "It is a meter. This method operates at 12 mg per day! CGM measures glucose of 5.5 mmol now. He runs. Many people ask why? Version 3.14 is out here. The Blue Tower contains 40 rooms. They never are there. "
    "Sugar not is the cause of 3 days pain. As mentioned the plan lasts. A b c. Nobody knows… Costs are low. Water must reach 90 % today. These follow. Glucose meters measure sugars."
).split(". ")


def words(text):
    return "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in text).split()


def split(text):
    out, begin, i = [], 0, 0
    while i < len(text):
        if text[i] in ".!?。！？؟…" and not (text[i] == "." and text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit()):
            while i + 1 < len(text) and text[i + 1] in ".!?。！？؟…":
                i += 1
            out.append(text[begin : i + 1])
            begin = i + 1
        i += 1
    return [s.strip() for s in [*out, text[begin:]] if s.strip()]


def opens(text, phrases):
    low = re.sub(r"^[\W_]+", "", text.strip().lower())
    return any(low.startswith(p) and not low[len(p) : len(p) + 1].isalnum() for p in phrases)


def content(text):
    return [w for w in words(text.lower()) if len(w) >= 3]


def says(low, w):
    w = w.lower()
    other = w[:-3] + "y" if w.endswith("ies") else w[:-1] + "ies" if w.endswith("y") else w[:-2] if len(w) > 5 else w
    return w in low or other in low


def facts(text, rules):
    out = []
    for s in split(text):
        tokens = s.split()
        if len(words(s)) < 4 or len(tokens) < 4:
            continue
        at = next((i for i in range(1, len(tokens) - 1) if "".join(c for c in tokens[i].lower() if c.isalpha()) in rules[2]), None)
        if at is None or at > 8:
            continue
        subject = re.sub(r"(?i)\s+(?:(?:does|do|did)\s+not|not|never|nie|bez)$", "", " ".join(tokens[:at]))
        begin = at + 1 + (tokens[at].lower() == "operates" and tokens[at + 1].lower() == "at")
        said = re.sub(r"[.!?]+$", "", " ".join(tokens[begin : begin + 14]))
        if (at == 1 and opens(subject, rules[0])) or not said:
            continue
        unit = re.search(r"(?i)(?:mg|kg|ml|cm|mm|gb|mb|minutes?|hours?|days?|°c|g|l|v|%)(?=\b|\s|$)", said)
        out.append(1.0 if re.search(r"\d", said) and unit else 0.7 if re.search(r"\b[A-Z][\w-]+\b", subject) else 0.3)
    return out


def half_up(x, steps=100):
    return math.floor(x * steps + 0.5) / steps


def score(heading, window, paragraphs, tokens, rules, core=()):
    text = "\n".join(paragraphs)
    s = split(text)
    anchors = list(core) or content(heading)
    lost = pointing = 0
    for i, one in enumerate(s[:2]):
        if opens(one, rules[0]):
            before = content(" ".join(s[:i]))
            lost += not any(says(one.lower(), w) for w in anchors) and not any(says(one.lower(), w) for w in before)
        pointing += sum(bool(re.search(rf"(?i)(?:^|[\W_]){m}(?=$|[\W_])", one)) for m in {*rules[3], "here", "there", "now", "today", "above", "below", "as follows"})
    absent = bool(anchors) and not any(says(text.lower(), w) for w in anchors)
    alone = half_up(max(0.0, 1 - (0.35 * lost + 0.4 * pointing + 0.5 * absent)))
    found = facts(text, rules)
    density = min(1.0, sum(found) / max(len(s) * 1.2, 1))
    opening = " ".join(words(" ".join(paragraphs))[:60])
    if not heading or window:
        answer = None
    elif len(words(opening)) < 8:
        answer = 0.2
    else:
        head, lead = [w for w in content(heading) if w not in ops.HEADING_NOISE], content(opening)
        dot = lambda a, b: sum(a.count(w) * b.count(w) for w in set(a))
        near = max(dot(head, lead) / max(math.sqrt(dot(head, head)) * math.sqrt(dot(lead, lead)), 1), sum(says(opening.lower(), w) for w in head) / len(head)) if head else 1.0
        stated = bool(facts(opening, rules)) or any(c.isdigit() for c in opening)
        answer = half_up(min(1, max(0, 0.6 * near + 0.4 * stated - 0.5 * (opens(opening, rules[1]) or opens(opening, rules[0])))))
    whole = 1.0 if answer is None else answer
    codes = [c for c, on in (("dangling-pronoun", lost), ("deictic-context", pointing), ("no-entity", absent), ("no-answer-first", whole < 0.5), ("filler-opening", opens(paragraphs[0], rules[1])),
                             ("no-facts", not found and tokens >= 20), ("too-long", tokens > 250)) if on]
    return math.floor(100 * (0.4 * alone + 0.35 * density + 0.25 * whole) + 0.5), alone, round(density, 9), answer, len(found), codes


@pytest.fixture(scope="module")
def sections(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        paragraphs = [". ".join(rng.choices(POOL, k=rng.choice([1, 2, 5, 30]))) + rng.choice([".", "", "!"]) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice(["en", "pl", "xx", None]), i % 3, rng.choice(["", "What is glucose", "Blue towers", "The", "Sugars and pain"]), 2, paragraphs))
    rows += [(100, "en", 0, "h", 1, ["word " * 700]), (101, "en", 0, None, 1, [" "]), (102, "en", 0, "x", 1, None)]
    return rows, spark.createDataFrame(rows, SECTIONS)


def test_section_windows(sections):
    rows, frame = sections
    want = []
    for page, _, _, _, _, paragraphs in rows:
        window, out = [], []
        for p in paragraphs or []:
            if window and sum(len(words(x)) for x in window) + len(words(p)) > 300:
                out.append(window)
                window = window[-1:] if len(words(window[-1])) <= 60 else []
            window = [*window, p]
        out += [window] if window else []
        want += [(page, i, w, sum(len(words(x)) for x in w)) for i, w in enumerate(out)]
    got = sorted((r.page_id, r.window, r.paragraphs, r.tokens) for r in ops.section_windows(frame).collect())
    assert got == sorted(want)


def test_sentence_windows_keep_order_size_and_place(sections):
    rows, frame = sections
    got = {}
    for r in ops.sentence_windows(frame).orderBy("page_id", "window").collect():
        got.setdefault(r.page_id, []).append(r)
    for page, _, _, _, _, paragraphs in rows:
        text, mine = "\n\n".join(paragraphs or []), got.get(page, [])
        assert [r.window for r in mine] == list(range(len(mine)))
        if not text.strip():
            assert not mine
            continue
        assert mine[0].start == len(text) - len(text.lstrip()) and mine[-1].end == len(text.rstrip())
        for r, after in zip(mine, [*mine[1:], None]):
            assert text[r.start : r.end] == r.text and r.tokens == len(words(r.text)) <= 250
            sentences = split(r.text)
            assert len(sentences) == 1 or r.tokens <= 180 or r.oversized
            if after is not None:
                assert r.start < after.start <= r.end + 2 or text[r.end : after.start].strip() == ""
                back = len(words(text[after.start : r.end]))
                # at least thirty tokens come again, unless the window is shorter than that
                assert back >= 30 or after.start > r.start and len(words(text[r.start : r.end])) - back <= max(len(words(s)) for s in sentences) or r.oversized
    assert len(got[100]) >= 3 and all(r.oversized for r in got[100])


@pytest.mark.parametrize("mode", ["section", "sentence"])
def test_scores(spark, sections, mode):
    rows, frame = sections
    windows = (ops.section_windows if mode == "section" else ops.sentence_windows)(frame)
    rules = {lang: [part.split("|") for part in lists] for lang, lists in ops.RULES.items()}
    parts = {(r.page_id, r.window): r for r in windows.collect()}
    n = 0
    for r in ops.window_scores(windows, ops.rules_table(spark)).collect():
        w = parts[r.page_id, r.window]
        want = score(w.heading or "", w.window, w.paragraphs, w.tokens, rules.get(w.lang, rules["en"]))
        assert (r.score, r.self_containment, round(r.fact_density, 9), r.answer_first, r.facts, r.codes) == want, w
        n += 1
    assert n == len(parts)


def test_core_terms_replace_the_heading(spark):
    frame = spark.createDataFrame([(1, "en", 0, "Topic", 2, ["The meter is a device of 12 mg. It is small."], ["glucose"]), (2, "en", 0, "Topic", 2, ["Glucose is sugar. It is small."], ["GLUCOSE"])], SECTIONS + ", core_terms array<string>")
    got = {r.page_id: r for r in ops.window_scores(ops.section_windows(frame), ops.rules_table(spark)).collect()}
    assert got[1].no_entity and not got[2].no_entity


def test_page_scores(spark):
    rows = [(1, 0, "", 0, 1, 0, 0, 0), (1, 1, "a", 2, 0, 1, 0, 0), (1, 2, "b", 3, 0, 0, 1, 1), (2, 0, "", 0, 0, 0, 0, 0)]
    sections = spark.createDataFrame(rows, "page_id long, section int, heading string, level int, tables int, ordered_lists int, unordered_lists int, definition_lists int")
    structure = ops.extractability(sections)
    assert {r.page_id: round(r.extractability, 6) for r in structure.collect()} == {1: 0.9, 2: 0.0}
    scored = spark.createDataFrame([(1, 0, 0, 40, 2), (1, 1, 0, 61, 0), (1, 1, 1, 30, 1), (2, 0, 0, 90, 3)], "page_id long, section int, window int, score int, facts int")
    got = {r.page_id: (r.score, r.chunks, r["mean"], r.facts, [tuple(x) for x in r.weak_windows]) for r in ops.page_scores(scored, structure).collect()}
    assert got == {1: (math.floor(0.8 * 131 / 3 + 18 + 0.5), 3, 43.7, 3, [(30, 1, 1), (40, 0, 0)]), 2: (72, 1, 90.0, 3, [])}


def test_windows_do_not_move_to_the_rules_of_their_language(spark):
    sections = spark.createDataFrame([(i, "en", 0, "Boiler pressure", 2, [f"It is now here. The boiler holds {i} bar today. NOW it operates at 5 V.", "ſee Below."]) for i in range(6)] + [(9, None, 0, None, 2, ["Tam jest."]), (10, "xx", 0, "", 2, [])], "doc_id long, lang string, section int, heading string, level int, paragraphs array<string>")
    windows = ops.sentence_windows(sections)
    found = ops.window_scores(windows, ops.rules_table(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(lang" not in plan and "SortMergeJoin" not in plan and plan.count("ArrowEvalPython") == 1
    got = {r.doc_id: (r.dangling_openers, r.deictic_markers) for r in found.collect()}
    assert got == {**{i: (1, 3) for i in range(6)}, 9: (0, 0)}
