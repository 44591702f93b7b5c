"""Passage readiness: windows of sections, and how well each stands alone, states facts and answers first."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions.urls import let

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Openers that point back, openers that delay, verbs of facts and words that point at a place or time.
# Other languages, or other lists, are rows of the caller's own table.
RULES = {
    "en": (
        "it|this|that|these|those|they|he|she|such|the latter|the former|the above|this method|this process|this approach|this value|the aforementioned|its|their",
        "as mentioned|as we said|as already|as noted|as discussed|as previously|many people|there are many|it is well known|in today|when it comes to|let us|let's|before we|in this article|you may wonder|this question",
        "is|are|was|were|means|equals|contains|requires|causes|reduces|increases|measure|measures|lasts|costs|should|must|ranges|operates",
        "here|there|now|today|above|below|as follows",
    ),
    "pl": (
        "to|ten|ta|te|tego|tej|tym|tych|ona|on|oni|one|ono|powyższy|powyższa|powyższe|wspomniany|wspomniana|wspomniane|taki|taka|takie|jego|jej|ich|wartość ta|kwestia ta|metoda ta|proces ten",
        "jak już|jak wspomniano|jak wcześniej|jak pisaliśmy|jak wiadomo|wiele osób|istnieje wiele|kwestia ta|w dzisiejszych czasach|jeśli chodzi o|zacznijmy|w tym artykule|przed przejściem",
        "jest|są|był|była|było|wynosi|oznacza|powoduje|zawiera|wymaga|zmniejsza|zwiększa|mierzy|trwa|kosztuje|powinien|powinna|powinno|należy|stanowi|służy",
        "tutaj|tam|teraz|dziś|powyżej|poniżej|jak następuje",
    ),
}
HEADING_NOISE = ("a", "an", "the", "is", "are", "was", "were", "what", "how", "why", "when", "where", "does", "do", "to", "of")
UNIT = r"(?i)(?:mg|kg|ml|cm|mm|gb|mb|minutes?|hours?|days?|°c|g|l|v|%)(?=\b|\s|$)"

_ENDS = "[.!?。！？؟…]"
_BREAK = rf"(?<={_ENDS})(?!{_ENDS})(?!(?<=\d\.)\d)"
_STRIP = r"^\s+|\s+$"
_RUN = re.compile(_ENDS + "+")


def _c(name: str) -> Column:
    return F.col(name)


def rules_table(spark: SparkSession, rules: dict[str, tuple[str, str, str, str]] = RULES) -> DataFrame:
    """(lang, dangling, filler, relations, deictic): one row a language, each list an array."""
    rows = [(lang, *[part.split("|") for part in lists]) for lang, lists in rules.items()]
    return spark.createDataFrame(rows, "lang string, dangling array<string>, filler array<string>, relations array<string>, deictic array<string>")


# --- windows -------------------------------------------------------------------------------------------------

def words(text: Column) -> Column:
    """Runs between blanks once punctuation is taken out."""
    return F.filter(F.split(F.regexp_replace(text, r"[\p{P}\p{S}]", " "), r"\s+"), lambda w: w != "")


def section_windows(sections: DataFrame, most: int = 300, carried: int = 60) -> DataFrame:
    """Sections ``(…, section, heading, level, paragraphs)`` cut at paragraphs into windows of about ``most`` tokens.

    A window is closed before the paragraph that would make it longer; its last paragraph is repeated in the next one if it
    has at most ``carried`` tokens. A paragraph is never cut. The fold runs over the paragraphs inside each row.
    """
    item = "struct<p:string,n:int>"
    items = F.transform("paragraphs", lambda p: F.struct(p.alias("p"), F.size(words(p)).alias("n")))
    total = lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + x["n"])

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["w"]) > 0) & (total(acc["w"]) + x["n"] > most)
        last = F.slice(acc["w"], -1, 1)
        kept = F.when(total(last) <= carried, last).otherwise(F.array().cast(f"array<{item}>"))
        return F.when(full, F.struct(F.concat(acc["out"], F.array(acc["w"])).alias("out"), F.concat(kept, F.array(x)).alias("w"))).otherwise(F.struct(acc["out"].alias("out"), F.concat(acc["w"], F.array(x)).alias("w")))

    start = F.struct(F.array().cast(f"array<array<{item}>>").alias("out"), F.array().cast(f"array<{item}>").alias("w"))
    folded = F.aggregate(items, start, step, lambda a: F.when(F.size(a["w"]) > 0, F.concat(a["out"], F.array(a["w"]))).otherwise(a["out"]))
    rest = [c for c in sections.columns if c != "paragraphs"]
    rows = sections.withColumn("_w", folded).select(*rest, F.posexplode("_w").alias("window", "_p"))
    return rows.select(*rest, "window", F.transform("_p", lambda x: x["p"]).alias("paragraphs"), F.array_join(F.transform("_p", lambda x: x["p"]), "\n").alias("text"), total(_c("_p")).alias("tokens"))


_WINDOW = "array<struct<start:int,end:int,text:string,tokens:int,oversized:boolean>>"
_ARROW_WINDOW = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("tokens", pa.int32()), ("oversized", pa.bool_())])
_WORD = re.compile(r"\S+")


def _size(text: str) -> int:
    import unicodedata

    return len("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in text).split())


def _spans(text: str, most: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, tokens, cut) of the sentences; one of more than ``most`` tokens is cut after so many words."""
    marks = [m.end() for m in _RUN.finditer(text) if not (m.group() == "." and m.start() and text[m.start() - 1].isdigit() and text[m.end() : m.end() + 1].isdigit())]
    out, begin = [], 0
    for end in [*marks, len(text)]:
        raw, at = text[begin:end], begin
        begin = end
        if not raw.strip():
            continue
        a = at + len(raw) - len(raw.lstrip())
        b = a + len(raw.strip())
        n = _size(text[a:b])
        if n <= most:
            out.append((a, b, n, False))
            continue
        found = [(m.start() + a, m.end() + a) for m in _WORD.finditer(text[a:b])]
        for i in range(0, len(found), most):
            first, last = found[i][0], found[min(i + most, len(found)) - 1][1]
            out.append((first, last, _size(text[first:last]), True))
    return out


def _sentence_windows(paragraphs: list[str], target: int, most: int, carried: int) -> list[dict]:
    text = "\n\n".join(paragraphs)
    spans, out, start = _spans(text, most), [], 0
    while start < len(spans):
        end, n = start, 0
        while end < len(spans) and (end == start or n + spans[end][2] <= min(target, most)):
            n += spans[end][2]
            end += 1
            if spans[end - 1][2] > most:
                break
        a, b = spans[start][0], spans[end - 1][1]
        out.append({"start": a, "end": b, "text": text[a:b], "tokens": _size(text[a:b]), "oversized": any(s[3] for s in spans[start:end])})
        if end >= len(spans):
            break
        back, again = 0, end
        while again > start and back < carried:
            again -= 1
            back += spans[again][2]
        start = max(start + 1, again)
    return out


def sentence_windows(sections: DataFrame, target: int = 180, most: int = 250, carried: int = 30) -> DataFrame:
    """Sections cut at sentences into windows of about ``target`` tokens with the places of their letters in the section's text.

    The section's text is its paragraphs with an empty line between. A window begins with the last sentences of the one before that
    have ``carried`` tokens together. A sentence of more than ``most`` tokens is cut after that many words and marked.
    """
    @F.arrow_udf(_WINDOW)
    def cut(paragraphs: pa.Array) -> pa.Array:
        return pa.array((_sentence_windows([x or "" for x in p.as_py() or []], target, most, carried) for p in paragraphs), type=pa.list_(_ARROW_WINDOW))

    rest = [c for c in sections.columns if c != "paragraphs"]
    # Called so, the planner doesn't cut a text twice, once to see whether it has windows.
    rows = sections.withColumn("_w", cut.asNondeterministic()("paragraphs")).select(*rest, F.posexplode("_w").alias("window", "w"))
    return rows.select(*rest, "window", F.array("w.text").alias("paragraphs"), "w.text", "w.tokens", "w.start", "w.end", "w.oversized")


# --- scores --------------------------------------------------------------------------------------------------

def sentences(text: Column) -> Column:
    """Trimmed sentences; a point between digits doesn't end one."""
    return F.filter(F.transform(F.split(text, _BREAK), lambda s: F.regexp_replace(s, _STRIP, "")), lambda s: s != "")


def _opens_with(text: Column, phrases: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+", "")
    return let(low, lambda x: F.exists(phrases, lambda p: x.startswith(p) & ~F.substring(x, F.length(p) + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")))


def _content(text: Column) -> Column:
    return F.filter(words(F.lower(text)), lambda w: F.length(w) >= 3)


def _mentions(low: Column, word: Column) -> Column:
    """Whether a lower-case text holds a word in one of its forms."""
    w = F.lower(word)
    other = (
        F.when(w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y")))
        .when(w.endswith("y"), F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("ies")))
        .when(F.length(w) > 5, F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w)
    )
    return low.contains(w) | low.contains(other)


def _fact(sentence: Column, relations: Column, dangling: Column) -> Column:
    """The quality of the fact that a sentence states by a verb of ``relations``, null if it states none: 1 with a measured
    value, .7 about something named, else .3."""
    def stated(tokens: Column) -> Column:
        verbs = F.transform(tokens, lambda t, i: F.when((i > 0) & (i < F.size(tokens) - 1) & F.array_contains(relations, F.regexp_replace(F.lower(t), r"[^\p{L}]", "")), i))
        return let(F.array_min(F.filter(verbs, lambda i: i.isNotNull())), lambda at: judged(tokens, at))

    def judged(tokens: Column, at: Column) -> Column:
        word = lambda i: F.lower(F.coalesce(F.get(tokens, i), F.lit("")))
        begin = at + 1 + ((word(at) == "operates") & (word(at + 1) == "at")).cast("int")
        subject = F.regexp_replace(F.array_join(F.slice(tokens, F.lit(1), at), " "), r"(?i)\s+(?:(?:does|do|did)\s+not|not|never|nie|bez)$", "")
        said = F.regexp_replace(F.array_join(F.slice(tokens, begin + 1, F.lit(14)), " "), r"[.!?]+$", "")
        quality = F.when(said.rlike(r"\d") & said.rlike(UNIT), 1.0).when(subject.rlike(r"\b[A-Z][\p{L}\d-]+\b"), 0.7).otherwise(0.3)
        ok = (at <= 8) & ~((at == 1) & _opens_with(subject, dangling)) & (said != "")
        return F.when(ok, quality)

    tokens = F.filter(F.split(sentence, r"\s+"), lambda t: t != "")
    return F.when((F.size(words(sentence)) >= 4) & (F.size(tokens) >= 4), let(tokens, stated))


def _facts(text: Column) -> Column:
    return F.filter(F.transform(sentences(text), lambda s: _fact(s, _c("relations"), _c("dangling"))), lambda q: q.isNotNull())


def _rounded(x: Column, steps: int = 100) -> Column:
    return F.floor(x * steps + 0.5) / steps


def window_scores(windows: DataFrame, rules: DataFrame, fallback: str = "en") -> DataFrame:
    """0-100 for each window, with its parts and issue codes: .40 stands alone, .35 states facts, .25 answers first.

    ``windows(…, lang, heading, window, paragraphs, text, tokens)``, and ``core_terms`` if the words that a passage has to name
    are known; else they are the heading's. A language without rules takes those of ``fallback``. Text without spaces between words
    isn't split. Rules are a row a language and go to every task: most windows may be of one language, which no join by it would
    spread.
    """
    known = windows if "core_terms" in windows.columns else windows.withColumn("core_terms", F.array().cast("array<string>"))
    other = rules.where(_c("lang") == fallback).select(*[_c(c).alias(f"_{c}") for c in ("dangling", "filler", "relations", "deictic")])
    names = ("dangling", "filler", "relations", "deictic")
    joined = known.join(F.broadcast(rules), "lang", "left").join(F.broadcast(other.limit(1)), F.lit(True), "left")
    rows = joined.select(*known.columns, *[F.coalesce(n, f"_{n}", F.array().cast("array<string>")).alias(n) for n in names])
    heading = F.coalesce("heading", F.lit(""))
    rows = rows.withColumn("_s", sentences(_c("text"))).withColumn("_anchors", F.when(F.size("core_terms") > 0, _c("core_terms")).otherwise(_content(heading)))

    first, second = F.coalesce(F.get("_s", F.lit(0)), F.lit("")), F.coalesce(F.get("_s", F.lit(1)), F.lit(""))
    named = lambda s, terms: let(F.lower(s), lambda low: F.exists(terms, lambda w: _mentions(low, w)))
    lost = lambda s, *more: (_opens_with(s, _c("dangling")) & ~named(s, _c("_anchors")) & (~named(s, more[0]) if more else F.lit(True))).cast("int")
    dangling = lost(first) + F.when(second != "", lost(second, _content(first))).otherwise(0)
    markers = F.array_distinct(F.concat("deictic", F.array(*[F.lit(w) for w in ("here", "there", "now", "today", "above", "below", "as follows")])))
    # A pattern is made only for a marker that stands somewhere in the sentence, whatever the case of its letters.
    any_case = lambda x: F.lower(F.upper(F.translate(x, "İ", "i")))
    marked = lambda s, m: F.regexp_like(s, F.concat(F.lit(r"(?iu)(?:^|[^\p{L}\p{N}])\Q"), m, F.lit(r"\E(?=$|[^\p{L}\p{N}])")))
    pointing = lambda s: let(any_case(s), lambda low: F.size(F.filter(markers, lambda m: low.contains(any_case(m)) & marked(s, m))))
    missing = (F.size("_anchors") > 0) & ~named(_c("text"), _c("_anchors"))
    rows = rows.withColumn("dangling_openers", dangling).withColumn("deictic_markers", pointing(first) + pointing(second)).withColumn("no_entity", missing)
    alone = F.greatest(F.lit(0.0), 1 - (0.35 * _c("dangling_openers") + 0.4 * _c("deictic_markers") + 0.5 * _c("no_entity").cast("int")))

    facts = _facts(_c("text"))
    opening = F.array_join(F.slice(words(F.array_join("paragraphs", " ")), 1, 60), " ")
    rows = rows.withColumn("_f", facts).withColumn("_o", opening)
    sure = F.aggregate("_f", F.lit(0.0), lambda a, q: a + q)
    density = F.least(F.lit(1.0), sure / F.greatest(F.size("_s") * 1.2, F.lit(1.0)))

    about = F.filter(_content(heading), lambda w: ~w.isin(*HEADING_NOISE))
    lead = _content(_c("_o"))
    counts = lambda words_, of: F.size(F.filter(words_, lambda w: w == of)).cast("double")
    dot = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0.0), lambda s, w: s + counts(a, w) * counts(b, w))
    cosine = dot(about, lead) / F.greatest(F.sqrt(dot(about, about)) * F.sqrt(dot(lead, lead)), F.lit(1.0))
    shared = let(F.lower("_o"), lambda low: F.size(F.filter(about, lambda w: _mentions(low, w))) / F.size(about))
    similarity = F.when(F.size(about) > 0, F.greatest(cosine, shared)).otherwise(1.0)
    declared = (F.size(_facts(_c("_o"))) > 0) | _c("_o").rlike(r"\d")
    fluff = _opens_with(_c("_o"), _c("filler")) | _opens_with(_c("_o"), _c("dangling"))
    answered = _rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * similarity + 0.4 * declared.cast("int") - 0.5 * fluff.cast("int"))))
    applies = (heading != "") & (_c("window") == 0)
    answer = F.when(~applies, F.lit(None).cast("double")).when(F.size(words(_c("_o"))) < 8, 0.2).otherwise(answered)
    rows = rows.withColumn("self_containment", _rounded(alone)).withColumn("fact_density", density).withColumn("answer_first", answer).withColumn("facts", F.size("_f"))

    whole = F.coalesce("answer_first", F.lit(1.0))
    score = F.floor(100 * (0.4 * _c("self_containment") + 0.35 * _c("fact_density") + 0.25 * whole) + 0.5).cast("int")
    codes = F.array_compact(F.array(
        F.when(_c("dangling_openers") > 0, "dangling-pronoun"), F.when(_c("deictic_markers") > 0, "deictic-context"), F.when(_c("no_entity"), "no-entity"), F.when(whole < 0.5, "no-answer-first"),
        F.when(_opens_with(F.coalesce(F.get("paragraphs", F.lit(0)), F.lit("")), _c("filler")), "filler-opening"), F.when((_c("facts") == 0) & (_c("tokens") >= 20), "no-facts"), F.when(_c("tokens") > 250, "too-long"),
    ))
    kept = [c for c in windows.columns if c not in ("paragraphs", "text", "core_terms")]
    return rows.select(*kept, score.alias("score"), "self_containment", "fact_density", "answer_first", "facts", "dangling_openers", "deictic_markers", "no_entity", codes.alias("codes"))


def extractability(sections: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, extractability): .30 tables, .25 ordered lists, .15 short list items, .10 definitions, .20 an outline of four headings.

    A table counts if it has header cells, an ordered list if the heading or the paragraph before it gives an instruction, list
    items if each has fewer than 35 words; where a section table doesn't say so, the elements by themselves count.
    """
    has = lambda name, otherwise: _c(name) if name in sections.columns else F.lit(otherwise)
    tables = (_c("tables") > 0) & has("table_headers", True)
    ordered = (_c("ordered_lists") > 0) & has("list_instruction", True)
    short = (_c("unordered_lists") + _c("definition_lists") > 0) & has("short_items", True)
    any_of = lambda c: F.max(c.cast("int"))
    outline = F.least(F.lit(1.0), F.count_if(_c("level").isin(2, 3)) / 4)
    value = 0.3 * any_of(tables) + 0.25 * any_of(ordered) + 0.15 * any_of(short) + 0.1 * any_of(_c("definition_lists") > 0) + 0.2 * outline
    return sections.groupBy(key).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("extractability"))


def page_scores(scored: DataFrame, structure: DataFrame, key: str = "page_id", weak: int = 50, shown: int = 5) -> DataFrame:
    """(key, score, chunks, mean, extractability, facts, weak_windows): .80 mean window score and .20 extractability.

    ``weak_windows`` are the worst under ``weak``, at most ``shown``, as (score, section, window).
    """
    worst = F.slice(F.array_sort(F.collect_list(F.when(_c("score") < weak, F.struct("score", "section", "window")))), 1, shown)
    per = scored.groupBy(key).agg(F.count("*").alias("chunks"), F.avg("score").alias("mean"), F.sum("facts").alias("facts"), worst.alias("weak_windows"))
    rows = per.join(structure, key)
    return rows.select(key, F.floor(0.8 * _c("mean") + 20 * _c("extractability") + 0.5).cast("int").alias("score"), "chunks", _rounded(_c("mean"), 10).alias("mean"), "extractability", "facts", "weak_windows")
