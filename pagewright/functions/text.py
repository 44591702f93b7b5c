"""Text column functions; all stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Default function words. Callers with a full list per language pass it as a parameter.
STOPWORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "but", "by", "can", "could", "do", "for", "from", "had", "has", "have", "he", "her", "his", "how", "if", "in",
    "into", "is", "it", "its", "more", "most", "no", "not", "of", "on", "one", "only", "or", "other", "our", "out",
    "over", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they",
    "this", "those", "to", "under", "up", "was", "we", "were", "what", "when", "where", "which", "while", "who",
    "will", "with", "would", "you", "your",
)

# Marker words that vote for a language.
LANGUAGE_MARKERS = {
    "en": ("the", "and", "with", "from", "this", "that"),
    "pl": ("jest", "oraz", "się", "dla", "który", "które", "może", "mogą"),
    "de": ("und", "der", "die", "das", "mit", "nicht", "eine"),
    "es": ("que", "para", "con", "una", "los", "las", "del", "está"),
    "fr": ("les", "des", "pour", "avec", "dans", "une", "est"),
    "it": ("gli", "che", "una", "per", "con", "sono", "della"),
    "pt": ("uma", "para", "com", "que", "dos", "das", "não"),
    "ru": ("это", "для", "что", "как", "или", "при", "есть"),
}

# Polish endings, longest first.
POLISH_ENDINGS = (
    "iami", "iach", "ami", "ach", "iom", "iem", "ego", "emu", "ych", "ich", "ymi", "imi", "owi", "om", "ow", "em",
    "ie", "ia", "ii", "iu", "ym", "im", "ej", "a", "e", "i", "o", "u", "y",
)
POLISH_STEM = 4
SENTENCE_BREAK = r"(?<=[.!?…。！？])\s+|(?<=[。！？])"
WORD = r"[\p{L}\p{N}]+"


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks -> base letter, from the Unicode decomposition; single-letter results only."""
    plain = {"ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ø": "o"}
    for point in range(0xC0, 0x250):
        ch = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
        if len(base) == 1 and base != ch and base.isascii() and base.isalpha():
            plain.setdefault(ch, base)
    return "".join(plain), "".join(plain.values())


_FROM, _TO = _fold_table()


def fold(text: Column, lang: Column | None = None) -> Column:
    """Lower case without diacritics; German umlauts become digraphs where ``lang`` is German."""
    low = F.lower(text)
    if lang is not None:
        digraphs = low
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
            digraphs = F.replace(digraphs, F.lit(a), F.lit(b))
        low = F.when(primary_language(lang) == "de", digraphs).otherwise(low)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.trim(F.translate(F.regexp_replace(low, r"[̀-ͯ]", ""), _FROM, _TO))


def primary_language(lang: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^([^\-_]*)", 1)))


def term_key(term: Column, lang: Column) -> Column:
    """Comparison key of one word: folded, with the regular inflection of Polish or English removed."""
    return _folded_key(fold(term, lang), primary_language(lang))


def _folded_key(folded: Column, code: Column) -> Column:
    endings = "|".join(POLISH_ENDINGS)
    # The regex alternation tries endings in the listed order and needs a stem of four letters before them.
    polish = F.regexp_replace(folded, rf"^(.{{{POLISH_STEM},}}?)(?:{endings})$", "$1")
    english = (
        F.when((F.length(folded) > 4) & folded.endswith("ies"), F.regexp_replace(folded, "ies$", "y"))
        .when((F.length(folded) >= 5) & folded.rlike("[^aeiousy]s$"), F.regexp_replace(folded, "s$", ""))
        .otherwise(folded)
    )
    return F.when(code == "pl", polish).when(code == "en", english).otherwise(folded)


def term_identity(term: Column, lang: Column) -> Column:
    code = primary_language(lang)
    return F.concat(F.when(code == "", F.lit("und")).otherwise(code), F.lit(":"), term_key(term, lang))


def is_noise(folded: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Stop word, fewer than two letters, or at least as many digits as letters."""
    letters, digits = F.regexp_count(folded, F.lit(r"\p{L}")), F.regexp_count(folded, F.lit(r"\p{N}"))
    # Most words are letters alone; only the others are counted.
    return folded.isin(*stopwords) | F.when(folded.rlike(r"^\p{L}{2,}$"), False).otherwise((letters < 2) | (digits >= letters))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def word_keys(text: Column, lang: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The term key of each word in text order, null where it is noise; the words of a text are folded all at once."""
    def of(t: Column) -> Column:
        key = lambda w: F.when(~is_noise(w["plain"], stopwords), _folded_key(w["own"], t["code"]))
        # Words hold no blanks and fold to none.
        each = F.arrays_zip(F.split(fold(t["line"]), " ").alias("plain"), F.split(fold(t["line"], lang), " ").alias("own"))
        return F.when(t["line"] != "", F.transform(each, key)).otherwise(F.array().cast("array<string>"))

    given = F.struct(F.array_join(words(text), " ").alias("line"), primary_language(lang).alias("code"))
    return F.get(F.transform(F.array(given), of), F.lit(0))


def content_keys(text: Column, lang: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Term keys of the words that are not noise, in text order."""
    kept = F.filter(words(text), lambda w: ~is_noise(fold(w), stopwords))
    return F.transform(kept, lambda w: term_key(w, lang))


def phrase_key(phrase: Column, lang: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Joined keys of a free phrase; null where every word is noise."""
    keys = content_keys(phrase, lang, stopwords)
    return F.when(F.size(keys) > 0, F.array_join(keys, " "))


def ngrams(items: Column, n: int) -> Column:
    """Consecutive runs of n items, joined by a blank."""
    last = F.size(items) - (n - 1)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(items, i, F.lit(n)), " ")
    )
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def sentences(text: Column, newlines: bool = False) -> Column:
    """Trimmed, non-empty sentences; decimals stay whole."""
    pattern = SENTENCE_BREAK + (r"|\n" if newlines else "")
    trimmed = F.transform(F.split(text, pattern), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def syllables(word: Column) -> Column:
    """Vowel groups, a silent final e taken off, at least one."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouyąęóàèìòù]+"))
    silent = (F.length(low) > 2) & low.endswith("e") & (groups > 1) & ~low.endswith("le")
    return F.greatest(groups - silent.cast("int"), F.lit(1))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def readability(lang: Column, n_words: Column, n_sentences: Column, n_syllables: Column) -> tuple[Column, Column, Column]:
    """(ease 0-100, grade, method) of the Flesch family; null without sentences or words."""
    wps = F.try_divide(n_words.cast("double"), n_sentences)
    spw = F.try_divide(n_syllables.cast("double"), n_words)
    code = F.coalesce(lang, F.lit("en"))
    grade = 0.39 * wps + 11.8 * spw - 15.59
    english = 206.835 - 1.015 * wps - 84.6 * spw
    ease = (
        F.when(code == "pl", 206.835 - 0.65 * wps - 62.3 * spw)
        .when(code == "es", 206.84 - 1.02 * wps - 60.0 * spw)
        .when(code == "fr", 207.0 - 1.015 * wps - 73.6 * spw)
        .otherwise(english)
    )
    known = code.isin("pl", "es", "fr", "en")
    capped = (
        F.when(code == "pl", clamp(0.4 * (wps + 100.0 * spw), 0, 100))
        .when(known, clamp(grade, 0, 100))
        .otherwise(F.greatest(grade, F.lit(0.0)))
    )
    usable = (n_sentences > 0) & (n_words > 0)
    method = F.when(known, F.concat(F.lit("flesch-"), code)).otherwise(F.lit("flesch-like"))
    return F.when(usable, clamp(ease, 0, 100)), F.when(usable, capped), F.when(usable, method)


def readability_label(ease: Column) -> Column:
    return (
        F.when(ease >= 80, "very-easy").when(ease >= 60, "standard").when(ease >= 30, "difficult").when(ease.isNotNull(), "very-difficult")
    )


def guess_language(text: Column) -> Column:
    """Language with most marker words; null below two hits or on a tie."""
    tokens = words(text)

    def hits(markers: tuple[str, ...]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*markers)))

    votes = F.array(*[F.struct(hits(m).alias("n"), F.lit(code).alias("code")) for code, m in LANGUAGE_MARKERS.items()])
    top = F.sort_array(votes, asc=False)
    first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    return F.when((first["n"] >= 2) & (first["n"] > second["n"]), first["code"])


def finding_type(message: Column) -> Column:
    """Kind of a finding text: the part before a colon, lower case, digit runs as #."""
    low = F.lower(F.trim(message))
    head = F.trim(F.regexp_replace(F.regexp_extract(low, "^([^:]*)", 1), "[0-9]+", "#"))
    return F.when(head == "", F.lit("<empty>")).otherwise(head)


def overlap_share(left: Column, right: Column) -> Column:
    """Share of distinct left words found right; null without left words."""
    a = F.array_distinct(words(left))
    return F.try_divide(F.size(F.array_intersect(a, words(right))).cast("double"), F.size(a))


# Pattern list of scholarly and web references.
REFERENCE_PATTERNS = (
    ("doi", r"(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)\b"),
    ("pmcid", r"(?i)\b(PMC[0-9]{4,9})\b"),
    ("pmid", r"(?i)\bPMID\s*:?[\s#]*([0-9]{1,9})\b"),
    ("url", r"(?i)(https?://[^\s)\]>]+)"),
    ("numeric", r"\[([0-9]{1,3})\]"),
    ("author-year", r"\(([A-ZÀ-Ž][\wÀ-ž'-]+(?:\s+et\s+al\.)?[,; ]+[0-9]{4})\)"),
)


def references(text: Column) -> Column:
    """``kind:key`` strings of DOI, PMCID, PMID, URL, numbered and author-and-year mentions, distinct and sorted."""

    def keys(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda r: F.concat(F.lit(kind + ":"), F.lower(F.regexp_replace(r, r"[.,;:]+$", ""))))

    return F.array_sort(F.array_distinct(F.concat(*[keys(k, p) for k, p in REFERENCE_PATTERNS])))


# Image texts that say nothing.
GENERIC_ALT = (
    "image", "photo", "picture", "img", "graphic", "screenshot", "zdjęcie", "obraz", "foto", "bild", "imagen",
    "imagem", "immagine", "изображение", "фото",
)
ALT_FILE = r"(?i)\.(jpe?g|png|gif|webp|avif|svg|bmp|tiff?)$|^(img|dsc|image|photo|screenshot)[-_ ]?[0-9]+"


def alt_issues(alt: Column, src: Column, caption: Column, context: Column, max_alt: int = 125,
               generic: tuple[str, ...] = GENERIC_ALT) -> Column:
    """Codes of what is wrong with an image text: null alt is missing, an empty one is decorative."""
    a, cap = F.trim(alt), F.trim(caption)
    file = F.element_at(F.split(F.regexp_extract(src, r"^([^?#]*)", 1), "/"), -1)
    like_file = a.rlike(ALT_FILE) | ((file != "") & (F.lower(a) == F.lower(file)))
    checks = F.array(
        F.when(like_file, "filename"),
        F.when(F.lower(a).isin(*generic), "generic"),
        F.when(F.length(a) > max_alt, "too-long"),
        F.when(F.lower(cap) == F.lower(a), "repeats-caption"),
        F.when(overlap_share(a, context) == 0, "unrelated-to-context"),
    )
    none = F.array().cast("array<string>")
    return F.when(alt.isNull(), F.array(F.lit("missing"))).when(a == "", none).otherwise(F.array_compact(checks))


def valid_hreflang(code: Column) -> Column:
    """BCP 47 shape: language, extended languages, script, region, variants, extensions, private part."""
    shape = (
        r"^(?i)(?:[a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?"
        r"(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[0-9a-wyz](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?$"
    )
    # Registered tags that do not follow the shape.
    listed = (
        "x-default", "art-lojban", "cel-gaulish", "en-gb-oed", "i-ami", "i-bnn", "i-default", "i-enochian", "i-hak",
        "i-klingon", "i-lux", "i-mingo", "i-navajo", "i-pwn", "i-tao", "i-tay", "i-tsu", "no-bok", "no-nyn",
        "sgn-be-fr", "sgn-be-nl", "sgn-ch-de", "zh-guoyu", "zh-hakka", "zh-min", "zh-min-nan", "zh-xiang",
    )
    low = F.lower(code)
    twice = low.rlike(r"-([a-z0-9]{5,8}|[0-9][a-z0-9]{3})-(?:[a-z0-9]+-)*\1(-|$)") | low.rlike(r"-([0-9a-wyz])-.*-\1-")
    return low.isin(*listed) | (low.rlike(shape) & ~twice)


def iso_date(value: Column) -> Column:
    """Leading YYYY-MM-DD between 1990 and 2100 as text."""
    m = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"
    t = F.trim(value)
    y, mo, d = (F.regexp_extract(t, m, i).try_cast("int") for i in (1, 2, 3))
    return F.when(y.between(1990, 2100) & mo.between(1, 12) & d.between(1, 31), F.substring(t, 1, 10))
