"""Personal data: exact patterns, and a conditional random field over word shapes that adds what patterns don't say."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pagewright.llm import crf, words
from pagewright.llm.store import fresh

#: Kinds in their order; the first four have patterns, all are labels of the field.
KINDS = ("email", "ip", "card", "phone", "secret")
SPANS = "array<struct<kind:string,start:int,end:int,text:string,base:boolean>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a later start within the same digits fails alike
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+`` and a domain, found from each @ backwards, so in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: what the patterns and their tests find in a whole text."""
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# --- the labelled table --------------------------------------------------------------------------------------

#: Sentences with slots; made up for this table.
_SENTENCES = (
    "please write to {email} before noon", "my address is {email} thanks", "mail {email} or {email} today", "contact : {email}", "from {ip} at night",
    "the host {ip} answered", "server {ip} and {ip} are down", "login from {ip} was refused", "card {card} was charged", "pay with {card} now",
    "number on the card : {card}", "call {phone} after six", "phone {phone} or mail {email}", "tel. {phone} for more", "reach me on {phone} please",
    "fax {phone} and card {card}", "{secret_pair} is set", "use {secret_pair} here", "the file has {secret_name} = {secret} in it", "export {secret_name} = {secret}",
    "{secret_name} : {secret} was posted", "he said {word} and {word} again", "in {year} there were {small} of them", "version {version} came in {year}",
    "about {small} to {small} percent , {word}", "room {small} on floor {small}", "{word} {word} {word} {word}", "at {time} on {date} we met", "price {money} for {small} pieces",
    "see page {small} , {word} and figure {version}", "order {order} was sent in {year}", "the score was {small} - {small} in {year}", "x = {small} and y = {small}",
    "name = {word} and size = {small}", "mention @{word} and #{word} today", "ratio {small} : {small} of {word}", "{word} ! ! {word} * * * {word}",
)
_WORDS = "river stone window market yellow garden simple orange letter bridge winter doctor summer travel machine corner flower silver station planet".split()


def labelled_table(rows: int = 600, seed: int = 17) -> list[tuple[list[str], list[str]]]:
    """A small table of (tokens, labels), with labels O, B-kind and I-kind, from the sentences above."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789_-") for _ in range(n)) + rng.choice("0123456789")

    def value(slot: str) -> str:
        word, other = rng.choice(_WORDS), rng.choice(_WORDS)
        quote = rng.choice(('"', "'", "", ""))
        name = rng.choice(("password", "passwd", "token", "secret", "api_key", "apikey", "access_token", "auth", "key"))
        made = {
            "email": lambda: rng.choice((f"{word}.{other}@{other}.com", f"{word}{digits(2)}@{other}.org", f"{word}@mail{digits(1)}.{other}.net")),
            "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
            "card": lambda: rng.choice((digits(16), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)))),
            "phone": lambda: rng.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(11)}")),
            "secret": lambda: quote + rng.choice((hexes, mixed))(rng.choice((12, 18, 24, 32, 40))) + quote,
            "secret_pair": lambda: f"{name}{rng.choice('=:')}{quote}{rng.choice((hexes, mixed))(rng.choice((12, 18, 24, 32)))}{quote}",
            "secret_name": lambda: name, "word": lambda: word, "year": lambda: str(rng.randint(1900, 2030)), "small": lambda: str(rng.randint(0, 999)),
            "version": lambda: f"{digits(1)}.{digits(1)}" + rng.choice(("", f".{digits(1)}")), "time": lambda: f"{rng.randint(0, 23)}:{rng.randint(10, 59)}",
            "date": lambda: f"{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", "money": lambda: f"{rng.choice('$\u20ac')}{digits(3)}.{digits(2)}", "order": lambda: f"#{digits(5)}",
        }
        return made[slot]()

    out = []
    for _ in range(rows):
        tokens, labels = [], []
        for part in rng.choice(_SENTENCES).split(" "):
            slots = re.findall(r"{(\w+)}", part)
            text = re.sub(r"{(\w+)}", lambda m: value(m[1]), part) + ("" if rng.random() < 0.8 else rng.choice(".,;"))
            kind = {"secret_pair": "secret"}.get(slots[0], slots[0]) if slots else "O"
            own = text.split(" ")
            tokens += own
            labels += [("B-" if i == 0 else "I-") + kind if kind in KINDS else "O" for i in range(len(own))]
        out.append((tokens, labels))
    return out


# --- features and the model ----------------------------------------------------------------------------------

_NAMES = re.compile(r"(?i)pass(word|wd)?|token|secret|api_?key|auth|key")
_CUES = re.compile(r"(?i)(call|phone|tel|fax|mail|e-mail|contact|card|host|server|ip|login)[.:]?")
_TRIM = "\"'.,;:!?()[]{}<>$#%&*|"


def shape(token: str) -> str:
    """The token with runs of letters, digits and marks shortened."""
    out = []
    for c in token[:64]:
        k = "a" if c.islower() else "A" if c.isupper() else "d" if c.isdigit() else "w" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


def own_features(token: str) -> list[str]:
    core = token.strip(_TRIM)
    n_digits = sum(c.isdigit() for c in token)
    value = re.split(r"[=:]", core, maxsplit=1)[-1].strip(_TRIM)
    out = [f"s:{shape(token)}", f"c:{shape(core)}", f"n:{min(len(core), 40) // 4}", f"d:{min(n_digits, 20)}", f"@{'@' in core}", f"={'=' in core[1:]}", f"dots:{min(core.count('.'), 4)}", f"dash:{min(core.count('-'), 4)}"]
    if _NAMES.fullmatch(core):
        out.append("name")
    if (m := re.match(r"(.+?)[=:]", core)) and _NAMES.fullmatch(m[1]):
        out.append("named")
    if _CUES.fullmatch(core):
        out.append("cue")
    if len(value) >= 10 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and re.fullmatch(r"[\w-]+", value):
        out.append("hexlike" if re.fullmatch(r"[0-9a-f]+", value) else "keylike")
    return out


def chain_features(tokens: list[str], own: dict[str, list[str]]) -> list[list[str]]:
    """Features of each place: those of its token, and with a mark those of the two before and the one after."""
    each = [own.get(t) or own.setdefault(t, own_features(t)) for t in tokens]
    marks = [[f for f in e if f[0] in "cn@d=hk" and not f.startswith("n:")] for e in each]
    out = []
    for i in range(len(tokens)):
        x = ["one", *each[i]]
        x += [f"-1{f}" for f in marks[i - 1]] if i else ["begin"]
        x += [f"-2{f}" for f in marks[i - 2] if f in ("name", "cue") or f[0] == "c"] if i > 1 else []
        x += [f"+1{f}" for f in marks[i + 1]] if i + 1 < len(tokens) else ["end"]
        out.append(x)
    return out


@dataclass
class Field:
    """Weights of the trained field."""

    features: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    labels: list[str]
    _own: dict[str, list[str]] = field(default_factory=dict, repr=False)

    def decode(self, chains: list[list[str]]) -> list[list[str]]:
        if len(self._own) > 100_000:
            self._own.clear()
        numbers = [[np.array([self.features[f] for f in x if f in self.features]) for x in chain_features(c, self._own)] for c in chains]
        out: list[list[str]] = [[] for _ in chains]
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        while order:  # chains of like length together, about 20,000 places at a time
            n = max(1, 20_000 // max(1, len(chains[order[-1]])))
            some, order = order[-n:], order[:-n]
            for i, labels in zip(some, crf.viterbi([numbers[i] for i in some], self.weights, self.moves, self.start)):
                out[i] = [self.labels[k] for k in labels]
        return out


def train(table: list[tuple[list[str], list[str]]] | None = None) -> Field:
    """Fit the field to a small labelled table, by default :func:`labelled_table`."""
    table = labelled_table() if table is None else table
    labels = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
    own: dict[str, list[str]] = {}
    chains = [chain_features(tokens, own) for tokens, _ in table]
    features: dict[str, int] = {}
    for c in chains:
        for x in c:
            for f in x:
                features.setdefault(f, len(features))
    numbers = [[np.array([features[f] for f in x]) for x in c] for c in chains]
    fit = crf.train(numbers, [[labels.index(y) for y in ys] for _, ys in table], len(features), len(labels))
    return Field(features, *fit, labels)


# --- spans of texts ------------------------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@=]")
_TOKEN = re.compile(r"\S+")
_REACH = 3


def _islands(text: str) -> list[tuple[list[str], list[int]]]:
    """Chains of (tokens, starts): the tokens of a line within ``_REACH`` of one that holds a digit, an @ or a =.

    No other token can be personal data under the labels of the field.
    """
    out = []
    for line in re.finditer(r"[^\n]+", text):
        if not _TRIGGER.search(text, *line.span()):
            continue
        tokens = [(m[0], m.start()) for m in _TOKEN.finditer(text, *line.span())]
        last = -1
        for i, (t, _) in enumerate(tokens):
            if _TRIGGER.search(t):
                lo, hi = max(i - _REACH, 0), min(i + _REACH + 1, len(tokens))
                if lo <= last and out:
                    out[-1][0].extend(t for t, _ in tokens[last:hi])
                    out[-1][1].extend(s for _, s in tokens[last:hi])
                else:
                    out.append(([t for t, _ in tokens[lo:hi]], [s for _, s in tokens[lo:hi]]))
                last = max(last, hi)
    return out


def _sound(kind: str, value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    if kind == "secret":
        return len(value) >= 10 and digits >= 2 and any(c.isalpha() for c in value)
    return {"email": "@" in value and "." in value, "ip": value.count(".") == 3, "card": 13 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def _spans_of_labels(text: str, tokens: list[str], starts: list[int], labels: list[str]) -> list[tuple[str, int, int]]:
    out, i = [], 0
    while i < len(labels):
        if labels[i] == "O":
            i += 1
            continue
        kind, j = labels[i][2:], i + 1
        while j < len(labels) and labels[j] == f"I-{kind}":
            j += 1
        a, b = starts[i], starts[j - 1] + len(tokens[j - 1])
        if kind == "secret" and (m := re.match(r"[^=:]*[=:]", text[a:b])) and m.end() < b - a:
            a += m.end()
        trim = _TRIM.replace("(", "") if kind == "phone" else _TRIM
        a += len(text[a:b]) - len(text[a:b].lstrip(trim))
        b -= len(text[a:b]) - len(text[a:b].rstrip(_TRIM))
        if a < b and _sound(kind, text[a:b]):
            out.append((kind, a, b))
        i = j
    return out


def find_all(texts: list[str], model: Field) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each whole text by start, then kind. A span of the field that meets a base one is left out."""
    base = [base_spans(t) for t in texts]
    chains = [(i, *x) for i, t in enumerate(texts) if _TRIGGER.search(t) for x in _islands(t)]
    more: list[list] = [[] for _ in texts]
    for (i, tokens, starts), labels in zip(chains, model.decode([c[1] for c in chains])):
        more[i] += _spans_of_labels(texts[i], tokens, starts, labels)
    out = []
    for own, extra in zip(base, more):
        ends, top = [], 0
        begins = [a for _, a, _ in own]
        for _, _, b in own:
            top = max(top, b)
            ends.append(top)
        spans = [(*s, True) for s in own]
        for kind, a, b in extra:
            k = bisect_right(begins, b - 1)
            if not k or ends[k - 1] <= a:
                spans.append((kind, a, b, False))
        out.append(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, last = [], 0
    for kind, a, b, _ in spans:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find(model: Field, text_col: str = "text", redact: bool = False) -> Column:
    """A column of the spans of a whole text (code points, end exclusive), or of the text without them.

    Null texts have no spans and stay null; the field adds spans and drops none of the patterns'.
    """

    def batches(text) -> list:
        found = []
        for first, n in words.cuts(text, 1 << 20):
            texts = [t or "" for t in text.slice(first, n).to_pylist()]
            found += zip(texts, find_all(texts, model))
        words.give_back()
        return found

    @F.arrow_udf(SPANS)
    def spans(text):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("base", pa.bool_())]))
        return pa.array([[{"kind": k, "start": a, "end": b, "text": t[a:b], "base": base} for k, a, b, base in own] for t, own in batches(text)], kind)

    @F.arrow_udf("string")
    def clean(text):
        import pyarrow as pa

        return pa.array([None if old is None else redacted(t, own) for old, (t, own) in zip(text.to_pylist(), batches(text))], pa.string())

    return (clean if redact else spans)(F.col(f"`{text_col}`").cast("string"))


def redact(docs: DataFrame, model: Field, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows of ``docs`` with personal data in the text replaced by its kind, and the number of letters brought up to date.

    Null texts stay null, empty ones empty; texts of any length are read whole; repeated rows stay. Other columns are kept, and a
    column for the number of letters isn't needed. No rows give no rows.
    """
    new = fresh(docs, "_text_without_personal_data")
    changed = docs.withColumn(new, find(model, text_col, redact=True))

    def shown(c: str) -> Column:
        if c == size_col:
            same = F.col(new).eqNullSafe(F.col(f"`{text_col}`"))
            return F.when(same, F.col(f"`{c}`")).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c)
        return F.col(new).alias(c) if c == text_col else F.col(f"`{c}`")

    return changed.select(*[shown(c) for c in docs.columns])
