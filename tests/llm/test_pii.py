import random
import re

import numpy as np
import pytest

from pagewright.llm import crf, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            odd = [int(d) * 2 for d in digits[-2::-2]]
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in odd)) % 10 == 0,
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(PATTERNS).index(x[0])))


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_patterns_equal_the_plain_ones():
    rng = random.Random(4)
    bits = ["a", "b.", "@", "a@b.c", ".", "-", "1", "256", "0255", "1.2.3.4", "+", "+1 (2", ") ", " ", "4111 1111 1111 1111", "4111-1111", "555", "é", "_", "%", "\n", "(", "12345"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1((" * 80_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(run)


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    weights, moves, start = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    chains = [[rng.integers(0, 5, rng.integers(1, 4)) for _ in range(n)] for n in (1, 4, 5, 2)]
    for chain, got in zip(chains, crf.viterbi(chains, weights, moves, start)):
        def value(labels):
            return start[labels[0]] + sum(weights[x].sum(axis=0)[y] for x, y in zip(chain, labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max(value(y) for y in np.ndindex(*[3] * len(chain)))
        assert value(got) == pytest.approx(best)


def test_held_out_labels(model):
    table = pii.labelled_table(150, seed=99)
    got = model.decode([tokens for tokens, _ in table])
    assert sum(a == b for a, (_, b) in zip(got, table)) >= 0.95 * len(table)


def test_spans_and_redaction(docs, model):
    texts = [
        "mail a.b@c.de, call +1 (555) 123-4567 now\npassword=5c945043d169e4c70a é token = \"0123456789abcdef01\"", None, "", "nothing here at all",
        "é 10.0.0.1 and 4111 1111 1111 1111.", "version 1.2.3 of 2020", "x" * 100_000 + " 10.0.0.1", "word " * 30_000 + "a@b.co",
    ]
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None), (0, texts[0], "en", "s", 7)]
    frame = docs(rows)
    found = {r.doc_id: r.s for r in frame.select("doc_id", pii.find(model).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i] if s.base] == brute(text or "")
        assert all(s.text == text[s.start : s.end] for s in found[i])
    assert [s.text for s in found[0] if s.kind == "secret"] == ["5c945043d169e4c70a", "0123456789abcdef01"]
    assert not found[3] and not found[5]
    clean = pii.redact(frame.selectExpr("*", "1 AS spans"), model)
    assert clean.columns == [*frame.columns, "spans"] and clean.count() == len(rows)
    by = {r.doc_id: r for r in clean.collect()}
    assert by[0].text == "mail [EMAIL], call [PHONE] now\npassword=[SECRET] é token = \"[SECRET]\"" and by[0].n_chars == len(by[0].text)
    assert by[1].text is None and by[3].text == texts[3] and by[3].n_chars == 7


def test_empty_table(docs, model):
    assert pii.redact(docs([]), model).count() == 0
