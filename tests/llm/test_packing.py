import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(11)
    letters = ["a", ".", ",", "b.", "\u00b2", "ª", "\u0301", "the", "don't", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u3000", "\u2028", "\u200b", "é", "日本", "12", "!?", "'s", "<|endoftext|>", "🙂"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(400)]


def test_parts_have_the_ids_of_the_whole():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    encoder = packing.Encoder(PATH, remember=50)
    texts = odd_texts() + [" ".join(odd_texts()), "", "\n", "\n\n a", "word.\nNext, word.Other ,x x, y.. z"]
    for text, own in zip(texts, [x for i in range(0, len(texts), 7) for x in encoder.ids(texts[i : i + 7])]):
        assert np.frombuffer(own, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def best_fit(lengths, capacity):
    """Best fit, longest first, one piece at a time."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_equals_best_fit_and_has_no_gaps():
    rng = random.Random(2)
    for capacity in (7, 20, 64):
        for _ in range(60):
            lengths = [rng.choice([rng.randint(1, capacity), 3, capacity // 2]) for _ in range(rng.randint(0, 200))]
            histogram = {n: lengths.count(n) for n in set(lengths)}
            used = {}
            rows = packing.plan(histogram, capacity).tolist()
            for i, (n, rank, sequence, each, offset) in enumerate(rows):
                to = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == n else histogram[n]
                for k in range(to - rank):
                    used.setdefault(sequence + k // each, []).append((offset + k % each * n, n))
            assert sum(map(len, used.values())) == len(lengths)
            assert len(used) == best_fit(lengths, capacity)
            for own in used.values():
                own.sort()
                assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
                assert sum(n for _, n in own) <= capacity


def test_packed_rows_come_back(docs):
    texts = odd_texts()[:80] + [None, "", "word " * 700, "x" * 3000, "same text", "same text"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    packed = packing.pack(docs(rows).selectExpr("*", "1 AS length", "2 AS id", "3 AS piece"), PATH, capacity=64).cache()
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    got = {}
    for r in packed.collect():
        assert len(r.ids) == 4 * r.length and (r.length == 64 or r.piece == 0)
        got.setdefault(r.id, []).append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, text in rows:
        want = plain.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(got[i])
        if i == 3:
            assert sum(x == (0, 0, want) for x in own) in (1, 2)
        else:
            assert sum((x[2] for x in own), []) == want and [x[1] for x in own] == [sum(len(y[2]) for y in own[:k]) for k in range(len(own))]
    lengths = [r.length for r in packed.collect()]
    whole = packing.sequences(packed).collect()
    assert len(whole) == best_fit(lengths, 64) and sum(len(r.ids) for r in whole) == 4 * sum(lengths)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).filter("n != m OR n > 64").count() == 0


def test_empty_table(docs):
    assert packing.pack(docs([]), PATH).count() == 0
