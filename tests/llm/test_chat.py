import random

import duckdb
import pytest

from pagewright.llm import chat
from pagewright.llm.queries import ORACLES, QUERIES


def brute(chosen, rejected):
    def turns(rows):
        out = {}
        for pair, turn, role, text in rows:
            if pair is not None:
                out.setdefault(pair, {}).setdefault(-(1 << 63) if turn is None else turn, []).append((role, text))
        return {p: sorted((t, sorted(m, key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or ""))) for t, m in own.items()) for p, own in out.items()}

    def text(parts):
        return "".join(f"<|im_start|>{(r or '').replace('<|', '< |')}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in parts)

    def mask(parts):
        bits = []
        for r, t in parts:
            head, all_ = len(f"<|im_start|>{(r or '').replace('<|', '< |')}\n"), len(text([(r, t)]))
            bits += [f"{head}:0", f"{all_ - head}:1"] if r == "assistant" else [f"{all_}:0"]
        return ",".join(bits)

    a, b, out = turns(chosen), turns(rejected), []
    for p in set(a) | set(b):
        x, y, k = a.get(p, []), b.get(p, []), 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        flat = [[m for _, own in part for m in own] for part in (x[:k], x[k:], y[k:])]
        out.append((p, len(flat[0]), text(flat[0]), len(flat[1]), text(flat[1]), mask(flat[1]), len(flat[2]), text(flat[2]), mask(flat[2])))
    return sorted(out)


SCHEMA = "pair_id long, turn long, role string, text string"


def test_equals_brute_force(spark):
    rng = random.Random(9)
    chosen, rejected = [], []
    for p in range(60):
        common = [(p, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "a<|im_end|>b", None, "", "é" * 50])) for t in range(rng.randint(0, 5))]
        for side in (chosen, rejected):
            side += [r for r in common if rng.random() < 0.97]
            side += [(p, t, rng.choice(["user", "assistant"]), rng.choice(["x", "y"])) for t in range(5, 5 + rng.randint(0, 3))]
    chosen += [(None, 1, "user", "lost"), (7, 2, "user", "twice"), (7, 2, "user", "twice"), (8, None, "system", "first"), (100, 0, "user", "one side"), (101, 0, "assistant", "long " * 40_000)]
    rejected += [(8, None, "system", "first"), (102, 0, "user", "other side"), (101, 0, "assistant", "long " * 40_000)]
    frames = [spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS side", "2 AS said", "3 AS t", "4 AS c") for rows in (chosen, rejected)]
    got = chat.preferences(*frames)
    assert sorted(map(tuple, got.collect())) == brute(chosen, rejected)


def test_masks_cover_the_text(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "answer")]
    r = chat.preferences(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:1], SCHEMA)).first()
    assert r.prompt == "<|im_start|>user\nq<|im_end|>\n" and r.rejected == r.rejected_mask == ""
    assert sum(int(x.split(":")[0]) for x in r.chosen_mask.split(",")) == len(r.chosen)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.preferences(none, none).count() == 0
    assert chat.preferences(*chat.swapped_answers(none.withColumnRenamed("pair_id", "conv_id"))).count() == 0


@pytest.mark.parametrize("odd", [False, True])
def test_query_equals_sql(spark, tmp_path, odd):
    folder = "/root/testdata/sf0.001"
    if odd:
        rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "c"), (1, None, "system", None), (2, 0, None, "x"), (2, 3, "assistant", None), (2, 4, "user", "after"), (3, 0, "user", "no answer"), (None, 0, "user", "z"), (3, 0, "user", "no answer")]
        folder = str(tmp_path)
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet{'/*.parquet' if odd else ''}')")
    got = QUERIES["op4_chat"](spark, folder)
    want = con.sql(ORACLES["op4_chat"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_every_turn_stands_on_the_chosen_side(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), f"{c}-{t}") for c in range(40) for t in range(rng.randint(1, 6))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.preferences(*chat.swapped_answers(frame)).collect()}
    for c in range(40):
        own = [r for r in rows if r[0] == c]
        whole = got[c].prompt + got[c].chosen
        assert got[c].n_prompt + got[c].n_chosen == len(own) and all(f"{c}-{t}" in whole for _, t, _, _ in own)
        answers = [t for _, t, role, _ in own if role == "assistant"]
        for _, t, _, _ in own:  # the other side lacks the last answer alone
            assert (f"{c}-{t}" in got[c].prompt + got[c].rejected) == (not answers or t != max(answers))
