"""The whole pipeline over a made corpus, against what plain Python keeps of it."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    plain = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 7))) for _ in range(500)]
    made = lambda n: rng.choices(plain, k=n)
    items = [(i, " ".join(made(n))) for i, n in enumerate((30, 12, 6))]
    rows, labels, want = [], [], {}
    for i in range(300):
        text = made(rng.randint(30, 300))
        kind = ("clean", "toxic", "leak", "private", "clean")[i % 5]
        if kind == "toxic":
            for _ in range(6):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "dreck", "rotten"]))
        if kind == "leak":
            item = items[i // 5 % 3][1].split()
            text[5:5] = item[:10] if len(item) >= 10 else item
        body = " ".join(text)
        clean = body
        if kind == "private":
            body, clean = body + " mail x.y@z.org or 4111 1111 1111 1111", clean + " mail [EMAIL] or [CARD]"
        rows.append((i, body, rng.choice(["en", None]), "s", len(body)))
        labels.append((i, 1, int(kind == "toxic")))
        if kind in ("clean", "private"):
            want[i] = clean
    copies = [(1000 + i, rows[i][1].upper(), "en", "t", 1) for i in range(0, 300, 7)] + [rows[0], rows[0]]
    odd = [(2000, None, None, None, None), (2001, "", None, None, 0), (None, "text of no one", None, None, None)]
    want |= {2000: None, None: "text of no one"}
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows + copies + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, want


def test_kept_texts_come_out_packed(spark, folder):
    where, want = folder
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, where).collect()}
    assert set(got) == set(want)
    for i, text in want.items():
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [0]
        assert got[i].length == len(ids) and got[i].ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder[0])
        assert kept.dtypes == docs.dtypes


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
