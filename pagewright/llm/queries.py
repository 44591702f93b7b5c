"""Registered queries over the given tables, one for each operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import chat, decontamination, embeddings, exact, langid, licences, lm, negatives, packing, pii, simhash, toxicity, whitening
from pagewright.llm.store import table

Runner = Callable[[SparkSession, str], DataFrame]


def vocabulary_file(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_digests(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids, placed."""
    cut = packing.pieces(docs, vocabulary_file("byte_bpe_50k.json"))
    return packing.place(cut.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_digests(table(spark, folder, "documents"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.filter(_remainder(3) != 1))
    guess = docs.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), langid.predict(model).alias("p"))
    return guess.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.ambiguous")


def op3_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(_remainder(5) == 1, F.lit(False)).alias("held_out"))
    return lm.scores(docs, vocabulary_file("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.preferences(*chat.swapped_answers(table(spark, folder, "conversations")))


def op5_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return docs.select("doc_id", toxicity.severity(model).alias("s")).select("doc_id", "s.*", (F.col("s.p_toxic") >= 0.5).alias("rejected"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", pii.find(pii.train()).alias("found"))
    written_as = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("found", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, written_as), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", written_as), ",").alias("spans"),
    )


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", licences.find().alias("f")).select("doc_id", "f.*")
    base = F.filter("finds", lambda x: x["base"])
    labels = lambda finds: F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    missed = F.aggregate("finds", F.lit(1.0), lambda a, x: a * (1 - x["weight"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("finds")).alias("labels"), (1 - missed).alias("score"),
    )


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op11_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"), largest=True).withColumnRenamed("id", "doc_id")


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, label_col=label)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Runner] = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op3_lm": op3_lm,
    "op4_chat": op4_chat,
    "op5_embeddings": op5_embeddings,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_licences": op9_licences,
    "op10_simhash": op10_simhash,
    "op11_exact": op11_exact,
    "op12_negatives": op12_negatives,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op4_chat": chat.SWAPPED_SQL, "op11_exact": exact.LARGEST_SQL, "op12_negatives": negatives.ASKED_SQL}
