"""Text measures and term tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewright.functions import numbers, text


def content_metrics(docs: DataFrame, body: str = "text", lang: str = "lang") -> DataFrame:
    """Words, sentences, readability, complexity and reading time of each text; no shuffle."""
    words = F.filter(
        F.transform(F.split(F.col(body), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != ""
    )
    total = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda a, b: a + b)
    sentence_count = F.size(F.filter(F.split(F.col(body), "[.!?]"), lambda s: s.rlike(r"[\p{L}\p{N}]")))
    measured = (
        docs.withColumn("_w", words)
        .withColumn("measured_words", F.size("_w"))
        .withColumn("sentence_count", sentence_count)
        .withColumn("_syllables", total(F.transform("_w", lambda w: text.syllables(w).cast("long"))))
        .withColumn("_chars", total(F.transform("_w", lambda w: F.length(w).cast("long"))))
        .drop("_w")
    )
    code = F.coalesce(F.col(lang), text.guess_language(F.col(body)))
    ease, grade, method = text.readability(code, F.col("measured_words"), F.col("sentence_count"), F.col("_syllables"))
    wps = F.try_divide(F.col("measured_words").cast("double"), F.col("sentence_count"))
    cpw = F.try_divide(F.col("_chars").cast("double"), F.col("measured_words"))
    score = text.clamp(100 - F.greatest(wps - 12, F.lit(0.0)) * 3 - F.greatest(cpw - 5, F.lit(0.0)) * 8, 0, 100)
    return (
        measured.withColumn("ease", ease).withColumn("grade", grade).withColumn("method", method)
        .withColumn("words_per_sentence", wps).withColumn("chars_per_word", cpw)
        .withColumn("complexity", F.when(wps.isNotNull() & cpw.isNotNull(), F.floor(score + 0.5)))
        .withColumn("complexity_label", numbers.ladder(F.col("complexity"), [(75, "simple"), (45, "moderate")], "complex"))
        .withColumn("readability_label", text.readability_label(F.col("ease")))
        .withColumn("reading_minutes", F.ceil(F.col("measured_words") / 200))
        .drop("_syllables", "_chars")
    )
