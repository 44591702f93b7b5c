"""Exact duplicates: texts grouped by a 128-bit hash, bytes compared inside each group. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.llm.store import written

#: A group with more than one in so many of all copies is hot; there are fewer hot groups than that.
HOT = 4096


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return plain.withColumn("hash", digest(F.col("text")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, digest: Callable[[Column], Column] = content_hash, hot: int = HOT) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Rows are copies if their texts are the same bytes; a null text is empty. keep_id is the least id of the copies, or the
    largest, nulls last; kept says that a row has it. Rows that repeat an id and a text are one document: all or none of them
    are kept, and each counts in group_size. Where all copies have null ids keep_id is null and they are kept. Texts may be of
    any length. No rows give no rows; other columns are ignored.

    ``digest`` gives a binary of up to 19 bytes. The bytes are compared by aggregating on hash and text, which leaves one row a
    text and task before anything moves, so a text crosses the network as often as tasks hold it and never as often as it has
    copies. Only hashes that rows share are joined back, to rows without texts. Hot groups are few, whatever the data
    (fewer than ``hot``), and reach the rows by broadcast. Hashes that different texts share are grouped by their texts.
    """
    rows = _rows(docs, id_col, text_col, digest)
    best = F.max if largest else F.min
    texts = rows.groupBy("hash", "text").agg(F.count("*").alias("n"), best("id").alias("keep_id"))
    shared = written(texts.groupBy("hash").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), best("keep_id").alias("keep_id")).filter("n > 1"))
    mixed = written(shared.filter("texts > 1").select("hash"))
    copies = int(shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    one = shared.filter("texts = 1")
    is_hot = F.col("n") * hot > copies
    few = one.filter(is_hot).select("hash", F.struct("n", "keep_id").alias("few"))
    most = one.filter(~is_hot).select(F.col("hash").alias("key"), F.struct("n", "keep_id").alias("most"))

    narrow = rows.select("id", "hash", F.sha2("text", 256).alias("text_sha256")).join(mixed, "hash", "left_anti")
    # rows of hot groups are done; a key that is 20 bytes long matches nothing and spreads them
    apart = F.encode(F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"), "UTF-8")
    marked = narrow.join(F.broadcast(few), "hash", "left").withColumn("key", F.when(F.col("few").isNull(), F.col("hash")).otherwise(apart))
    of = F.coalesce("few", "most")
    found = marked.join(most, "key", "left").select(
        "id", F.when(of.isNull(), F.col("id")).otherwise(of["keep_id"]).alias("keep_id"), F.coalesce(of["n"], F.lit(1)).cast("long").alias("group_size"), "text_sha256"
    )
    if not mixed.isEmpty():
        clashing = rows.join(mixed, "hash", "left_semi")
        groups = clashing.groupBy("hash", "text").agg(F.count("*").alias("group_size"), best("id").alias("keep_id"))
        found = found.union(clashing.join(groups, ["hash", "text"]).select("id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """The rows of ``docs`` with one of each group of copies left, in their own columns.

    Least (or largest) id first, null ids last; of rows that repeat an id and a text, the one with the least hash of its columns;
    of rows alike in all columns, one. Null texts are copies of empty ones.
    """
    place = "_place"
    while place in docs.columns:
        place += "_"
    by = F.col(f"`{id_col}`")
    unknown = by.isNotNull() if largest else by.isNull()
    rest = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    placed = docs.withColumn(place, F.struct(unknown.alias("x"), by.alias("y"), rest.alias("z")))
    kept = exact_groups(placed, place, text_col, largest).filter("kept").select(F.col("id").alias(place)).distinct()
    return placed.join(kept, place, "left_semi").dropDuplicates([place]).select(*[f"`{c}`" for c in docs.columns])


#: The groups of the documents table with the largest id kept, in DuckDB's SQL.
LARGEST_SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256 FROM rows JOIN groups USING (text)
"""
