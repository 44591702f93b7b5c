"""Connected components on DataFrames by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewright.llm.store import forget, written


def _step(edges: DataFrame) -> DataFrame:
    """One large star and one small star. ``edges``: distinct (a, b) with a > b; so are the rows that come out."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = (
        both.join(least, "u")
        .select(F.col("v").alias("a"), F.least("u", "m").alias("b"), "u")
        .filter("a > u").select("a", "b").distinct()
    )
    root = large.groupBy("a").agg(F.min("b").alias("m"))
    hooked = large.join(root, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.union(root.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (src, dst): component is the least id reachable.

    Runs until nothing changes; each round is a table in the shared folder and the one before is deleted. Rows with a
    null end or equal ends are ignored; repeated rows count once; no rows give no rows.
    """
    now = written(
        edges.filter("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    )
    mark = _mark(now)
    while True:
        after = written(_step(now))
        forget(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A digest of an edge table; stars stay as they are, so equal marks mean the end."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.bit_xor(F.xxhash64("b", "a"))).first())
