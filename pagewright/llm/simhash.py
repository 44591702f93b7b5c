"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming test."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagewright.llm import words
from pagewright.llm.components import components
from pagewright.llm.store import fresh, widened, written

SEED = 42
SHINGLE = 3


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text (UTF-8)."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for lo, hi in words.groups(texts):
        w = words.find(texts[lo:hi], words.SPACED)
        sizes = w.ends - w.starts
        keep = words.SPACED[w.data]
        keep[w.ends] = True
        spaced = w.data[keep]  # each word and one separator
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        spaced[begin + sizes] = 32
        raw, a, e = spaced.tobytes(), begin.tolist(), (begin + sizes).tolist()
        for t in range(hi - lo):
            f, g = int(w.first[t]), int(w.first[t + 1])
            if f == g:
                continue
            k = min(shingle, g - f)
            ones, n = np.zeros(64, np.int64), g - f - k + 1
            for at in range(f, f + n, 65536):
                to = min(at + 65536, f + n)
                h = np.array([xxh64_intdigest(raw[x:y], SEED) for x, y in zip(a[at:to], e[at + k - 1 : to + k - 1])], np.uint64)
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[lo + t] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every row. Null and wordless texts have 0."""
    schema = widened(docs.select(F.col(id_col).alias("id")), "fp long")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in words.slices(batches, 1):
            fp = fingerprints_of(words.raw_texts(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _blocks(distance: int, spare: int) -> list[int]:
    """Masks of all choices of ``spare`` whole blocks out of ``distance + spare``: a close pair agrees on one choice."""
    n = distance + spare
    edge = [64 * i // n for i in range(n + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(n)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(n), spare)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(fps: DataFrame, distance: int = 2, spare: int = 3, most: int = 64) -> DataFrame:
    """(src, dst) between distinct fingerprints so that linked ones are those at ``distance`` or fewer differing bits.

    A fingerprint stands under each choice of ``spare`` blocks; those that share a choice are compared. A choice shared by more
    than ``most`` fingerprints isn't compared pair by pair: its fingerprints meet under every value at half the distance from
    both, which for an even distance holds exactly of close pairs and needs no test; each value links its fingerprints to the
    least one.
    """
    if distance != 2:
        raise ValueError("values half-way are laid out for distance 2")
    kinds = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(_blocks(distance, spare))])
    keys = fps.select("fp", F.explode(kinds).alias("k")).select("fp", "k.c", "k.v")
    shared = keys.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keys.join(shared, ["c", "v"]))
    few = met.filter(F.col("n") <= most)
    pairs = (
        few.alias("x").join(few.alias("y"), ["c", "v"])
        .filter("x.fp < y.fp").filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance)
        .select(F.col("x.fp").alias("src"), F.col("y.fp").alias("dst"))
    )
    bits = [1 << i for i in range(63)] + [-(1 << 63), 0]
    half = met.filter(F.col("n") > most).select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(b)) for b in bits])).alias("v"))
    # at most 65 distinct fingerprints are one bit or less from a value
    stars = half.groupBy("v").agg(F.collect_set("fp").alias("of")).filter("size(of) > 1").select(F.array_min("of").alias("src"), F.explode("of").alias("dst"))
    return pairs.union(stars.filter("src != dst")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row: component_id is the least id among texts linked directly or over others.

    Null, empty and wordless texts share fingerprint 0 and so are copies. Repeated rows stay; a null id never names a
    component unless no other id is in it. No rows give no rows. Other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col))
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    links = components(close_pairs(classes.select("fp"), distance)).select(F.col("id").alias("fp"), "component")
    named = written(classes.join(links, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    owner = named.join(first, "component").select("fp", "component_id")
    return rows.join(owner, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """The rows of ``docs`` with one of each near-duplicate group left: that with the least id that isn't null.

    Where ids repeat or are all null, the row with the least hash of its columns stays; of rows alike in all columns one
    stays. Null, empty and wordless texts are copies of each other.
    """
    place = fresh(docs, "_place_of_row")
    by = F.col(f"`{id_col}`")
    placed = docs.withColumn(place, F.struct(by.isNull().alias("x"), by.alias("y"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]).alias("z")))
    groups = near_groups(placed, place, text_col, distance)
    kept = groups.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias(place)).distinct()
    return placed.join(kept, place, "left_semi").dropDuplicates([place]).select(*[f"`{c}`" for c in docs.columns])
