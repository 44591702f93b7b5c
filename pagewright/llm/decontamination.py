"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item is a set of word shingles that a document must hold whole, so one shingle is a sufficient prefix:
the one that is rarest in the corpus. Documents report where prefix shingles stand; a join on them, bounds on length and
position, and a comparison of the words prove each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagewright.llm import words
from pagewright.llm.store import fresh, widened, written

WINDOW = 10
SHINGLE = 3
#: The filter that is sent to the tasks has 2 to this power bits for few and for very many shingles; between, about 256 bits for each.
FILTER_BITS = (16, 26)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, words, n, shingles): each run of ``window`` words of an item, or all words of a shorter one, and its shingles in order."""
    schema = widened(benchmark.select(F.col(id_col).alias("item")), "words string, n int, shingles array<struct<k:int,h:bigint>>")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows: dict[str, list] = {"at": [], "words": [], "n": [], "shingles": []}
            for at, text in enumerate(words.raw_texts(batch.column(1))):
                w = words.find([text], words.ALNUM)
                count = len(w.starts)
                if not count:
                    continue
                n = min(window, count)
                k = min(shingle, n)
                own = [text.lower()[a - 1 : b - 1].decode() for a, b in zip(w.starts, w.ends)]
                h = words.shingle_hashes(words.hashes(w), k).view(np.int64).tolist()
                for i in range(count - n + 1):
                    rows["at"].append(at)
                    rows["words"].append(" ".join(own[i : i + n]))
                    rows["n"].append(n)
                    rows["shingles"].append([{"k": k, "h": x} for x in h[i : i + n - k + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows["at"], pa.int64())), pa.array(rows["words"], pa.string()), pa.array(rows["n"], pa.int32()),
                 pa.array(rows["shingles"], pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64())])))],
                names=["item", "words", "n", "shingles"],
            )

    return benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _filter_of(shingles: DataFrame) -> tuple[list[int], np.ndarray]:
    """The sizes of the shingles (k, h) and a bit for each hash: at most 2 ** 20 numbers come to the driver.

    Some places that hold no shingle pass the filter, more of them where the filter is at its largest; the join drops them.
    """
    many = {r.k: r.n for r in shingles.groupBy("k").agg(F.count("*").alias("n")).collect()}
    sizes = sorted(many)
    power = min(max((256 * sum(many.values())).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    place = F.col("h").bitwiseAND(F.lit((1 << power) - 1))
    set_bits = shingles.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    table = np.zeros(1 << (power - 6), np.int64)
    for r in set_bits:
        table[r.w] = r.b
    return sizes, table.view(np.uint8)


def _held(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


def _hits(w: words.Words, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first words, hashes) of the shingles of k words that may be in the filter and lie within one text."""
    h, text = words.hashes(w), w.text_of()
    for k in sizes:
        s = words.shingle_hashes(h, k)
        at = _held(s, bits)
        at = at[text[at] == text[at + k - 1]]
        yield k, at, s[at]


def shingle_counts(docs: DataFrame, shingles: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): how often each of the given shingles (k, h) stands in all whole texts; those that never do are left out."""
    sizes, bits = _filter_of(shingles)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in words.slices(batches, 0):
            texts = words.raw_texts(batch.column(0))
            found = [np.zeros(0, np.uint64)]
            for lo, hi in words.groups(texts):
                found += [s for _, _, s in _hits(words.find(texts[lo:hi], words.ALNUM), sizes, bits)]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counted.join(shingles.select("h").distinct(), "h", "left_semi")


def prefix_hits(docs: DataFrame, prefixes: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, id, n_words, hits) of every document: where shingles that may be prefixes stand, with the words around them."""
    sizes, bits = _filter_of(prefixes)
    schema = widened(docs.select(F.col(id_col).alias("id")), "row long, n_words long, hits array<struct<h:bigint,pos:int,lo:int,around:string>>")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("around", pa.string())]))
        for batch in words.slices(batches, 1):
            texts = words.raw_texts(batch.column(1))
            counts = np.zeros(len(texts), np.int64)
            hits: list[list] = [[] for _ in texts]
            for lo, hi in words.groups(texts):
                w = words.find(texts[lo:hi], words.ALNUM)
                counts[lo:hi] = w.counts
                raw = None
                for k, at, s in _hits(w, sizes, bits):
                    if not len(at):
                        continue
                    raw = raw or w.data.tobytes()
                    own = np.searchsorted(w.first, at, side="right") - 1
                    for i, t, h in zip(at.tolist(), own.tolist(), s.view(np.int64).tolist()):
                        f = int(w.first[t])
                        begin, end = max(f, i - window + k), min(int(w.first[t + 1]), i + window)
                        around = b" ".join(raw[w.starts[x] : w.ends[x]] for x in range(begin, end)).decode()
                        hits[lo + t].append({"h": h, "pos": i - f, "lo": begin - f, "around": around})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + len(texts))), pa.array(counts), pa.array(hits, kind)], names=["id", "row", "n_words", "hits"]
            )
            row += len(texts)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """(id, n_words, n_hit, items) of every document row.

    ``n_hit`` counts words inside any occurrence of a window of an item, ``items`` holds the sorted texts of the item ids
    whose windows occur. Null and wordless texts have no words; an item without an id marks words and isn't listed; repeated
    rows and items stay or count as they come. Texts of any length are read whole. No documents give no rows, no items no
    hits. Other columns are ignored.
    """
    windows = written(item_windows(benchmark, item_col, item_text_col, window, shingle))
    distinct = windows.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    tokens = distinct.select("words", "n", F.posexplode("shingles").alias("j", "s")).select("words", "n", "j", "s.k", "s.h")
    counts = shingle_counts(docs, tokens.select("k", "h").distinct(), text_col)
    ranked = tokens.join(counts.withColumnRenamed("n", "often"), "h")  # a window with a shingle that never stands can't occur
    whole = ranked.groupBy("words", "n").agg(F.count("*").alias("found"), F.min(F.struct("often", "h", "j", "k")).alias("p"))
    prefixes = written(
        whole.join(distinct.select("words", F.size("shingles").alias("all")), "words").filter("found = all")
        .select("words", "n", "p.h", "p.j", "p.k")
    )
    read = written(prefix_hits(docs, prefixes.select("k", "h").distinct(), id_col, text_col, window))
    met = (
        read.select("row", "n_words", F.explode("hits").alias("x")).select("row", "n_words", "x.*")
        .join(prefixes, "h").withColumn("start", F.col("pos") - F.col("j"))
        .filter("n <= n_words AND start >= 0 AND start + n <= n_words")
    )
    around = F.split("around", " ", -1)
    proved = met.filter(F.array_join(F.slice(around, F.greatest(F.col("start") - F.col("lo") + 1, F.lit(1)), F.col("n")), " ") == F.col("words"))
    proved = written(proved.select("row", "start", "n", "words"))
    hit = proved.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    owners = windows.filter("item IS NOT NULL").select("words", F.col("item").cast("string").alias("item")).distinct()
    items = proved.select("row", "words").distinct().join(owners, "words").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return (
        read.select("row", "id", "n_words").join(hit, "row", "left").join(items, "row", "left")
        .select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of an item; null and empty texts stay."""
    digest = fresh(docs, "_digest_of_text")
    marked = docs.withColumn(digest, F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))
    found = contamination(marked, benchmark, digest, text_col, **options).filter("n_hit > 0").select(F.col("id").alias(digest)).distinct()
    return marked.join(found, digest, "left_anti").select(*[f"`{c}`" for c in docs.columns])
