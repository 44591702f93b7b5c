"""Hard negatives: summaries of vector segments bound scores, finer segments narrow them, and what is left is scored exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from pagewright.llm.store import written

#: Rows of a block, and of a block of anchors.
BLOCK, ANCHORS = 8192, 4096
#: Queries that are compared with a block at a time.
AT_ONCE = 128


def segment_edges(dim: int) -> list[np.ndarray]:
    """The starts of 1, 4, 16, ... segments of at least two numbers; each level cuts the segments of the one before."""
    counts, n = [], 1
    while n == 1 or 2 * n <= dim:
        counts.append(n)
        n *= 4
    return [np.arange(n) * dim // n for n in counts]


def summaries(q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the means and the deviations of the segments of each row, times the root of the segment's size.

    Then a product of two rows differs from the product of their means by at most the product of their deviations, plus what
    rounding may add: the last deviation is a share of the row's length that covers it.
    """
    x = q.astype(np.float64)
    slack = np.sqrt(1e-11) * np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = []
    for starts in segment_edges(x.shape[1]):
        sizes = np.diff(np.append(starts, x.shape[1]))
        mean = np.add.reduceat(x, starts, axis=1) / sizes
        apart = x - np.repeat(mean, sizes, axis=1)
        spread = np.sqrt(np.add.reduceat(apart * apart, starts, axis=1))
        out.append((mean * np.sqrt(sizes), np.hstack([spread, slack])))
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def best_within(asked: tuple, rows: tuple, allowed: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, worth: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, band, row, score) of the k best allowed rows of each query and band: scores from lo to hi, ties by least row id.

    ``asked``: (vectors, levels); ``rows``: (vectors, levels, ids); ``lo`` and ``hi``: a column for each band, lo > hi where a query
    has fewer. A row leaves as soon as its bounds miss every band, or lie below the k-th best of the lower bounds that are sure to
    be in it. ``worth`` says for each level whether it is tried, and forgets those that leave four fifths of the pairs or more.
    """
    (qa, la), (qb, lb, ids) = asked, rows
    i, j, alive = np.arange(len(qa)), np.arange(len(qb)), allowed
    for level, ((ma, da), (mb, db)) in enumerate(zip(la, lb)):
        if not worth[level] or not alive.any():
            continue
        some = alive.any(axis=1), alive.any(axis=0)
        i, j, alive = i[some[0]], j[some[1]], alive[np.ix_(*some)]
        middle, wide = ma[i] @ mb[j].T, da[i] @ db[j].T
        low, high = middle - wide, middle + wide
        fits = np.zeros_like(alive)
        for first, last in zip(lo[i].T[:, :, None], hi[i].T[:, :, None]):
            sure = alive & (low >= first) & (high <= last)
            least = np.maximum(_kth(np.where(sure, low, -np.inf), k)[:, None], first)
            fits |= (high >= least) & (low <= last)
        before = alive.sum()
        alive = alive & fits
        worth[level] = bool(alive.sum() < 0.8 * before)
    if 8 * alive.sum() > alive.size:
        score = exact_scores(qa[i], qb[j])
        x, y = np.nonzero(alive & (score >= lo[i].min(axis=1)[:, None]) & (score <= hi[i].max(axis=1)[:, None]))
        score = score[x, y]
    else:
        x, y = np.nonzero(alive)
        score = np.concatenate([np.einsum("ij,ij->i", qa[i[x[s : s + 65536]]], qb[j[y[s : s + 65536]]]) for s in range(0, max(len(x), 1), 65536)])
    a, b = i[x], j[y]
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    ends, found = np.searchsorted(a, np.arange(len(qa) + 1)), []
    for q in np.unique(a):
        own = slice(ends[q], ends[q + 1])
        for band, at in enumerate(np.searchsorted(-score[own], -hi[q])):
            best = np.arange(ends[q] + at, min(ends[q] + at + k, ends[q + 1]))
            best = best[score[best] >= lo[q, band]]
            found.append((np.full(len(best), q), np.full(len(best), band), b[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def _labels(*lists) -> list[np.ndarray]:
    """Numbers for the labels of several Arrow arrays, alike in all of them."""
    import pyarrow as pa

    codes = pa.chunked_array(lists).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(x) for x in lists])[:-1])


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of about ``size`` rows of equal dimension, dealt by hash: (dim, block, ids, labels, bands, lows, highs, q, levels)."""
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // size))]) if counts else F.create_map(F.lit(0), F.lit(1))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), parts[F.col("dim")]).cast("int"))
    label = rows.schema["label"].dataType.simpleString()
    schema = StructType.fromDDL(f"dim int, block int, ids array<long>, labels array<{label}>, bands array<int>, lows array<long>, highs array<long>, q binary, levels array<binary>")
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def pack(table):
        import pyarrow as pa

        table = table.combine_chunks().sort_by("id")
        dim = table.column("dim")[0].as_py()
        flat = lambda name: pa.concat_arrays(table.column(name).chunks).flatten()
        q = flat("q").to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dim)
        parts = [part.tobytes() for level in summaries(q) for part in level] if dim else []
        bands = [len(x) for x in table.column("lo").to_pylist()]
        lists = {"ids": table.column("id").to_pylist(), "labels": table.column("label").to_pylist(), "bands": bands, "lows": flat("lo").to_pylist(), "highs": flat("hi").to_pylist()}
        return pa.table({"dim": [dim], "block": [table.column("block")[0].as_py()], **{k: [v] for k, v in lists.items()}, "q": [q.tobytes()], "levels": [parts]}, schema=kind)

    total = sum(-(-n // size) for n in counts.values())
    return written(dealt.repartition(max(1, min(total * 2, 20_000)), "dim", "block").groupBy("dim", "block").applyInArrow(pack, schema))


def _best(rows: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """(id, lo, hi, row, score, rank): the k best rows of equal (or other) label for each query and band, of all units of blocks."""
    left = asked.select("dim", F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "bands", "lows", "highs", "q", "levels")])
    right = rows.select("dim", F.col("block").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "q", "levels")])
    units = left.select("dim", "a").join(right.select("dim", "b"), "dim")
    work = units.join(left, ["dim", "a"]).join(right, ["dim", "b"])
    schema = StructType.fromDDL("id long, lo long, hi long, row long, score long")

    def side(r, prefix, dim):
        ids = r.column(f"{prefix}_ids")[0].values.to_numpy(zero_copy_only=False)
        levels = [np.frombuffer(x.as_py(), np.float64).reshape(len(ids), -1) for x in (r.column(f"{prefix}_levels")[0].values if dim else [])]
        return ids, np.frombuffer(r.column(f"{prefix}_q")[0].as_py(), np.int64).reshape(len(ids), dim), list(zip(levels[::2], levels[1::2]))

    def search(table):
        import pyarrow as pa

        r = table.combine_chunks()
        dim = r.column("dim")[0].as_py()
        own, qa, la = side(r, "a", dim)
        ids, qb, lb = side(r, "b", dim)
        mine, theirs = _labels(r.column("a_labels")[0].values, r.column("b_labels")[0].values)
        bands, lows, highs = [r.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("a_bands", "a_lows", "a_highs")]
        # a column for each band; a query with fewer has bands that hold nothing
        lo, hi = np.ones((len(own), bands.max()), np.int64), np.zeros((len(own), bands.max()), np.int64)
        has = np.arange(bands.max()) < bands[:, None]
        lo[has], hi[has] = lows, highs
        worth, found = [True] * len(la), [[np.zeros(0, np.int64)] * 5]

        def ask(some: np.ndarray, among: np.ndarray) -> None:
            """The best of some rows for some queries."""
            rows = qb[among], [(m[among], d[among]) for m, d in lb], ids[among]
            for s in range(0, len(some), AT_ONCE):
                at = some[s : s + AT_ONCE]
                allowed = own[at, None] != ids[None, among] if same else mine[at, None] != theirs[None, among]
                a, band, b, score = best_within((qa[at], [(m[at], d[at]) for m, d in la]), rows, allowed, lo[at], hi[at], k, worth)
                found.append([own[at][a], lo[at][a, band], hi[at][a, band], ids[among][b], score])

        if same:
            for label in np.unique(mine):
                ask(np.flatnonzero(mine == label), np.flatnonzero(theirs == label))
        else:
            ask(np.arange(len(own)), np.arange(len(ids)))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=schema.names)

    wide = work.repartition(max(8, min(20_000, 2 * units.count())), "dim", "a", "b")
    each = wide.groupBy("dim", "a", "b").applyInArrow(search, schema)
    order = W.partitionBy("id", "lo", "hi").orderBy(F.desc("score"), "row")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, q, dim): components as whole numbers ``floor(scale * x)``, one row an id; rows that take no part are gone."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    room = F.sqrt(F.lit(2.0**55) / F.greatest(F.size("x"), F.lit(1)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), x.alias("x")).filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < room)))
    q = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    one = rows.select("id", F.struct("label", q.alias("q")).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    return one.select("id", "r.label", "r.q", F.size("r.q").alias("dim"))


def hard_negatives(vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    A row's score is its integer inner product with the anchor over components ``floor(scale * x)``; higher scores come first,
    ties by smaller id. Anchors are the rows for which ``anchor``, an expression over the column ``id``, holds. Positives of an anchor are
    its first other rows of the same label; negatives of a positive are the first rows of other labels whose score is from
    ``least`` to ``most`` percent of the positive's.

    Rows with a null id, label or vector or with any null or non-finite component take no part, neither do rows with
    components so large that a score times a hundred might not fit 62 bits. Ids are whole numbers and name rows: of rows that
    share an id the one with the least label, then least vector counts, so repeated rows count once. Vectors of different
    lengths have no score; empty ones have score 0. No rows or no anchors give no rows; other columns are ignored.

    Rows lie in blocks with the summaries of their segments, one level for each fineness; every block of anchors meets every
    block of rows, and a unit returns only its best. Labels play no part in dealing rows, so a hot label is spread.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    kept = written(quantised(vectors, scale, id_col, vector_col, label))
    free = [F.array(F.lit(x)).alias(name) for name, x in (("lo", -(1 << 62)), ("hi", 1 << 62))]
    blocks = _packed(kept.select("*", *free), block)
    asking = kept.filter(anchor)
    pairs = written(_best(blocks, _packed(asking.select("*", *free), anchors), positives, True).select(F.col("id").alias("anchor_id"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score")))
    # the least and the largest whole score from ``least`` to ``most`` percent of the positive's
    lo = F.expr(f"(positive_score * {least} + pmod(-positive_score * {least}, 100)) div 100")
    hi = F.expr(f"(positive_score * {most} - pmod(positive_score * {most}, 100)) div 100")
    banded = pairs.withColumn("lo", lo).withColumn("hi", hi)
    bands = banded.filter("lo <= hi").groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("bands"))
    found = _best(blocks, _packed(asking.join(bands, "id").select("id", "label", "q", "dim", "bands.lo", "bands.hi"), anchors), negatives, False)
    met = banded.join(found.withColumnRenamed("id", "anchor_id"), ["anchor_id", "lo", "hi"])
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))



#: The negatives of the embeddings table as the query asks for them, in DuckDB's SQL: all scores, then the ranks.
ASKED_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3
"""
