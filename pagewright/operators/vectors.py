"""Vector search in blocks around pivots; blocks whose angles can't reach the wanted similarity never meet."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructField, StructType

from pagewright.operators import shapes
from pagewright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pivots, vectors they are chosen from, and rows of a block.
PIVOTS, SAMPLE, ROWS = 64, 1024, 4096
#: Angles are counted in steps of one in so many of a radian.
_STEPS = 512
#: Queries whose cosines a task holds at a time, and bytes of the vectors that they are compared with.
_SLICE, _HELD = 512, 64 << 20


def _c(name: str) -> Column:
    return F.col(name)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def pivots_of(vectors: DataFrame, most: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to ``most`` unit vectors far from each other, out of a bounded sample by hash. The choice steers work, never results."""
    rows = vectors.where("v IS NOT NULL").select("v").orderBy(F.xxhash64("v")).limit(sample).collect()
    x = _unit(np.array([r.v for r in rows], np.float64)) if rows else np.zeros((0, 1))
    x = x[(x != 0).any(axis=1)]
    chosen, near = [], np.full(len(x), -np.inf)
    while len(chosen) < min(most, len(x)):
        at = int(np.argmin(near)) if chosen else 0
        if chosen and near[at] > 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, x @ x[at])
    return x[chosen]


@dataclass(frozen=True)
class Blocks:
    """Vectors in blocks of bounded size: (cell, ring, part, lo, hi, n, ids, m); all lie at angles lo..hi from the cell's pivot."""

    table: DataFrame
    pivots: np.ndarray

    @property
    def names(self) -> DataFrame:
        return self.table.select("cell", "ring", "part", "lo", "hi", "n")


def blocks(vectors: DataFrame, pivots: np.ndarray, rows_per_block: int = ROWS) -> Blocks:
    """Deal ``(id, v)`` to the nearest pivot and cut each cell into rings by angle; a ring of too many rows is cut by hash.

    Zero vectors have no angle; they make up cell -1, which meets everything.
    """
    kind = StructType([StructField("id", vectors.schema["id"].dataType), *StructType.fromDDL("v array<double>, cell int, angle double").fields])

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            cosines = x @ pivots.T if len(pivots) else np.zeros((len(x), 1))
            zero = ~(x != 0).any(axis=1)
            cell = np.where(zero, -1, np.argmax(cosines, axis=1)).astype(np.int32)
            angle = np.where(zero, 0.0, np.arccos(np.clip(cosines.max(axis=1), -1, 1)))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(cell), pa.array(angle)], names=kind.names)

    given = vectors.where("v IS NOT NULL AND size(v) > 0").select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    step = F.floor(_c("angle") * _STEPS).cast("int").alias("step")
    placed = cut_lineage(given.mapInArrow(place, kind).select("*", step))
    counts = placed.groupBy("cell", "step").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("cell").orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ringed = counts.select("cell", "step", "n", F.floor(before / rows_per_block).cast("int").alias("ring"))
    wide = ringed.groupBy("cell", "ring").agg(F.ceil(F.sum("n") / (2 * rows_per_block)).cast("int").alias("parts"))
    rings = ringed.drop("n").join(wide, ["cell", "ring"])
    dealt = placed.join(rings, ["cell", "step"]).withColumn("part", F.pmod(F.xxhash64("id"), _c("parts")).cast("int")).drop("step", "parts")
    out = StructType([*StructType.fromDDL("cell int, ring int, part int, lo double, hi double, n int, dim int").fields, StructField("ids", vectors.groupBy().agg(F.collect_list("id").alias("i")).schema["i"].dataType), *StructType.fromDDL("m binary").fields])

    def pack(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        table = table.combine_chunks().sort_by("id")
        one = lambda name: [table.column(name)[0].as_py()]
        m = table.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False)
        angle = table.column("angle").to_numpy()
        return pa.table({
            "cell": one("cell"), "ring": one("ring"), "part": one("part"), "lo": [float(angle.min())], "hi": [float(angle.max())], "n": [table.num_rows],
            "dim": [m.size // table.num_rows], "ids": [table.column("id").to_pylist()], "m": [np.ascontiguousarray(m).tobytes()],
        }, schema=to_arrow_schema(out))

    return Blocks(cut_lineage(dealt.groupBy("cell", "ring", "part").applyInArrow(pack, out)), pivots)


def block_pairs(left: Blocks, right: Blocks, low: Column, high: float = 2.0, half: bool = False, names: DataFrame | None = None) -> DataFrame:
    """Names of the pairs of blocks that may hold a cosine from ``low``, an expression over the left ``names``, to ``high``.

    For x and y around pivots at angle d, the angle of y to the pivot of x lies in ``|d - angle of y|`` .. ``d + angle of y``,
    and that of x to y is at least what it differs from x's own; the same from the other side. Cells pair by a table of the
    pivots' angles, at most their number squared.
    """
    spark, p, q = left.table.sparkSession, left.pivots, right.pivots
    angles = np.arccos(np.clip(p @ q.T, -1, 1)) if len(p) and len(q) else np.zeros((1, 1))
    known = [(i, j, float(angles[i, j])) for i in range(angles.shape[0]) for j in range(angles.shape[1])]
    free = [(-1, j, None) for j in range(-1, angles.shape[1])] + [(i, -1, None) for i in range(angles.shape[0])]
    cells = spark.createDataFrame(known + free, "cell int, cell2 int, d double")
    other = right.names.select(*[_c(x).alias(x + "2") for x in right.names.columns])
    met = (left.names if names is None else names).join(cells, "cell").join(other, "cell2")

    def apart(lo: str, hi: str, lo2: str, hi2: str) -> Column:
        """The least angle seen from the pivot of the first."""
        nearest = F.greatest(F.lit(0.0), _c("d") - _c(hi2), _c(lo2) - _c("d"))
        return F.greatest(nearest - _c(hi), _c(lo) - (_c("d") + _c(hi2)))

    least = F.greatest(F.lit(0.0), apart("lo", "hi", "lo2", "hi2"), apart("lo2", "hi2", "lo", "hi"))
    most = F.least(F.lit(float(np.pi)), _c("hi") + _c("d") + _c("hi2"))
    # zero vectors (d unknown) have cosine 0 with all
    fits = F.when(_c("d").isNull(), (low <= 1e-9) & (F.lit(high) >= -1e-9)).otherwise((F.cos(least) >= low - 1e-9) & (F.cos(most) <= high + 1e-9))
    met = met.where(fits)
    if half:
        met = met.where(F.struct("cell", "ring", "part") <= F.struct("cell2", "ring2", "part2"))
    return met.select("cell", "ring", "part", "cell2", "ring2", "part2")


_KEYS = ["cell", "ring", "part", "cell2", "ring2", "part2"]


def _ids(held) -> np.ndarray:
    import pyarrow as pa

    return held.values.to_numpy(zero_copy_only=False) if pa.types.is_integer(held.type.value_type) else np.array(held.as_py(), object)


def _meet(left: Blocks, right: Blocks, pairs: DataFrame, fn: Callable, schema: StructType) -> DataFrame:
    """``fn(ids, matrix, ids, matrix, same block)`` of each pair of blocks; one pair at a time in a task."""
    same_set = left is right
    a = left.table.select("cell", "ring", "part", "dim", _c("ids").alias("a"), _c("m").alias("x"))
    b = right.table.select(_c("cell").alias("cell2"), _c("ring").alias("ring2"), _c("part").alias("part2"), _c("ids").alias("b"), _c("m").alias("y"))
    work = pairs.join(a, ["cell", "ring", "part"]).join(b, ["cell2", "ring2", "part2"])

    def run(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        r = {k: table.column(k)[0] for k in table.column_names}
        dim = r["dim"].as_py()
        ids = [_ids(r[k]) for k in "ab"]
        m = [np.frombuffer(r[k].as_py(), np.float64).reshape(-1, dim) for k in "xy"]
        own = same_set and all(r[k] == r[k + "2"] for k in ("cell", "ring", "part"))
        return pa.table([pa.array(c, f.type) for c, f in zip(fn(ids[0], m[0], ids[1], m[1], own), kind)], schema=kind)

    return work.groupBy(*_KEYS).applyInArrow(run, schema)


def _schema(vectors: DataFrame, first: str, second: str, score: str) -> StructType:
    kind = vectors.schema["id"].dataType
    return StructType([StructField(first, kind), StructField(second, kind), *StructType.fromDDL(f"{score} double").fields])


def _first(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each row: the highest score, then the smaller id."""
    order = np.lexsort((ids, -score, rows))
    rows = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def _nearest(own: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, band: tuple[float, float] | None) -> tuple:
    """(row, place in ``ids``, score) of the k best of each row of a slice, its own id left out; ids are sorted."""
    take, score = min(k, len(ids)), x @ y.T
    if band:
        score = np.round(score, 9)
        score[(score < band[0]) | (score > band[1])] = -np.inf
    score[np.isnan(score)] = -np.inf
    score[own[:, None] == ids[None, :]] = -np.inf
    # Rounding never turns an order round, so what rounds to the k-th best or more is no further below it than a step.
    least = np.partition(score, score.shape[1] - take, axis=1)[:, -take]
    rows, cols = np.nonzero(score >= np.maximum(least - 2e-9, -4.0)[:, None])
    score = np.round(score[rows, cols], 9)
    keep = _first(rows, cols, score, take)
    return rows[keep], cols[keep], score[keep]


def _best(k: int, low: float, high: float) -> Callable:
    band = (low, high) if low > -1.5 or high < 1.5 else None

    def best(own, x, ids, y, _):
        out = []
        for at in range(0, len(own), _SLICE):
            rows, cols, score = _nearest(own[at : at + _SLICE], x[at : at + _SLICE], ids, y, k, band)
            out.append((own[at + rows], ids[cols], score))
        return tuple(np.concatenate(c) for c in zip(*out))

    return best


def _better(left: Blocks, right: Blocks, pairs: DataFrame, floors: DataFrame, k: int, schema: StructType) -> DataFrame:
    """The k best of each query in the blocks that ``pairs`` name, as far as they reach its ``floors``.

    A task holds a block of queries and so many blocks that they fit ``_HELD`` bytes, one after another; what is found raises the
    floors. Single precision with its error bound says which cosines are worth working out in double precision.
    """
    widest = right.table.agg(F.max(_c("n").cast("long") * _c("dim"))).first()[0] or 1
    many = max(1, _HELD // (8 * widest))
    own = ["cell", "ring", "part", "bunch"]
    nth = F.row_number().over(W.partitionBy("cell", "ring", "part").orderBy("cell2", "ring2", "part2"))
    named = pairs.withColumn("bunch", F.floor((nth - 1) / many).cast("int"))
    a = named.select(own).distinct().join(left.table.select("cell", "ring", "part", "dim", _c("ids").alias("a"), _c("m").alias("x")), own[:3]).join(floors, own[:3])
    b = right.table.select(_c("cell").alias("cell2"), _c("ring").alias("ring2"), _c("part").alias("part2"), _c("ids").alias("b"), _c("m").alias("y"))
    b = named.join(b, ["cell2", "ring2", "part2"]).select(*[_c(n).alias("_" + n) for n in own], "b", "y")

    def run(queries, others):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        if not queries.num_rows or not others.num_rows:
            return kind.empty_table()
        r = {n: queries.column(n)[0] for n in queries.column_names}
        dim, mine, floor = r["dim"].as_py(), _ids(r["a"]), np.array(r["floors"].as_py(), np.float64)
        x = np.frombuffer(r["x"].as_py(), np.float64).reshape(-1, dim)
        x32, slack = x.astype(np.float32), (dim + 8) * 1.2e-7
        at, ids, score = np.zeros(0, np.int64), mine[:0], np.zeros(0)
        for i in range(others.num_rows):
            theirs = _ids(others.column("b")[i])
            y = np.frombuffer(others.column("y")[i].as_py(), np.float64).reshape(-1, dim)
            y32, found = y.astype(np.float32).T, [(at, ids, score)]
            for lo in range(0, len(mine), _SLICE):
                some = slice(lo, lo + _SLICE)
                near = x32[some] @ y32 >= (floor[some] - slack).astype(np.float32)[:, None]
                if np.count_nonzero(near) * 16 > near.size:  # little is known of these queries yet
                    rows, cols, s = _nearest(mine[some], x[some], theirs, y, k, None)
                    found.append((rows + lo, theirs[cols], s))
                    continue
                rows, cols = np.nonzero(near)
                other = mine[rows + lo] != theirs[cols]
                rows, cols = rows[other] + lo, cols[other]
                found.append((rows, theirs[cols], np.round(np.einsum("ij,ij->i", x[rows], y[cols]), 9)))
            at, ids, score = (np.concatenate(c) for c in zip(*found))
            reach = score >= floor[at]
            at, ids, score = at[reach], ids[reach], score[reach]
            keep = _first(at, ids, score, k)
            at, ids, score = at[keep], ids[keep], score[keep]
            full = np.flatnonzero(np.bincount(at, minlength=len(mine)) >= k)
            floor[full] = score[np.searchsorted(at, full, side="right") - 1]
        return pa.table([pa.array(c, f.type) for c, f in zip((mine[at], ids, score), kind)], schema=kind)

    return a.groupBy(*own).cogroup(b.groupBy(*["_" + n for n in own])).applyInArrow(run, schema)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, rows_per_block: int = ROWS) -> DataFrame:
    """(id, neighbour, score, rank): the k most similar vectors per query, itself left out, exact; ties go to the smaller id.

    Queries first meet the blocks of their own cell. The k-th best found there is the least that a query asks of others, and the
    least of a block's queries what the block asks; blocks that can't hold it are not read for it.
    """
    pivots = pivots_of(vectors)
    right = blocks(vectors, pivots, rows_per_block)
    left = right if queries is vectors else blocks(queries, pivots, rows_per_block)
    schema = _schema(vectors, "id", "neighbour", "score")
    near = left.names.join(right.names.select("cell", _c("ring").alias("ring2"), _c("part").alias("part2"), _c("lo").alias("lo2")), "cell")
    own = near.groupBy("cell", "ring", "part").agg(F.min_by(F.struct("ring2", "part2"), F.struct(F.abs(_c("lo") - _c("lo2")).alias("x"), _c("ring2").alias("y"), _c("part2").alias("z"))).alias("o"))
    first = cut_lineage(own.select("cell", "ring", "part", _c("cell").alias("cell2"), "o.ring2", "o.part2"))
    found = cut_lineage(_meet(left, right, first, _best(k, -2.0, 2.0), schema))
    kth = found.groupBy("id").agg(F.count("*").alias("m"), F.min("score").alias("s"))
    members = left.table.select("cell", "ring", "part", F.posexplode("ids").alias("at", "id"))
    asked = F.struct("at", F.when(_c("m") >= k, _c("s")).otherwise(-2.0).alias("f"))
    floors = members.join(kth, "id", "left").groupBy("cell", "ring", "part").agg(F.transform(F.array_sort(F.collect_list(asked)), lambda a: a["f"]).alias("floors"))
    floors = cut_lineage(floors)
    names = left.names.join(floors.select("cell", "ring", "part", F.array_min("floors").alias("floor")), ["cell", "ring", "part"])
    rest = block_pairs(left, right, _c("floor"), names=names).join(first, _KEYS, "left_anti")
    more = _better(left, right, cut_lineage(rest), floors, k, schema)
    return shapes.top_k(found.unionByName(more), ["id"], k, F.desc("score"), _c("neighbour"))


def vector_pairs(vectors: DataFrame, floor: float, rows_per_block: int = ROWS) -> DataFrame:
    """(left, right, score): pairs of distinct vectors with a cosine of at least ``floor``, exact; equal vectors are one row first."""
    one = vectors.groupBy("v").agg(F.min("id").alias("id"))
    own = blocks(cut_lineage(one), pivots_of(one), rows_per_block)

    def close(a, x, b, y, same):
        score = x @ y.T
        rows, cols = np.nonzero(np.triu(score >= floor, 1) if same else score >= floor)
        left, right = a[rows], b[cols]
        turned = left > right
        return np.where(turned, right, left), np.where(turned, left, right), score[rows, cols]

    pairs = block_pairs(own, own, F.lit(float(floor)), half=True)
    return _meet(own, own, pairs, close, _schema(vectors, "left", "right", "score"))


def donors(drafts: DataFrame, pages: DataFrame, low: float, high: float, k: int, rows_per_block: int = ROWS) -> DataFrame:
    """(id, donor, similarity): best pages whose similarity to a draft lies in a band: close, yet not the same content."""
    pivots = pivots_of(pages)
    left, right = blocks(drafts, pivots, rows_per_block), blocks(pages, pivots, rows_per_block)
    met = _meet(left, right, block_pairs(left, right, F.lit(float(low)), float(high)), _best(k, low, high), _schema(pages, "id", "donor", "similarity"))
    return shapes.top_k(met, ["id"], k, F.desc("similarity"), _c("donor")).drop("rank")
