"""Whitening of vectors from the exact characteristic polynomial of their integer scatter matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import charpoly
from pagewright.llm.store import widened, written

#: Whole numbers of this size and up have no room in exact sums.
ROOM = 2.0**40


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of two whole-number matrices."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return a @ b
    return a.astype(object) @ b.astype(object)


def _vectors(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _totals(rows: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[tuple[int, int], int | float]:
    """The sums over all rows of a matrix that ``part`` makes of some: one matrix a task, added up by place."""
    import pyarrow as pa

    to = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()
    read = (lambda v: Decimal(int(v))) if kind.startswith("decimal") else float

    def run(batches: Iterator) -> Iterator:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_vectors(batch.column(0), dim))
                total = one.astype(object) if total is None else total + one
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array([read(v) for v in total.ravel()], to)], names=["i", "j", "v"])

    parts = rows.select("x").mapInArrow(run, f"i int, j int, v {kind}")
    return {(r.i, r.j): r.v for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def _each(spark: SparkSession, n: int, run: Callable[[int], list], kind: str) -> list:
    """``run`` for each number under n, in tasks; in order."""
    import pyarrow as pa

    def tasks(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([run(i)], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["i", "v"])

    parts = max(1, min(n, 2 * spark.sparkContext.defaultParallelism))
    return [r.v for r in sorted(spark.range(0, n, 1, parts).mapInArrow(tasks, f"i long, v array<{kind}>").collect())]


def scatter(fit: DataFrame, dim: int, n: int) -> tuple[list[int], list[list[int]]]:
    """(sums, matrix): the sum of each component, and n squared times the covariance, in whole numbers.

    Vectors are centred by the whole part of the mean before they are multiplied; what is left of the mean is subtracted exactly.
    """
    sums = _totals(fit, dim, lambda x: _dot(np.ones((1, len(x)), np.int64), x), "decimal(38,0)")
    total = [int(sums[0, j]) for j in range(dim)]
    middle = np.array([s // n for s in total], np.int64)
    rest = [s - n * int(m) for s, m in zip(total, middle)]
    squares = _totals(fit, dim, lambda x: _dot((x - middle).T, x - middle), "decimal(38,0)")
    return total, [[n * int(squares[i, j]) - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]


def principal_axes(spark: SparkSession, matrix: list[list[int]], count: int) -> tuple[list[Fraction], np.ndarray]:
    """The largest positive eigenvalues of a positive semi-definite whole-number matrix, falling, and unit vectors as columns.

    Remainders of the polynomial are found in tasks, one for each prime, and so are the vectors of each root. Equal eigenvalues
    have orthogonal vectors of their space.
    """
    primes = charpoly.primes_below(1 << 31, 2 * charpoly.coefficient_bound(matrix))
    rests = _each(spark, len(primes), lambda i: charpoly.polynomial_mod(matrix, primes[i]).tolist(), "long")
    roots = charpoly.largest_roots(charpoly.chinese(primes, rests), count)
    if not roots:
        return [], np.zeros((len(matrix), 0))
    flat = _each(spark, len(roots), lambda i: [float(x) for v in charpoly.null_vectors(matrix, *roots[i]) for x in v], "double")
    values = [Fraction(a, 1 << power) for a, power, copies in roots for _ in range(copies)]
    return values[:count], np.array([x for v in flat for x in v]).reshape(-1, len(matrix)).T[:, :count]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, count: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that remains and component up to ``count``.

    Entries become whole numbers ``floor(scale * x) + shift``. Left out are rows whose vector is null or empty or holds null or non-finite
    entries, or entries so large that ``scale * x`` is 2^40 or more; and those whose length isn't the commonest one (the greater of two as
    common). Each distinct vector counts once in the fit, so copies and repeated rows don't; all rows that remain come out, those
    with null ids too. Components with eigenvalue 0 can't be brought to variance 1 and don't come out; if all vectors are equal, or
    there are none, no rows do. ``deviation`` is null where it doesn't fit a long. Other columns are ignored.

    Sums and products are added up exactly by place, one matrix a task; the driver holds matrices of the dimension alone.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < ROOM)))
    rows = rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long") + shift).alias("x"))
    distinct = written(rows.select("x").distinct())
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], widened(rows.select("id"), schema))
    if sizes is None:
        return empty
    dim = sizes["dim"]
    rows, fit = rows.filter(F.size("x") == dim), distinct.filter(F.size("x") == dim)
    n = fit.count()
    total, matrix = scatter(fit, dim, n)
    values, axes = principal_axes(spark, matrix, count)
    k = len(values)
    if not k:
        return empty
    with localcontext(Context(prec=60)):
        lengths = np.array([float((Decimal(v.numerator) / Decimal(v.denominator)).sqrt()) for v in values])
    trace = sum(matrix[i][i] for i in range(dim))
    explained = [float(v / trace) for v in values]
    middle = np.array([s // n for s in total], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(total, middle)], np.int64)

    def apart(x: np.ndarray) -> np.ndarray:
        """n times a vector less the sums, in whole numbers."""
        y = x - middle
        return n * y - rest if n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62 else n * y.astype(object) - rest.astype(object)

    def projected(z: np.ndarray) -> np.ndarray:
        return z.astype(np.float64) @ axes / lengths

    means = _totals(fit, dim, lambda x: projected(apart(x)).sum(axis=0, keepdims=True), "double")
    mean = np.array([means[0, j] / n for j in range(k)])

    def squares(x: np.ndarray) -> np.ndarray:
        w = projected(apart(x)) - mean
        return w.T @ w

    found = _totals(fit, dim, squares, "double")
    error = max(abs(v / n - (i == j)) for (i, j), v in found.items())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            z = apart(_vectors(batch.column(1), dim))
            if len(z) and (z.dtype == object or float(np.abs(z).max()) ** 2 * dim >= 2.0**62):
                deviation = [v if v < 1 << 63 else None for v in (sum(int(a) * int(a) for a in row) for row in z)]
            else:
                deviation = (z * z).sum(axis=1)
            w = projected(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(np.arange(0, len(z) * k + 1, k, dtype=np.int32), pa.array(w.ravel()))], names=["id", "deviation", "w"])

    each = rows.mapInArrow(run, widened(rows.select("id"), "deviation long, w array<double>"))
    shares = F.array(*[F.lit(v) for v in explained])
    return each.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
