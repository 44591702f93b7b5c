"""Join and window shapes that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Whole row with the largest order per key: an aggregate, so rows shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """k first rows per key. Spark limits each map side to k rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def with_group_total(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Rows with totals of their group, by a pre-aggregated join instead of a window over the group."""
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    return df.join(sums, list(keys))


def gaps(df: DataFrame, keys: Sequence[str], at: str, seconds: int = 3600) -> DataFrame:
    """Milliseconds since the previous event of the key.

    Events are cut into time buckets; only the last time of each bucket crosses into the next, so the widest
    window holds one bucket of one key, and the window over a key holds one row per bucket.
    """
    rows = df.withColumn("_ms", F.unix_millis(at)).withColumn("_b", F.floor(F.col("_ms") / (seconds * 1000)))
    inner = W.partitionBy(*keys, "_b").orderBy("_ms")
    ends = rows.groupBy(*keys, "_b").agg(F.max("_ms").alias("_end"))
    carry = ends.withColumn("_before", F.lag("_end").over(W.partitionBy(*keys).orderBy("_b"))).drop("_end")
    return (
        rows.withColumn("_prev", F.lag("_ms").over(inner)).join(carry, [*keys, "_b"])
        .withColumn("gap_ms", F.col("_ms") - F.coalesce("_prev", "_before")).drop("_ms", "_b", "_prev", "_before")
    )


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: Column, right_time: Column,
         payload: Column, bucket: int, strict: bool, name: str) -> DataFrame:
    """Left rows with the payload of the nearest earlier right row; equal times count unless ``strict``.

    Times are whole numbers; pass negated times to look forward. Windows run inside one time bucket of a key, and
    one row per bucket is carried on, so no pairs are formed and no window holds a whole hot key. Payloads of
    equal time are settled by their largest value.
    """
    r = right.select(*keys, right_time.cast("long").alias("_t"), payload.alias("_p")).where("_t IS NOT NULL")
    r = r.groupBy(*keys, "_t").agg(F.max("_p").alias("_p"))
    kind = r.schema["_p"].dataType
    lrows = left.select(*keys, left_time.cast("long").alias("_t"), F.struct(*left.columns).alias("_l"))
    lkind = lrows.schema["_l"].dataType
    both = (
        r.withColumn("_l", F.lit(None).cast(lkind)).withColumn("_side", F.lit(1 if strict else 0))
        .unionByName(lrows.withColumn("_p", F.lit(None).cast(kind)).withColumn("_side", F.lit(0 if strict else 1)))
        .withColumn("_b", F.floor(F.col("_t") / bucket))
    )
    within = W.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    per_bucket = both.groupBy(*keys, "_b").agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("_t"))).alias("_last"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    hit = both.withColumn("_in", F.last("_p", ignorenulls=True).over(within)).where("_l IS NOT NULL")
    return hit.join(carry, [*keys, "_b"], "left").select("_l.*", F.coalesce("_in", "_carry").alias(name))


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, *order: Column, name: str = "nr") -> DataFrame:
    """Running number per key in the given order.

    ``bucket`` must never fall along that order. Numbers are counted inside a bucket and shifted by the sizes of the
    earlier buckets, so no window holds a whole hot key.
    """
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = rows.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    return inner.join(shift, [*keys, "_b"]).withColumn(name, F.col("_i") + F.col("_shift")).drop("_b", "_i", "_shift")
