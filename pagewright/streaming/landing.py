"""Log files that land in a folder, counted once, with late lines merged into the day they belong to.

A micro-batch writes partitions of its own number under each day, so a batch that runs again replaces what it wrote before.
Reading adds the parts up; compaction orders the visits of whole days and takes the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from pagewright.operators import logs as ops
from pagewright.sources import logs

FILES = "batch long, digest string, file string, lines long"
VISITS = "day date, batch long, at timestamp, path string, family string, verdict string, status int, bytes long, latency_ms double"
TOTALS = "batch long, lines long, parsed long, other long, first_at timestamp, last_at timestamp, days array<date>"
KEYS = ("day", "path", "family", "verdict")


def numbered_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of lines, plain or gzip, with the file each came from."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select("value", F.col("_metadata.file_path").alias("file"))


def file_digests(lines: DataFrame, file_col: str = "file", line_col: str = "value") -> DataFrame:
    """(file, digest, lines): a digest of the lines of each file, the same for a file, its compressed copy and a renamed one.

    Two sums over the hashes of lines and their number, so that a file of any size is digested in parts. The order of lines
    doesn't count.
    """
    line = F.coalesce(F.col(line_col), F.lit(""))
    big = lambda c: c.cast("decimal(38,0)")
    sums = lines.groupBy(F.col(file_col).alias("file")).agg(
        F.count("*").alias("lines"), F.sum(big(F.xxhash64(line))).alias("a"), F.sum(big(F.xxhash64(F.lit("second"), line))).alias("b")
    )
    return sums.select("file", F.concat_ws(":", F.col("lines").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"), "lines")


def fresh_files(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """One file, the least, of each content that the manifest (``digest``) doesn't hold."""
    one = digests.groupBy("digest").agg(F.min("file").alias("file"), F.max("lines").alias("lines"))
    return one.join(manifest.select("digest").distinct(), "digest", "left_anti")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, empty before anything is written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _replace(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def land_batch(batch: DataFrame, number: int, table: str, latency_unit: str = "seconds", bounds: DataFrame | None = None) -> None:
    """Write one micro-batch of lines ``(value, file)`` into the tables ``files``, ``visits`` and ``totals`` under ``table``.

    Files whose content an earlier batch imported, or another file of this one holds, are left out. With published ranges
    each visit gets its verdict; without, all are claimed. Addresses aren't stored. Writing the same batch again changes nothing.
    """
    spark = batch.sparkSession
    before = stored(spark, f"{table}/files", FILES).where(F.col("batch") < number)
    new = fresh_files(file_digests(batch), before).select(F.lit(number).cast("long").alias("batch"), "digest", "file", "lines")
    _replace(new, f"{table}/files", "batch")
    new = stored(spark, f"{table}/files", FILES).where(F.col("batch") == number)

    hits = logs.parse_lines(batch.join(new.select("file"), "file", "left_semi"), latency_unit)
    verdicts = hits.where("at IS NOT NULL").withColumn("verdict", F.lit("claimed")) if bounds is None else ops.with_verdict(hits.where("at IS NOT NULL"), ops.verify_by_range(hits, bounds))
    seen = Observation(f"landed {number}")
    bot = F.col("family").isNotNull() & F.col("status").between(200, 599)
    counted = verdicts.observe(
        seen, F.count("*").alias("parsed"), F.count_if(~bot).alias("other"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.collect_set(F.to_date("at")).alias("days"),
    )
    visits = counted.where(bot).select(F.to_date("at").alias("day"), F.lit(number).cast("long").alias("batch"), "at", "path", "family", "verdict", "status", "bytes", "latency_ms")
    _replace(visits, f"{table}/visits", "day", "batch")
    got = seen.get
    lines = new.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    row = (number, lines, got["parsed"], got["other"], got["first_at"], got["last_at"], sorted(got["days"] or []))
    _replace(spark.createDataFrame([row], TOTALS), f"{table}/totals", "batch")


def run_landing(lines: DataFrame, table: str, checkpoint: str, **options) -> None:
    """Import what has landed and stop; a later call goes on from the checkpoint."""
    query = lines.writeStream.foreachBatch(lambda batch, number: land_batch(batch, number, table, **options))
    query.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def import_state(spark: SparkSession, table: str) -> DataFrame:
    """One row: lines, malformed, other (not from a crawler), first_at, last_at, days of all batches."""
    rows = stored(spark, f"{table}/totals", TOTALS)
    return rows.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.col("lines") - F.col("parsed")), F.lit(0)).alias("malformed"), F.coalesce(F.sum("other"), F.lit(0)).alias("other"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"),
    )


def partial_counts(visits: DataFrame) -> DataFrame:
    """Sums of visits per day, path, family and verdict that can be added to sums of later ones."""
    band = lambda n: F.count_if(F.floor(F.col("status") / 100) == n).alias(f"status_{n}xx")
    return visits.groupBy(*KEYS).agg(
        F.count("*").alias("hits"), *[band(n) for n in (2, 3, 4, 5)], F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("latency_sum_ms"), F.count("latency_ms").alias("latency_count"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


def merged_counts(parts: DataFrame) -> DataFrame:
    """Partial counts of the same key added up; a late part moves the first and the last visit outwards."""
    sums = ("hits", *[f"status_{n}xx" for n in (2, 3, 4, 5)], "latency_sum_ms", "latency_count", "bytes")
    return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in sums], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def day_counts(spark: SparkSession, table: str) -> DataFrame:
    """Counts per day, path, family and verdict of all that has landed; a filter on ``day`` reads those days only."""
    return partial_counts(stored(spark, f"{table}/visits", VISITS))


def compact_days(spark: SparkSession, table: str, since: str, until: str) -> DataFrame:
    """Write ``compact``: counts with the gaps between visits, in the order of their times, of the days from since to until.

    Days are read whole, late batches included, and replaced, so compacting again after more lines is right again. Gaps are
    those inside a day.
    """
    visits = stored(spark, f"{table}/visits", VISITS).where(F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    by_day = visits.withColumn("path", F.struct("day", "path"))
    counts = ops.bot_aggregate(by_day).withColumn("day", F.col("path.day")).withColumn("path", F.col("path.path"))
    _replace(counts, f"{table}/compact", "day")
    return spark.read.schema(counts.schema).parquet(f"{table}/compact")
