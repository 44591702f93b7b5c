"""Streaming jobs: log ingest, day windows, replay guard, first-seen and alert de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.sources import logs


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of files that land in a folder; the checkpoint remembers which files were read."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def daily_bot_counts(lines: DataFrame, late: str = "1 day") -> DataFrame:
    """Visits per UTC day, path, family and status class; late lines count until the watermark passes their day."""
    hits = logs.parse_lines(lines).where("family IS NOT NULL").withWatermark("at", late)
    return hits.groupBy(F.window("at", "1 day").alias("w"), "path", "family", F.floor(F.col("status") / 100).alias("status_class")).agg(
        F.count("*").alias("hits"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    ).select(F.to_date("w.start").alias("day"), "path", "family", "status_class", "hits", "bytes", "first_at", "last_at")


def once_per_line(lines: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Drop lines that a replayed file brings again, within the watermark."""
    return lines.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def first_seen(urls: DataFrame, registry: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows of each (project, url) that the registry table doesn't hold, once.

    What was seen stays in the registry, which the caller appends the output to and which is read anew for every batch, so
    an address never counts as first again. Only repeats that come before they are registered need state, kept for ``late``.
    """
    new = urls.join(registry.select("project", "url").distinct(), ["project", "url"], "left_anti")
    return new.withWatermark("at", late).dropDuplicatesWithinWatermark(["project", "url"])


def alerts_with_cooldown(alerts: DataFrame, cooldown: str = "7 days") -> DataFrame:
    """One alert per fingerprint within the cooldown."""
    return alerts.withWatermark("at", cooldown).dropDuplicatesWithinWatermark(["fingerprint"])


def replay_runs(events: DataFrame) -> DataFrame:
    """State of each run from its event rows: must begin with ``started``; a terminal event closes it.

    ``events(run, seq, kind, at, valid)``. Only aggregates move, so a run of any length is summed in parts.
    """
    terminal = F.col("kind").isin("completed", "failed", "cancelled")
    per = events.groupBy("run").agg(
        F.min_by("kind", "seq").alias("first_kind"), F.max_by(F.when(terminal, F.col("kind")), F.when(terminal, F.col("seq"))).alias("closing"),
        F.count_if((F.col("kind") == "page") & F.col("valid")).alias("pages"), F.count_if((F.col("kind") == "page") & ~F.col("valid")).alias("invalid"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )
    state = F.when(F.col("first_kind") != "started", "malformed").otherwise(F.coalesce("closing", F.lit("running")))
    return per.select("run", state.alias("state"), "pages", "invalid", "first_at", "last_at")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has landed and stop; a later call goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
