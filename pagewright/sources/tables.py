"""Table scans with stated schemas, imports with rejects, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions import urls
from pagewright.operators import shapes

RANKED = "keyword string, rank int, url string, title string"
REVENUE = "landing_page string, revenue decimal(18,4), currency string"
TREND = "keyword string, volume bigint, started timestamp"


def read_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of a CSV with a stated schema; nothing is inferred."""
    rows = spark.read.schema(schema + ", _bad string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    return rows.where("_bad IS NULL").drop("_bad"), rows.where("_bad IS NOT NULL")


def ranked_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked rows that name a keyword, a positive rank and a web address; the others are rejects."""
    ok = (F.trim("keyword") != "") & (F.col("rank") > 0) & urls.url_key(F.col("url"), "ranked").isNotNull()
    flagged = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return flagged.where("_ok").drop("_ok"), flagged.where("NOT _ok").drop("_ok")


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of result feeds."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """Addresses declared by sitemap files."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).select(F.trim("loc").alias("url"), F.to_date("lastmod").alias("lastmod")).distinct()


def url_list(rows: DataFrame, column: str) -> DataFrame:
    """Distinct web addresses of a column, with how often each stood there; null holds the invalid ones."""
    return rows.groupBy(urls.url_key(F.col(column), "gate").alias("url")).agg(F.count("*").alias("rows"))


def captions(files: DataFrame) -> DataFrame:
    """Cues of caption texts ``(file, text)``: start and end in ms and the text."""
    stamp = r"(\d{2,}:)?(\d{2}):(\d{2})[.,](\d{3})"
    cue = files.select("file", F.posexplode(F.split("text", r"\r?\n\s*\r?\n")).alias("pos", "cue")).where(F.col("cue").rlike(stamp + r"\s*-->\s*" + stamp))

    def ms(group: int) -> Column:
        part = lambda n: F.regexp_extract("cue", stamp + r"\s*-->\s*" + stamp, group + n)
        hours = F.coalesce(F.regexp_replace(part(0), ":", "").try_cast("long"), F.lit(0))
        return ((hours * 60 + part(1).cast("long")) * 60 + part(2).cast("long")) * 1000 + part(3).cast("long")

    body = F.trim(F.regexp_replace(F.regexp_replace("cue", r"(?s)^.*-->[^\n]*\n?", ""), r"\s+", " "))
    return cue.select("file", "pos", ms(1).alias("start_ms"), ms(5).alias("end_ms"), body.alias("text")).where("text <> ''")


def unseen_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content was not imported before; one of several equal copies."""
    digest = files.withColumn("content_hash", F.sha2("content", 256))
    one = digest.groupBy("content_hash").agg(F.min("path").alias("path"))
    return one.join(manifest.select("content_hash"), "content_hash", "left_anti")


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """Text cells that could run as a formula get a leading quote."""
    def safe(name: str) -> Column:
        return F.when(F.col(name).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), name)).otherwise(F.col(name)).alias(name)

    return df.select(*[safe(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    spreadsheet_safe(df).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def replace_run(df: DataFrame, path: str, keys: tuple[str, ...] = ("site_id", "run_id")) -> None:
    """Replace only the partitions the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def list_runs(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site_id", "run_id").agg(F.count("*").alias("pages"), F.max("completed_at").alias("completed_at")).orderBy(F.desc("completed_at"), "run_id")


def page_slice(pages: DataFrame, offset: int, limit: int) -> DataFrame:
    return pages.orderBy("page_id").offset(offset).limit(limit)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write per key; taking the same rows again changes nothing."""
    return shapes.latest(existing.unionByName(incoming), keys, F.col(version))


def erase_subject(table: DataFrame, subjects: DataFrame, key: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, counts of what goes per subject)."""
    gone = subjects.select(key).distinct()
    return table.join(gone, key, "left_anti"), table.join(gone, key, "left_semi").groupBy(key).agg(F.count("*").alias("erased"))


def nested_export(pages: DataFrame, column: str) -> DataFrame:
    """One row per element of a nested array with its page."""
    return pages.select("page_id", "url", F.explode_outer(column).alias("e")).select("page_id", "url", "e.*")
