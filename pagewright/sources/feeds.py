"""Landed feeds and sitemaps: results as RSS, trend tables as CSV, sitemap files followed over their indexes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions import status, urls
from pagewright.session import cut_lineage

_RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string>>>"
# The names a trend table's columns go by.
TREND_COLUMNS = {"keyword": ("keyword", "trend", "trends"), "traffic": ("trafficlabel", "searchvolume", "traffic"), "started": ("startedat", "started", "pubdate")}


def rss_results(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((keyword, rank, url, title), rejected feeds) of result feeds ``(keyword, text)``.

    The rank is the place of the item among those of the channel. Items without a web address are left out and keep their
    place. Texts that aren't RSS with a channel, or that declare a document type or entities, are rejected.
    """
    doc = F.when(F.col("text").rlike(r"(?is)^\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<rss\b") & ~F.col("text").rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)\b"), F.col("text"))
    read = feeds.withColumn("_d", F.from_xml(doc, F.lit(_RSS)))
    ok = F.col("_d.channel").isNotNull()
    items = read.where(ok).select("keyword", F.posexplode(F.coalesce("_d.channel.item", F.array().cast("array<struct<title:string,link:string,pubDate:string>>"))).alias("at", "i"))
    rows = items.select("keyword", (F.col("at") + 1).cast("int").alias("rank"), F.trim("i.link").alias("url"), F.trim("i.title").alias("title"))
    return rows.where(urls.url_key(F.col("url"), "ranked").isNotNull()), read.where(~F.coalesce(ok, F.lit(False))).drop("_d")


def traffic_volume(label: Column) -> Column:
    """The number of a label such as ``200K+``, ``1.5M`` or ``2,000``; null where it has none."""
    plain = F.upper(F.regexp_replace(label, r"[\s,+]", ""))
    number = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?)[KMB]?$", 1).try_cast("decimal(20,4)")
    return (number * F.when(plain.endswith("K"), 1000).when(plain.endswith("M"), 1_000_000).when(plain.endswith("B"), 1_000_000_000).otherwise(1)).cast("long")


def trend_rows(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, traffic, volume, started) of trend tables as CSV, quoted cells over several lines included.

    Columns are found by their names in any case and spelling; without a keyword column, or with two of a kind, it is an error.
    A start that isn't a time is null. Rows without a keyword are left out.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c: re.sub(r"[\s_-]", "", c.lower().lstrip("﻿")) for c in rows.columns}
    found: dict[str, str] = {}
    for kind, known in TREND_COLUMNS.items():
        of = [c for c, n in names.items() if n in known]
        if len(of) > 1:
            raise ValueError(f"two columns for {kind}: {of}")
        if of:
            found[kind] = of[0]
    if "keyword" not in found:
        raise ValueError("no keyword column")
    get = lambda kind: F.col(f"`{found[kind]}`") if kind in found else F.lit(None).cast("string")
    typed = rows.select(F.trim(get("keyword")).alias("keyword"), F.trim(get("traffic")).alias("traffic"), get("started").try_cast("timestamp").alias("started"))
    return typed.where("keyword <> ''").select("keyword", "traffic", traffic_volume(F.col("traffic")).alias("volume"), "started")


def sitemap_locations(files: DataFrame) -> DataFrame:
    """(file, is_index, location) of landed sitemap files ``(file, text)``."""
    found = F.regexp_extract_all("text", F.lit(r"(?is)<loc\s*>\s*(.*?)\s*</loc>"), F.lit(1))
    plain = lambda u: F.trim(F.replace(F.regexp_replace(u, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"), F.lit("&amp;"), F.lit("&")))
    # What a file is, is told before its locations become rows: each row would read the whole text again.
    per = files.select("file", F.lower("text").contains("<sitemapindex").alias("is_index"), F.transform(found, plain).alias("locations"))
    return per.select("file", "is_index", F.explode("locations").alias("location")).where("location <> ''")


def discovered_urls(files: DataFrame, seeds: DataFrame, host: str, path: str | None = None, subdomains: bool = False, allowed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((url, sitemaps), (sitemap, depth, loaded)) that follow from seed sitemaps ``(file)`` over any number of indexes.

    An index leads to sitemaps of the host, a sitemap to addresses of the host and path. Rounds end when no sitemap is new, so
    cycles end too; each sitemap is followed once, from its least depth. A sitemap that didn't land, or that is no sitemap, isn't
    loaded. Files are read once; a round joins the sitemaps that are new with the links between files.
    """
    within = lambda c, where: status.in_scope(c, host, subdomains=subdomains, path=where, allowed=allowed)
    key = lambda c: urls.crawl_key(F.col(c))
    landed = files.select(key("file").alias("file"), "text").where("file IS NOT NULL")
    entries = cut_lineage(sitemap_locations(landed))
    links = cut_lineage(entries.where(F.col("is_index") & within(F.col("location"), None)).select("file", key("location").alias("next")).where("next IS NOT NULL").distinct())
    new = seeds.select(key("file").alias("sitemap")).where(F.col("sitemap").isNotNull() & within(F.col("sitemap"), None)).distinct()
    reached, depth = cut_lineage(new.withColumn("depth", F.lit(0))), 0
    new = reached.select("sitemap")
    while not new.isEmpty():
        depth += 1
        found = new.join(links, new.sitemap == links.file).select(F.col("next").alias("sitemap")).distinct()
        step = cut_lineage(found.join(reached.select("sitemap"), "sitemap", "left_anti").withColumn("depth", F.lit(depth)))
        reached, new = reached.union(step), step.select("sitemap")
    got = landed.select(F.col("file").alias("sitemap")).distinct().withColumn("there", F.lit(True))
    pages = entries.where(~F.col("is_index") & within(F.col("location"), path)).join(reached.select(F.col("sitemap").alias("file")), "file", "left_semi")
    listed = pages.select(key("location").alias("url"), "file").where("url IS NOT NULL").distinct().groupBy("url").agg(F.count("*").alias("sitemaps"))
    return listed, reached.join(got, "sitemap", "left").select("sitemap", "depth", F.coalesce("there", F.lit(False)).alias("loaded"))
