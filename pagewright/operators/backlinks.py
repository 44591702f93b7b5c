"""Backlink profiles, gaps and link values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions import numbers, urls


def _c(name: str) -> Column:
    return F.col(name)


def referring_domains(links: DataFrame) -> DataFrame:
    """Distinct source hosts per target address."""
    return links.select(urls.url_key(_c("target_url"), "identity").alias("url_key"), urls.host(_c("source_url")).alias("host")).where("host <> ''").groupBy("url_key").agg(
        F.countDistinct("host").alias("domains")
    )


def link_profile(links: DataFrame) -> DataFrame:
    """Per linking domain: raw, followed, distinct pages, targets and anchors, and how the link repeats."""
    rows = links.withColumn("domain", urls.registrable_domain(urls.host(_c("source_url"))))
    out = rows.groupBy("domain").agg(
        F.count("*").alias("links"), F.count_if("is_dofollow").alias("follow"), F.count_if(~_c("is_dofollow")).alias("nofollow"),
        F.countDistinct("source_url").alias("pages"), F.countDistinct("target_url").alias("targets"), F.countDistinct(F.lower(F.trim("anchor_text"))).alias("anchors"),
    )
    kind = F.when((_c("pages") >= 5) & (_c("anchors") <= 2), "sitewide").when(_c("links") > 1, "repeated").otherwise("single")
    return out.withColumn("pattern", kind)


def gap_targets(opportunities: DataFrame, competitor_count: int, max_spam: float = 60) -> DataFrame:
    """Domains that link to competitors and not to us, most shared first.

    ``opportunities(referring_domain, target_backlinks, competitors array<struct<domain,backlinks,rank>>, max_spam)``.
    """
    rows = opportunities.where((_c("target_backlinks") == 0) & (F.coalesce("max_spam", F.lit(0.0)) < max_spam))
    each = rows.select("referring_domain", F.explode("competitors").alias("c"))
    per = each.groupBy("referring_domain").agg(
        F.countDistinct("c.domain").alias("competitors"), F.max("c.rank").alias("authority"), F.sum("c.backlinks").alias("links")
    )
    relevance = _c("competitors") / float(competitor_count)
    authority = F.coalesce(F.least(F.lit(1.0), _c("authority") / 100.0), F.lit(0.0))
    return per.select(
        "referring_domain", "competitors", "links", relevance.alias("relevance"), authority.alias("authority"), (0.6 * relevance + 0.4 * authority).alias("priority")
    )


def best_link_value(links: DataFrame, topic: list[float] | Column, scale: float = 100.0) -> DataFrame:
    """Value of a profile: per domain only its best followed link counts, authority times topical fit.

    ``links(profile, source_url, authority, follow, vector)``; links without a vector or authority are reported, not guessed.
    """
    target = topic if isinstance(topic, Column) else F.array(*[F.lit(float(x)) for x in topic])
    fit = numbers.safe_cosine(_c("vector"), target)
    value = F.least(F.lit(1.0), _c("authority") / scale) * F.greatest(F.lit(0.0), fit)
    rows = links.withColumn("domain", urls.registrable_domain(urls.host(_c("source_url")))).withColumn("value", F.when(_c("follow"), value))
    per = rows.groupBy("profile", "domain").agg(F.max("value").alias("best"), F.count_if(_c("follow") & value.isNull()).alias("unscored"), F.count_if("follow").alias("followed"))
    return per.groupBy("profile").agg(
        F.sum("best").alias("value"), F.count("best").alias("scored_domains"), F.count("*").alias("domains"), F.sum("unscored").alias("unscored_links"), F.sum("followed").alias("followed_links")
    )
