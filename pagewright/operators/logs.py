"""Crawler-visit analytics over parsed access-log rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions import numbers
from pagewright.operators import shapes
from pagewright.sources.logs import OFFICIAL_SUFFIXES


@dataclass(frozen=True)
class MatrixRules:
    window_days: int = 30
    min_coverage_days: int = 27
    starvation_max_hits: int = 2
    waste_max_score: float = 45
    waste_min_hits: int = 25
    include_claimed: bool = False


def verify_by_range(hits: DataFrame, bounds: DataFrame) -> DataFrame:
    """(ip, family, verdict): verified inside a published range, spoofed outside, claimed where none is published or the address is malformed.

    Addresses are made distinct first and cut to each prefix length that the ranges of their version have, at most 161
    in all, so the join is an equality join on the prefix.
    """
    ips = hits.where("family IS NOT NULL").select("ip", "family").distinct().withColumn("a", numbers.address_bits(F.col("ip")))
    lengths = bounds.select("family", "version", "bits").distinct().groupBy("family").agg(F.collect_set(F.struct("version", "bits")).alias("lengths"))
    own = F.filter("lengths", lambda x: F.length("a") == F.when(x["version"] == 4, 32).otherwise(128))
    cut = ips.join(lengths, "family").select("ip", "family", "a", F.explode(own).alias("x")).select("ip", "family", F.col("x.version").alias("version"), F.expr("substring(a, 1, x.bits)").alias("prefix"))
    inside = cut.join(bounds.select("family", "version", "prefix").distinct(), ["family", "version", "prefix"]).select("ip", "family").distinct().withColumn("hit", F.lit(True))
    published = bounds.select("family").distinct().withColumn("published", F.lit(True))
    rows = ips.join(inside, ["ip", "family"], "left").join(published, "family", "left").withColumn("judged", F.col("published") & F.col("a").isNotNull())
    return rows.select(
        "ip", "family", F.when(F.col("hit"), "verified").when(F.col("judged"), "spoofed").otherwise("claimed").alias("verdict"),
        F.when(F.col("judged"), "published-ranges").otherwise("none").alias("method"),
    )


def verify_by_host(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdict from supplied name-server answers ``(ip, host, forward_ips array)``; no answer leaves a claim."""
    ips = hits.where("family IS NOT NULL").select("ip", "family").distinct()
    official = F.lit(False)
    for family, suffixes in OFFICIAL_SUFFIXES.items():
        for suffix in suffixes:
            official = official | ((F.col("family") == family) & F.regexp_replace(F.lower("host"), r"\.$", "").endswith(suffix))
    rows = ips.join(answers, "ip", "left").withColumn("ok", official & F.array_contains("forward_ips", F.col("ip")))
    judged = rows.groupBy("ip", "family").agg(F.max(F.coalesce("ok", F.lit(False))).alias("ok"), F.count("host").alias("answers"))
    known = F.col("family").isin(*OFFICIAL_SUFFIXES)
    return judged.select(
        "ip", "family", F.when(F.col("ok"), "verified").when(known & (F.col("answers") > 0), "spoofed").otherwise("claimed").alias("verdict"),
        F.when(known & (F.col("answers") > 0), "reverse-forward-dns").otherwise("none").alias("method"),
    )


def verification_summary(verdicts: DataFrame) -> DataFrame:
    """Checks by method and verdict, one per (ip, family)."""
    return verdicts.dropDuplicates(["ip", "family"]).groupBy("method", "verdict").agg(F.count("*").alias("checks"))


def with_verdict(hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    return hits.join(verdicts.select("ip", "family", "verdict"), ["ip", "family"], "left")


def visit_gaps(hits: DataFrame) -> DataFrame:
    """Time since the previous visit of the same path, family and verdict."""
    return shapes.gaps(hits.where("family IS NOT NULL"), ["path", "family", "verdict"], "at")


def bot_aggregate(hits: DataFrame, seconds: int = 3600) -> DataFrame:
    """Mergeable sums per path, family and verdict.

    Visits meet once, in buckets of time; there the sums, the ends and the widest inner gap are taken. The gaps between
    buckets and the totals need one row per bucket. Gaps add up to last minus first.
    """
    keys = ["path", "family", "verdict"]
    bots = hits.where("family IS NOT NULL AND status BETWEEN 200 AND 599").select(*keys, "status", "latency_ms", "bytes", "at", F.unix_millis("at").alias("_ms"))
    rows = bots.withColumn("_b", F.floor(F.col("_ms") / (seconds * 1000)))
    band = lambda n: F.count_if(F.floor(F.col("status") / 100) == n).alias(f"status_{n}xx")
    inner = F.col("_ms") - F.lag("_ms").over(W.partitionBy(*keys, "_b").orderBy("_ms"))
    parts = rows.withColumn("_gap", inner).groupBy(*keys, "_b").agg(
        F.count("*").alias("hits"), *[band(n) for n in (2, 3, 4, 5)],
        F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("latency_sum_ms"), F.count("latency_ms").alias("latency_count"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("_gap").alias("_gap"),
    )
    carried = F.unix_millis("first_at") - F.unix_millis(F.lag("last_at").over(W.partitionBy(*keys).orderBy("_b")))
    sums = ("hits", *[f"status_{n}xx" for n in (2, 3, 4, 5)], "latency_sum_ms", "latency_count", "bytes")
    out = parts.withColumn("_carried", carried).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max(F.greatest("_gap", "_carried")).alias("max_gap_ms"),
    )
    return out.withColumn("gap_sum_ms", F.unix_millis("last_at") - F.unix_millis("first_at")).withColumn("gap_count", F.col("hits") - 1)


def log_coverage(hits: DataFrame, window_days: int = 30) -> DataFrame:
    """Distinct UTC days with lines inside the trailing window."""
    days = hits.select(F.to_date("at").alias("day")).distinct()
    end = days.agg(F.max("day")).scalar()
    return days.agg(
        F.count_if(F.col("day") >= F.date_sub(end, window_days - 1)).alias("coverage_days")
    ).withColumn("period_days", F.lit(window_days).cast("long"))


def crawl_verdict(score: Column, hits: Column, rules: MatrixRules) -> Column:
    return (
        F.when((score < rules.waste_max_score) & (hits > rules.waste_min_hits), "waste")
        .when(hits < rules.starvation_max_hits, "starvation").otherwise("ok")
    )


def crawl_matrix(scores: DataFrame, aggregate: DataFrame, coverage: DataFrame, rules: MatrixRules = MatrixRules()) -> DataFrame:
    """Paths of scores and logs with a verdict; hits are null, not zero, without any logs."""
    wanted = ["verified", "claimed"] if rules.include_claimed else ["verified"]
    seen = aggregate.where(F.col("verdict").isin(*wanted)).groupBy("path").agg(F.sum("hits").alias("hits"))
    days = coverage.agg(F.max("coverage_days")).scalar()
    rows = scores.join(seen, "path", "full_outer").withColumn("coverage_days", F.coalesce(days, F.lit(0)))
    none = F.col("coverage_days") == 0
    hits = F.when(~none, F.coalesce("hits", F.lit(0)))
    unsure = (F.col("coverage_days") < rules.min_coverage_days) | F.col("score").isNull()
    verdict = F.when(none, "no-logs").when(unsure, "inconclusive").otherwise(crawl_verdict(F.col("score"), hits, rules))
    return rows.select("path", "score", hits.alias("hits"), verdict.alias("verdict"))


def visit_evidence(pages: DataFrame, aggregate: DataFrame, coverage: DataFrame, family: str = "googlebot") -> DataFrame:
    """Verified visits per page path: measured zero where logs exist, unknown where they do not."""
    trimmed = lambda c: F.when(c == "/", c).otherwise(F.regexp_replace(c, "/+$", ""))
    seen = aggregate.where((F.col("family") == family) & (F.col("verdict") == "verified")).groupBy(trimmed(F.col("path")).alias("path")).agg(F.sum("hits").alias("hits"))
    days = coverage.agg(F.max("coverage_days")).scalar()
    rows = pages.withColumn("path", trimmed(F.col("path"))).join(seen, "path", "left").withColumn("_d", F.coalesce(days, F.lit(0)))
    return rows.withColumn("bot_hits", F.when(F.col("_d") > 0, F.coalesce("hits", F.lit(0)))).withColumn(
        "state", F.when(F.col("_d") > 0, "measured").otherwise("unavailable")
    ).drop("_d", "hits")


def missing_days(hits: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Days that have no line, from the first to the last day of ``whole``, by default of the lines themselves."""
    days = hits.select(F.to_date("at").alias("day")).distinct()
    span = (hits if whole is None else whole).agg(F.to_date(F.min("at")).alias("a"), F.to_date(F.max("at")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(days, "day", "left_anti")


def calibrate_matrix(cases: DataFrame, defaults: MatrixRules = MatrixRules()) -> DataFrame:
    """Threshold triple with fewest wrong verdicts on labelled ``(score, hits, verdict)`` cases, nearest the defaults on ties.

    Equal cases are counted once; each case carries the fixed grid as an array, so nothing is paired by a join.
    """
    grid = F.array(*[
        F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(s).alias("s"), F.lit(
            abs(w - defaults.waste_max_score) + abs(h - defaults.waste_min_hits) + abs(s - defaults.starvation_max_hits)
        ).alias("distance"))
        for w in range(30, 61, 5) for h in range(5, 51, 5) for s in range(1, 6)
    ])
    counted = cases.groupBy("score", "hits", "verdict").agg(F.count("*").alias("n"))
    tried = counted.select("score", "hits", "verdict", "n", F.explode(grid).alias("g"))
    guess = F.when((F.col("score") < F.col("g.w")) & (F.col("hits") > F.col("g.h")), "waste").when(F.col("hits") < F.col("g.s"), "starvation").otherwise("ok")
    errors = tried.groupBy("g").agg(F.sum(F.when(guess != F.col("verdict"), F.col("n")).otherwise(0)).alias("errors"), F.sum("n").alias("cases"))
    best = errors.agg(F.min_by(F.struct("g", "errors", "cases"), F.struct("errors", "g.distance", "g.w", "g.h", "g.s")).alias("b"))
    return best.select(
        F.col("b.g.w").cast("long").alias("waste_max_score"), F.col("b.g.h").cast("long").alias("waste_min_hits"),
        F.col("b.g.s").cast("long").alias("starvation_max_hits"), F.col("b.errors").alias("errors"), F.col("b.cases").alias("cases"),
    )


def first_seen_recent(seen: DataFrame, hours: int = 24) -> DataFrame:
    """URLs first seen within the last hours of ``(project, url, at)``; a project's first registration is its baseline."""
    per_url = seen.groupBy("project", "url").agg(F.min("at").alias("first_at"))
    # Project bounds come from the reduced table, not from a window over a project.
    bounds = per_url.groupBy("project").agg(F.min("first_at").alias("baseline")).join(seen.groupBy("project").agg(F.max("at").alias("now")), "project")
    return per_url.join(bounds, "project").where(
        (F.col("first_at") > F.col("baseline")) & (F.col("first_at") >= F.col("now") - F.make_dt_interval(hours=F.lit(hours)))
    ).select("project", "url", "first_at")


def hash_chain_break(log: DataFrame) -> DataFrame:
    """First entry per log whose hash or back reference is wrong; ``(log, seq, payload, prev_hash, hash)``.

    Every entry is checked against its predecessor by an equality join on the running number.
    """
    before = log.select("log", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("expected_prev"))
    rows = log.join(before, ["log", "seq"], "left")
    own = F.sha2(F.concat_ws("|", F.col("prev_hash"), F.col("seq").cast("string"), F.col("payload")), 256)
    bad = (F.col("hash") != own) | (F.col("prev_hash") != F.coalesce("expected_prev", F.lit("")))
    return rows.groupBy("log").agg(F.min(F.when(bad, F.col("seq"))).alias("broken_at"), F.count("*").alias("entries"))
