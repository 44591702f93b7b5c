"""Differences between runs, score histories and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _c(name: str) -> Column:
    return F.col(name)


def key_collisions(pages: DataFrame, key: str = "key") -> DataFrame:
    """Comparison keys that several addresses of one snapshot share."""
    return pages.groupBy(key).agg(F.countDistinct("url").alias("urls"), F.min("url").alias("first_url")).where("urls > 1")


def crawl_diff(current: DataFrame, baseline: DataFrame, fields: list[str], key: str = "key") -> DataFrame:
    """Added, removed and changed pages with the names of the changed fields."""
    side = lambda df: df.select(key, F.struct(*fields).alias("v"), F.lit(True).alias("there"))
    a, b = side(baseline).withColumnsRenamed({"v": "v0", "there": "t0"}), side(current).withColumnsRenamed({"v": "v1", "there": "t1"})
    changed = F.array_compact(F.array(*[F.when(~_c(f"v0.{f}").eqNullSafe(_c(f"v1.{f}")), F.lit(f)) for f in fields]))
    rows = a.join(b, key, "full_outer").withColumn("fields", F.when(_c("t0") & _c("t1"), changed).otherwise(F.array().cast("array<string>")))
    kind = F.when(_c("t0").isNull(), "added").when(_c("t1").isNull(), "removed").when(F.size("fields") > 0, "changed")
    return rows.select(key, kind.alias("kind"), "fields").where("kind IS NOT NULL")


def term_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages added, not observed, or with changed term sets; ``(page, term)`` rows on both sides."""
    both = before.select("page", "term").distinct().withColumn("old", F.lit(1)).unionByName(after.select("page", "term").distinct().withColumn("old", F.lit(0)))
    per = both.groupBy("page", "term").agg(F.max("old").alias("old"), F.max(1 - _c("old")).alias("new"))
    out = per.groupBy("page").agg(
        F.sum("old").alias("old_terms"), F.sum("new").alias("new_terms"), F.count_if((_c("old") == 0)).alias("added"), F.count_if(_c("new") == 0).alias("missing")
    )
    code = F.when(_c("old_terms") == 0, "url-added").when(_c("new_terms") == 0, "url-not-observed").when(_c("added") + _c("missing") > 0, "content-terms-changed")
    return out.select("page", code.alias("code"), "added", "missing").where("code IS NOT NULL")


def edge_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Edges only in the later run (added) or only in the earlier one (not observed)."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("code", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("code", F.lit("not-observed")))


def topic_coverage_changes(assignments: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Assigned pages a topic gained or lost between runs; ``assignments(topic, page)``."""
    rows = assignments.select("topic", "page").distinct()
    a, b = before.select("page").distinct().withColumn("old", F.lit(True)), after.select("page").distinct().withColumn("new", F.lit(True))
    return rows.join(a, "page", "left").join(b, "page", "left").groupBy("topic").agg(
        F.count_if(_c("new").isNotNull() & _c("old").isNull()).alias("gained"), F.count_if(_c("old").isNotNull() & _c("new").isNull()).alias("lost")
    ).where("gained + lost > 0")


def run_comparability(pairs: DataFrame) -> DataFrame:
    """Blocked, partial or comparable pairs of runs with reasons; columns prefixed ``a_`` and ``b_``.

    ``config`` is canonical text with sorted names, so equal settings are equal texts.
    """
    codes = F.array_compact(F.array(
        F.when(_c("a_run") == _c("b_run"), "same-run"), F.when(_c("a_project") != _c("b_project"), "different-project"),
        F.when(_c("a_project").isNull() | _c("b_project").isNull(), "project-unverified"), F.when(~_c("a_config").eqNullSafe(_c("b_config")), "different-scope"),
        F.when(_c("a_completed").isNull() | _c("b_completed").isNull(), "invalid-completion-time"), F.when(_c("a_cancelled"), "baseline-incomplete"), F.when(_c("b_cancelled"), "current-incomplete"),
    ))
    rows = pairs.withColumn("reasons", codes)
    return rows.withColumn("status", F.when(F.size("reasons") > 0, "blocked").when(_c("a_truncated") | _c("b_truncated"), "partial").otherwise("comparable"))


def score_trend(history: DataFrame) -> DataFrame:
    """Change to the previous run of the same project, profile and version; ``history(project, profile, version, run, at, score)``."""
    w = W.partitionBy("project", "profile", "version").orderBy("at", "run")
    return history.withColumn("previous", F.lag("score").over(w)).withColumn("delta", F.round(_c("score") - _c("previous"), 1)).withColumn(
        "reason", F.when(F.lag("run").over(w).isNull(), "first").when(_c("previous").isNull() | _c("score").isNull(), "unavailable")
    )


def score_drops(trend: DataFrame, points: float) -> DataFrame:
    return trend.where(-_c("delta") > points).select("project", "profile", "version", "run", "previous", "score", (-_c("delta")).alias("drop"))


def task_regressions(deltas: DataFrame, points: float) -> DataFrame:
    """Per project the number of failed tasks that lost ground and the worst of them."""
    lost = deltas.where("status = 'failed' AND delta < 0")
    out = lost.groupBy("project").agg(F.count("*").alias("tasks"), F.min_by("task", F.struct("delta", "task")).alias("worst_task"), F.min("delta").alias("worst"))
    return out.where(-_c("worst") >= points)


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Verified change of tasks that were implemented before and now have a verdict; ``(task, status, delta)``."""
    prior = before.where("status = 'implemented'").select("task").distinct()
    return after.where("delta IS NOT NULL AND status <> 'implemented'").join(prior, "task", "left_semi").select("task", "status", "delta")


def history_annotations(history: DataFrame, drop_points: float = 5) -> DataFrame:
    """Markers between consecutive snapshots: score drop, core topic change, configuration break.

    ``history(project, run, at, score, core, config)``; a project has few snapshots, so its window is small.
    """
    w = W.partitionBy("project").orderBy("at", "run")
    prev = F.lag(F.struct("score", "core", "config")).over(w)
    rows = history.withColumn("prev", prev)
    codes = F.array_compact(F.array(
        F.when(_c("prev.score") - _c("score") >= drop_points, "score-drop"), F.when(_c("prev.core") != _c("core"), "core-topic-changed"),
        F.when(_c("prev.config") != _c("config"), "configuration-break"),
    ))
    return rows.select("project", "run", F.round(_c("score") - _c("prev.score"), 1).alias("delta"), F.explode(codes).alias("code"))


def set_change(before: DataFrame, after: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Items added to and removed from each group's set."""
    both = before.select(*keys, item).distinct().withColumn("old", F.lit(1)).withColumn("new", F.lit(0)).unionByName(after.select(*keys, item).distinct().withColumn("old", F.lit(0)).withColumn("new", F.lit(1)))
    per = both.groupBy(*keys, item).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return per.groupBy(*keys).agg(F.count_if((_c("old") == 0)).alias("added"), F.count_if(_c("new") == 0).alias("removed"))


def entity_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """New and lost entities by folded name, the last spelling kept; ``(keys, entity)``."""
    from pagewright.functions import text

    side = lambda df: df.groupBy(*keys, text.fold(_c("entity")).alias("k")).agg(F.max("entity").alias("entity"))
    a, b = side(before), side(after)
    on = [*keys, "k"]
    return b.join(a, on, "left_anti").withColumn("code", F.lit("new")).unionByName(a.join(b, on, "left_anti").withColumn("code", F.lit("lost"))).drop("k")


def decay_states(history: DataFrame, shift: float = 0.1, entities: int = 3, min_samples: int = 3) -> DataFrame:
    """Result lists whose two latest snapshots both differ materially from the first.

    ``history(query, at, shift, entity_changes, intent, format)`` holds each snapshot compared with the first one.
    Only the first and the two latest snapshots of a query are kept, by aggregates.
    """
    first = F.min_by(F.struct("intent", "format"), "at")
    per = history.groupBy("query").agg(F.count("*").alias("samples"), first.alias("f"), F.max("at").alias("last_at"))
    last2 = history.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("at")))).where("r <= 2")
    rows = last2.join(per, "query").withColumn("reasons", F.array_compact(F.array(
        F.when(_c("shift") >= shift, "centroid"), F.when(_c("entity_changes") >= entities, "entities"), F.when(_c("intent") != _c("f.intent"), "intent"), F.when(_c("format") != _c("f.format"), "format"),
    )))
    out = rows.groupBy("query", "samples").agg(F.bool_and(F.size("reasons") > 0).alias("both"), F.max(F.when(_c("r") == 1, F.array_join("reasons", "+"))).alias("reasons"))
    state = F.when(_c("samples") < min_samples, "too-few-samples").when(_c("reasons") == "", "stable").when(~_c("both"), "not-persistent").otherwise("alert")
    return out.select("query", "samples", "reasons", state.alias("state"))


def speed_regressions(captures: DataFrame, max_days: int = 35, category_points: float = 5, metric_share: float = 0.2) -> DataFrame:
    """Worse category scores or slower metrics than the previous capture of the same page, strategy and scope.

    ``captures(url, strategy, scope, at, performance, lcp_ms, tbt_ms)``.
    """
    w = W.partitionBy("url", "strategy", "scope").orderBy("at")
    prev = F.lag(F.struct("at", "performance", "lcp_ms", "tbt_ms")).over(w)
    rows = captures.withColumn("p", prev).where(_c("p").isNotNull() & (F.datediff("at", _c("p.at")).between(1, max_days)))
    long = rows.select("url", "strategy", "scope", "at", F.explode(F.array(
        F.struct(F.lit("performance").alias("metric"), (_c("performance") - _c("p.performance")).alias("delta"), ((_c("performance") - _c("p.performance")) <= -category_points).alias("worse")),
        *[F.struct(F.lit(m).alias("metric"), (_c(m) - _c(f"p.{m}")).alias("delta"), (_c(m) > _c(f"p.{m}") * (1 + metric_share)).alias("worse")) for m in ("lcp_ms", "tbt_ms")],
    )).alias("d"))
    return long.where("d.worse").select("url", "strategy", "scope", "at", "d.metric", "d.delta")


def change_alert(changes: DataFrame, threshold: int, kind: str) -> DataFrame:
    """One row when a run difference holds at least as many changes as the threshold."""
    return changes.agg(F.count("*").alias("changes")).where(_c("changes") >= threshold).withColumn("alert", F.lit(kind))


def authority_alerts(reports: DataFrame, competitors: DataFrame, drop: float = 5, rise: float = 25) -> DataFrame:
    """Score drops of projects and competitors that gained coverage on a pillar between consecutive reports.

    ``reports(project, at, score)``, ``competitors(project, pillar, domain, at, coverage)``.
    """
    w = W.partitionBy("project").orderBy("at")
    a = reports.withColumn("before", F.lag("score").over(w)).where(_c("before") - _c("score") > drop).select(
        "project", "at", F.lit("score-drop").alias("code"), F.lit("").alias("detail"), F.round(_c("score") - _c("before"), 1).alias("delta")
    )
    v = W.partitionBy("project", "pillar", "domain").orderBy("at")
    b = competitors.withColumn("before", F.lag("coverage").over(v)).where(_c("coverage") - _c("before") >= rise).select(
        "project", "at", F.lit("competitor-expansion").alias("code"), F.concat_ws("/", "pillar", "domain").alias("detail"), F.round(_c("coverage") - _c("before"), 1).alias("delta")
    )
    return a.unionByName(b)


def alert_fingerprints(alerts: DataFrame, window: str) -> DataFrame:
    """First alert per fingerprint and run, day or week; ``alerts(type, source, evidence map, run, at)``."""
    canonical = F.array_join(F.transform(F.array_sort(F.map_keys("evidence")), lambda k: F.concat(k, F.lit("="), F.element_at("evidence", k))), "&")
    part = {"run": _c("run").cast("string"), "daily": F.date_trunc("day", "at").cast("string"), "weekly": F.date_trunc("week", "at").cast("string")}[window]
    rows = alerts.withColumn("fingerprint", F.concat_ws("|", "type", F.trim("source"), canonical)).withColumn("part", part)
    return rows.groupBy("fingerprint", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("repeats"))


def verify_tasks(tasks: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """Open tasks against a later run: done, open, or unknown where the page is missing, failed or cut off.

    ``tasks(task, type, url, target)``; ``pages(url, http_status, redirect_target, truncated, index_state, entity_share)``.
    """
    known = pages.groupBy("url").agg(F.min_by(F.struct("http_status", "redirect_target", "truncated", "index_state", "entity_share"), "http_status").alias("p"))
    edge = links.select(_c("source").alias("url"), "target").distinct().withColumn("linked", F.lit(True))
    rows = tasks.join(known, "url", "left").join(edge, ["url", "target"], "left")
    code = _c("p.http_status")
    unseen = _c("p").isNull() | (code == 0)
    result = (
        F.when(unseen, "unknown")
        .when(_c("type") == "add-link", F.when(_c("linked"), "done").when(_c("p.truncated"), "unknown").otherwise("open"))
        .when(_c("type") == "redirect", F.when(code.isin(301, 308) & (_c("p.redirect_target") == _c("target")), "done").otherwise("open"))
        .when(_c("type") == "remove", F.when(code == 410, "done").otherwise("open"))
        .when(_c("type") == "entities", F.when(_c("p.entity_share").isNull(), "unknown").when(_c("p.entity_share") >= 0.5, "done").otherwise("open"))
        .when(_c("type") == "index", F.when(_c("p.index_state") == "indexable", "done").otherwise("open"))
    )
    return rows.select("task", "type", result.alias("result"))
