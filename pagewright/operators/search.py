"""Search-performance and traffic analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions import numbers, urls
from pagewright.operators import shapes
from pagewright.session import cut_lineage


def _c(name: str) -> Column:
    return F.col(name)


def valid_rows(rows: DataFrame) -> DataFrame:
    finite = lambda c: _c(c).isNotNull() & ~F.isnan(c) & (F.abs(_c(c)) < float("inf")) & (_c(c) >= 0)
    return rows.where(
        finite("position") & finite("clicks") & finite("impressions") & (_c("position") > 0) & (_c("impressions") > 0) & (_c("clicks") <= _c("impressions"))
    )


def same_filters(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Null-safe equality of search type, device and country; blank equals unset."""
    clean = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    ok = clean(left["country"]).eqNullSafe(clean(right["country"]))
    for name in ("search_type", "device"):
        a, b = (F.when(side[name] != "", side[name]) for side in (left, right))
        ok = ok & a.eqNullSafe(b)
    return ok


def is_full_scope(search_type: Column, device: Column, country: Column) -> Column:
    """Unfiltered web report."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (blank(search_type) | (search_type == "web").eqNullSafe(True)) & blank(device) & blank(country)


def near_top_ten(queries: DataFrame, low: float = 10, high: float = 20, min_impressions: float = 100) -> DataFrame:
    return valid_rows(queries).where((_c("position") > low) & (_c("position") <= high) & (_c("impressions") >= min_impressions)).orderBy(
        F.desc("impressions"), "position", "query"
    )


def striking_distance(queries: DataFrame, min_impressions: float = 100) -> DataFrame:
    return queries.where(_c("position").between(4, 20) & (_c("impressions") >= min_impressions)).orderBy(F.desc("impressions"), "query")


def merge_url_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: sums, recomputed rate, position weighted by impressions (plain mean without any)."""
    imp = F.sum("impressions")
    return rows.groupBy(*keys).agg(
        F.sum("clicks").alias("clicks"), imp.alias("impressions"),
        F.coalesce(F.try_divide(F.sum("clicks"), imp), F.lit(0.0)).alias("ctr"),
        numbers.js_round(F.coalesce(F.try_divide(F.sum(_c("position") * _c("impressions")), imp), F.avg("position")), 2).alias("position"),
    )


def join_traffic_evidence(landing: DataFrame, search: DataFrame, issues: DataFrame, root: str) -> DataFrame:
    """Landing-page rows with search and crawl facts of the same address.

    Search facts join only where both periods are equal; the first row per address counts.
    """
    host = urls.host(F.lit(root))
    own = F.regexp_replace(F.lower("host_name"), r"\.$", "") == host
    key = F.when(own, urls.url_key(urls.resolve(F.lit(root), _c("landing_page")), "identity"))
    facts = search.groupBy(urls.url_key(_c("page"), "identity").alias("url_key"), "start_date", "end_date").agg(
        F.min_by(F.struct("clicks", "impressions", "ctr", "position"), "page").alias("search")
    )
    crawl = issues.where("issues_count >= 0").groupBy(urls.url_key(_c("url"), "identity").alias("url_key")).agg(F.min_by("issues_count", "url").alias("crawl_issue_count"))
    return landing.withColumn("url_key", key).join(facts, ["url_key", "start_date", "end_date"], "left").join(crawl, "url_key", "left")


def url_telemetry(crawled: DataFrame, sources: dict[str, tuple[DataFrame, list[str], bool]]) -> DataFrame:
    """All addresses of all sources with per-source values and states.

    ``sources[name] = (rows keyed url_key, value columns, complete)``. A page absent from a complete report has a
    measured 0; absent from a sample or from an unavailable source it stays null. One union and one shuffle replace
    a chain of outer joins.
    """
    columns = {f"{name}_{v}": (name, v) for name, (_, values, _) in sources.items() for v in values}
    base = crawled.select("url_key", *[F.lit(None).cast("double").alias(c) for c in columns], *[F.lit(None).cast("boolean").alias(f"{n}_seen") for n in sources])
    for name, (rows, values, _) in sources.items():
        part = rows.select(
            "url_key", *[(_c(v).cast("double") if n == name else F.lit(None).cast("double")).alias(c) for c, (n, v) in columns.items()],
            *[F.lit(True if n == name else None).cast("boolean").alias(f"{n}_seen") for n in sources],
        )
        base = base.unionByName(part)
    merged = base.where("url_key IS NOT NULL").groupBy("url_key").agg(*[F.sum(c).alias(c) for c in columns], *[F.max(f"{n}_seen").alias(f"{n}_seen") for n in sources])
    out = ["url_key"]
    for name, (_, values, complete) in sources.items():
        seen = _c(f"{name}_seen").eqNullSafe(True)
        out += [F.when(seen, _c(f"{name}_{v}")).when(F.lit(complete), F.lit(0.0)).alias(f"{name}_{v}") for v in values]
        out.append(F.when(seen, "measured" if complete else "sampled").when(F.lit(complete), "measured").otherwise("missing").alias(f"{name}_state"))
    return merged.select(*out)


def node_traffic(nodes: DataFrame, rows: DataFrame, scope: str, truncated: bool) -> DataFrame:
    """Search facts on graph nodes given as ``(node, urls array)``.

    States: out-of-scope, ambiguous (an address claimed by several nodes), gsc, truncated or missing.
    """
    alias = nodes.select("node", F.posexplode("urls").alias("pos", "u")).select("node", "pos", urls.url_key(_c("u"), "gate").alias("url_key"))
    claims = alias.groupBy("url_key").agg(F.countDistinct("node").alias("claims"))
    facts = merge_url_rows(rows.withColumn("url_key", urls.url_key(_c("page"), "gate")).where(_c("url_key").startswith(scope)), ["url_key"])
    joined = alias.join(claims, "url_key").join(facts, "url_key", "left")
    per = joined.groupBy("node").agg(
        F.max(_c("url_key").startswith(scope)).alias("inside"), F.max("claims").alias("claims"),
        F.min_by(F.struct("clicks", "impressions", "position"), F.when(_c("impressions").isNotNull(), _c("pos"))).alias("m"), F.count("impressions").alias("found"),
    )
    gap = F.lit("truncated" if truncated else "missing")
    state = F.when(~_c("inside"), "out-of-scope").when(_c("claims") > 1, "ambiguous").when(_c("found") > 0, "gsc").otherwise(gap)
    keep = state == "gsc"
    return per.select("node", state.alias("state"), *[F.when(keep, _c(f"m.{n}")).alias(n) for n in ("clicks", "impressions", "position")])


def compare_periods(baseline: DataFrame, current: DataFrame, keys: list[str], min_impressions: float = 100, drop: float = -20) -> DataFrame:
    """Deltas of keys present in both periods; percent is null on a zero base."""
    side = lambda df, p: df.select(*keys, *[_c(n).alias(f"{p}_{n}") for n in ("clicks", "impressions")])
    rows = side(baseline, "base").join(side(current, "now"), keys)
    pct = lambda n: F.try_divide((_c(f"now_{n}") - _c(f"base_{n}")) * 100.0, _c(f"base_{n}"))
    falling = (_c("base_impressions") >= min_impressions) & (F.coalesce(pct("clicks") <= drop, F.lit(False)) | F.coalesce(pct("impressions") <= drop, F.lit(False)))
    return rows.select(
        *keys, "base_clicks", "now_clicks", (_c("now_clicks") - _c("base_clicks")).alias("clicks_delta"), pct("clicks").alias("clicks_pct"),
        (_c("now_impressions") - _c("base_impressions")).alias("impressions_delta"), pct("impressions").alias("impressions_pct"), falling.alias("potential_decline"),
    )


def comparable_periods(pairs: DataFrame) -> DataFrame:
    """Why two snapshots cannot be compared, or null; columns prefixed ``a_`` and ``b_``."""
    days = lambda p: F.datediff(_c(f"{p}_end"), _c(f"{p}_start")) + 1
    cols = lambda p: {n: _c(f"{p}_{n}") for n in ("search_type", "device", "country")}
    reason = (
        F.when(_c("a_site") != _c("b_site"), "different-property").when(~same_filters(cols("a"), cols("b")), "different-filters")
        .when(_c("a_id") == _c("b_id"), "same-period").when((days("a") < 1) | (days("b") < 1), "invalid-dates")
        .when(_c("a_end") >= _c("b_start"), "overlapping").when(days("a") != days("b"), "different-durations")
    )
    return pairs.withColumn("reason", reason)


def unmatched_keys(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys only in the first period."""
    return one.select(*keys).distinct().join(other.select(*keys).distinct(), keys, "left_anti")


def impression_share(rows: DataFrame) -> DataFrame:
    """Share of each page in its query's impressions."""
    return shapes.with_group_total(rows, ["query"], query_impressions=_c("impressions"), query_clicks=_c("clicks")).withColumn(
        "share", F.try_divide(_c("impressions") * 100.0, _c("query_impressions"))
    )


def query_cannibalization(rows: DataFrame, min_impressions: float = 20, min_share: float = 10) -> DataFrame:
    """Pages of queries where at least two pages reach both minimums."""
    strong = impression_share(rows).where((_c("impressions") >= min_impressions) & (_c("share") >= min_share))
    many = strong.groupBy("query").agg(F.count("*").alias("pages")).where("pages >= 2")
    return strong.join(many, "query")


def ctr_outliers(rows: DataFrame) -> DataFrame:
    """Rows whose rate is below half that of peers within one position, same query left out.

    Rows are first summed per exact position (and per query and position), then each sum is copied to its own and the
    neighbouring whole-position buckets, so a range window runs inside one bucket and never over the table.
    """
    ok = valid_rows(rows)
    sums = [F.sum("impressions").alias("i"), F.sum("clicks").alias("c"), F.count("*").alias("n")]

    def around(keys: list[str], prefix: str) -> DataFrame:
        points = ok.groupBy(*keys, "position").agg(*sums)
        home = F.floor("position")
        spread = points.withColumn("home", home).withColumn("bucket", F.explode(F.array(home - 1, home, home + 1)))
        w = W.partitionBy(*keys, "bucket").orderBy("position").rangeBetween(-1, 1)
        out = spread.select(*keys, "position", "home", "bucket", *[F.sum(x).over(w).alias(prefix + x) for x in "icn"])
        return out.where("home = bucket").drop("home", "bucket")

    every, own = around([], "all_"), around(["query"], "own_")
    wanted = ok.where("impressions >= 100").join(every, "position").join(own, ["query", "position"])
    peers_i, peers_c, peers_n = (_c("all_" + x) - _c("own_" + x) for x in "icn")
    peer_ctr, ctr = F.try_divide(peers_c * 100.0, peers_i), _c("clicks") / _c("impressions") * 100.0
    return wanted.where((peers_n >= 3) & (peers_i >= 300)).where((peer_ctr > 0) & (ctr < peer_ctr * 0.5)).select(
        *rows.columns, ctr.alias("observed_ctr"), peer_ctr.alias("peer_ctr"), peers_n.alias("peer_count"), peers_i.alias("peer_impressions"),
        (_c("impressions") * (peer_ctr - ctr) / 100).alias("expected_click_gap"),
    )


def group_query_evidence(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Queries where several members of a group got impressions, per member; ``members(group, canonical, url)``."""
    key = members.select("group", "canonical", urls.url_key(_c("url"), "identity").alias("url_key")).distinct()
    facts = rows.where("impressions > 0").groupBy("query", urls.url_key(_c("page"), "identity").alias("url_key")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    joined = key.join(facts, "url_key")
    shared = joined.groupBy("group", "query").agg(F.count("*").alias("members")).where("members > 1")
    return joined.join(shared, ["group", "query"])


def group_click_leaders(evidence: DataFrame) -> DataFrame:
    """Member with most clicks over the shared queries; conflict where it is not the canonical."""
    sums = evidence.groupBy("group", "canonical", "url_key").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    best = sums.groupBy("group", "canonical").agg(F.min_by("url_key", F.struct((-_c("clicks")).alias("a"), (-_c("impressions")).alias("b"), "url_key")).alias("leader"))
    return best.withColumn("conflict", _c("leader") != urls.url_key(_c("canonical"), "identity"))


def dedupe_ranked(rows: DataFrame) -> DataFrame:
    """Best rank per address and result list, renumbered by (rank, url).

    Spellings of a list shrink to their best rank before they are keyed. The best rows are written once: numbering reads them
    twice, and a filter on a key that is still an expression would work it out again.
    """
    spelled = rows.groupBy("list", "url").agg(F.min("rank").alias("rank"))
    keyed = spelled.withColumn("url_key", urls.url_key(_c("url"), "snapshot"))
    best = cut_lineage(shapes.latest(keyed.select("list", "url_key", "rank", "url"), ["list", "url_key"], -_c("rank"), _c("url"))).where("url_key IS NOT NULL")
    return shapes.numbered(best, ["list"], F.floor(_c("rank") / 100), _c("rank"), _c("url_key"), name="position")


def daily_series(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Newest capture of each key and date."""
    return shapes.latest(captures, [*keys, "date"], _c("captured_at"), _c("snapshot_id"))


def missing_dates(series: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Dates of the range that a series lacks."""
    wanted = series.select(*keys).distinct().withColumn("date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return wanted.join(series.select(*keys, "date").distinct(), [*keys, "date"], "left_anti")


def surface_forms(forms: DataFrame) -> DataFrame:
    """Most frequent spelling per key, shorter then alphabetical on ties; ``(key, form)``."""
    counted = forms.groupBy("key", "form").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.min_by("form", F.struct((-_c("n")).alias("a"), F.length("form").alias("b"), "form")).alias("form"), F.sum("n").alias("uses"))


def import_queries(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per folded text and scope, the newest retrieval winning, with what became of it."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))).withColumn(
        "key", F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    )
    best = both.groupBy("key", "scope").agg(
        F.max_by(F.struct("text", "retrieved_at", "_new"), F.struct("retrieved_at", "_new", "text")).alias("b"), F.count_if(_c("_new") == 0).alias("old"), F.count_if(_c("_new") == 1).alias("new")
    )
    outcome = F.when(_c("new") == 0, "kept").when(_c("old") == 0, "added").when(_c("b._new") == 1, "updated").otherwise("duplicate")
    return best.select("key", "scope", "b.text", "b.retrieved_at", outcome.alias("outcome"), (_c("new") - F.when(_c("old") == 0, 1).otherwise(0)).alias("repeats"))


def property_match(pages: DataFrame, properties: DataFrame) -> DataFrame:
    """Property that covers each URL best: exact, longest path prefix, longest domain.

    Each URL lists its possible properties (path prefixes, host suffixes) and meets them by equality, so a URL is
    copied once per path step and host label, never per property.
    """
    def domain_candidates(u: urls.UrlParts) -> Column:
        labels = F.split(u.host, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("sc-domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))

    def path_candidates(u: urls.UrlParts) -> Column:
        segs = F.filter(F.split(u.path, "/"), lambda s: s != "")
        base = F.concat(u.scheme, F.lit("://"), F.regexp_replace(u.host, r"^www\.", ""), u.port_suffix)
        return F.transform(
            F.sequence(F.lit(0), F.size(segs)),
            lambda n: F.concat(base, F.lit("/"), F.array_join(F.transform(F.slice(segs, F.lit(1), n), lambda s: F.concat(s, F.lit("/"))), "")),
        )

    own = F.regexp_replace("property", r"^sc-domain:", "")
    is_domain = F.lower("property").startswith("sc-domain:")
    key = F.when(is_domain, F.concat(F.lit("sc-domain:"), F.regexp_replace(F.lower(own), r"\.$", ""))).otherwise(
        urls.with_parts(_c("property"), lambda u: F.concat(u.scheme, F.lit("://"), F.regexp_replace(u.host, r"^www\.", ""), u.port_suffix, F.regexp_replace(u.path, "/*$", "/")))
    )
    table = properties.select("property", key.alias("candidate"), is_domain.alias("is_domain"))
    every = urls.with_parts(_c("url"), lambda u: F.concat(domain_candidates(u), path_candidates(u)))
    full = urls.with_parts(_c("url"), lambda u: F.element_at(path_candidates(u), -1))
    rows = pages.withColumn("_full", full).withColumn("candidate", F.explode(every)).join(table, "candidate")
    prefix_length = F.length(F.regexp_replace("candidate", "^[a-z]+://[^/]+", ""))
    score = (
        F.when(_c("is_domain"), 500 + F.length(F.regexp_replace("candidate", "^sc-domain:", "")))
        .when(_c("candidate") == _c("_full"), 1000).otherwise(600 + prefix_length)
    )
    best = rows.groupBy("url").agg(F.max(F.struct(score.alias("score"), "property")).alias("b"))
    return best.select("url", "b.property", _c("b.score").cast("long").alias("score"))


def interventions_asof(interventions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each change with the last snapshot ending before it and the first starting on or after it, and why not comparable.

    ``interventions(id, site, date)``, ``snapshots(snapshot_id, site, start_date, end_date, captured_at, clicks, impressions)``.
    """
    day = lambda c: F.unix_date(_c(c))
    body = F.struct(F.unix_millis("captured_at").alias("captured"), "snapshot_id", "start_date", "end_date", "clicks", "impressions")
    rows = shapes.asof(interventions, snapshots, ["site"], day("date"), day("end_date"), body, 31, True, "before")
    rows = shapes.asof(rows, snapshots, ["site"], -day("date"), -day("start_date"), body, 31, False, "after")
    days = lambda p: F.datediff(_c(f"{p}.end_date"), _c(f"{p}.start_date")) + 1
    shorter = F.least(days("before"), days("after"))
    reason = (
        F.when(_c("before").isNull(), "no-baseline").when(_c("after").isNull(), "no-follow-up")
        .when((days("before") <= 0) | (days("after") <= 0), "period-length-mismatch")
        .when(F.abs(days("before") - days("after")) / shorter > 0.1, "period-length-mismatch").when(_c("before.clicks") < 30, "low-volume")
    )
    return rows.select(
        "id", "site", "date", _c("before.snapshot_id").alias("before_id"), _c("after.snapshot_id").alias("after_id"), reason.alias("reason"),
        F.try_divide(_c("after.clicks") - _c("before.clicks"), _c("before.clicks")).alias("clicks_change"),
    )


def rest_of_site(site: DataFrame, page: DataFrame, keys: list[str]) -> DataFrame:
    """Site totals without one page; null where they would be negative."""
    rows = site.select(*keys, *[_c(n).alias(f"s_{n}") for n in ("clicks", "impressions", "position")]).join(
        page.select(*keys, *[_c(n).alias(f"p_{n}") for n in ("clicks", "impressions", "position")]), keys
    )
    c, i = _c("s_clicks") - _c("p_clicks"), _c("s_impressions") - _c("p_impressions")
    ok = (c >= 0) & (i >= 0)
    pos = F.try_divide(_c("s_position") * _c("s_impressions") - _c("p_position") * _c("p_impressions"), i)
    return rows.select(*keys, F.when(ok, c).alias("clicks"), F.when(ok, i).alias("impressions"), F.when(ok & (i > 0), pos).alias("position"))
