"""Stored crawl runs: pages kept as JSON with typed columns, replaced run by run, and their flat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.sources import tables

#: Columns of the page table: name and type; the name is also the field of the JSON payload.
PAGE_FIELDS = (
    ("url", "string"), ("final_url", "string"), ("http_status", "int"), ("response_time_ms", "bigint"), ("depth", "int"), ("request_error_kind", "string"),
    ("content_type", "string"), ("title", "string"), ("title_length", "int"), ("meta_description", "string"), ("meta_description_length", "int"),
    ("canonical", "string"), ("canonical_relation", "string"), ("meta_robots", "string"), ("x_robots_tag", "string"), ("indexability_status", "string"),
    ("word_count", "bigint"), ("content_hash", "string"), ("content_simhash", "string"), ("content_date", "date"), ("h1_count", "int"), ("document_language", "string"),
    ("internal_link_count", "int"), ("external_link_count", "int"), ("body_truncated", "boolean"), ("schema_types", "array<string>"),
    ("discovery_sources", "array<struct<kind:string,source_url:string,anchor_text:string>>"),
    ("redirect_chain", "array<struct<http_status:int,from_url:string,to_url:string,response_time_ms:bigint>>"),
    ("hreflangs", "array<struct<language:string,target_url:string,target_http_status:int,target_checked_in_run:boolean,reciprocal_in_run:boolean,target_canonical_alignment:string>>"),
    ("links", "array<struct<target_url:string,anchor_text:string,rel:string,is_internal:boolean,zone:string>>"),
    ("images", "array<struct<src:string,alt:string,width:int,height:int>>"),
    ("issues", "array<struct<severity:string,category:string,code:string,message:string,recommendation:string>>"),
)


def pages_from_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of rows ``(site_id, run_id, payload)``, one JSON object a page.

    Each typed column is read by its path; a value of another type is null. ``payload`` stays as a variant, so fields without a
    column are kept. Rows that aren't a JSON object with a url, or name no site and run, are rejects.
    """
    v = rows.withColumn("_v", F.try_parse_json("payload"))
    ok = F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT") & F.try_variant_get("_v", "$.url", "string").isNotNull() & F.col("site_id").isNotNull() & F.col("run_id").isNotNull()
    marked = v.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    typed = [F.try_variant_get("_v", f"$.{name}", kind).alias(name) for name, kind in PAGE_FIELDS]
    return marked.where("_ok").select("site_id", "run_id", *typed, F.col("_v").alias("payload")), marked.where("NOT _ok").drop("_v", "_ok")


def save_run(pages: DataFrame, path: str) -> None:
    """Store the pages of runs; a run that is stored already is replaced whole, others stay."""
    tables.replace_run(pages, path, ("site_id", "run_id"))


def replace_history(spark: SparkSession, pages: DataFrame, path: str, site: str) -> None:
    """Store the runs of one site in place of all its earlier ones; runs that are not among the new pages are emptied."""
    old = load_pages(spark, path, pages).where(F.col("site_id") == site).select("run_id").distinct()
    keep = [r.run_id for r in pages.where(F.col("site_id") == site).select("run_id").distinct().collect()]
    for run in [r.run_id for r in old.collect() if r.run_id not in keep]:
        _drop(spark, f"{path}/site_id={site}/run_id={run}")
    save_run(pages.where(F.col("site_id") == site), path)


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def load_pages(spark: SparkSession, path: str, like: DataFrame, site: str | None = None, run: str | None = None) -> DataFrame:
    """The stored pages, of one site and run if named: only their partitions are read."""
    rows = spark.read.schema(like.schema).parquet(path)
    if site is not None:
        rows = rows.where(F.col("site_id") == site)
    return rows if run is None else rows.where(F.col("run_id") == run)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _joined(items: str, shown) -> Column:
    """Elements of an array written one after another; nothing for none."""
    return F.coalesce(F.array_join(F.transform(items, shown), " | "), F.lit(""))


def _yes(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c, "yes").otherwise("no")


def pages_export(pages: DataFrame) -> DataFrame:
    """One flat text row for each stored page; nested facts are written as ``a | b``, unknown ones are empty, formulas are disarmed."""
    def hreflang(x: Column) -> Column:
        status = F.when(~F.coalesce(x["target_checked_in_run"], F.lit(False)), "not checked").otherwise(F.coalesce(F.nullif(x["target_http_status"], F.lit(0)).cast("string"), F.lit("no response")))
        back = F.when(x["reciprocal_in_run"].isNull(), "reciprocity unverified").when(x["reciprocal_in_run"], "reciprocal").otherwise("not reciprocal")
        return F.concat(_text(x["language"]), F.lit(": "), _text(x["target_url"]), F.lit(" ("), status, F.lit("; "), back, F.lit("; "), F.coalesce(x["target_canonical_alignment"], F.lit("canonical unverified")), F.lit(")"))

    def hop(x: Column) -> Column:
        took = F.coalesce(F.concat(x["response_time_ms"].cast("string"), F.lit(" ms")), F.lit("timing unavailable"))
        return F.concat(_text(x["http_status"]), F.lit(": "), _text(x["from_url"]), F.lit(" -> "), _text(x["to_url"]), F.lit(" ("), took, F.lit(")"))

    found = lambda x: F.array_join(F.filter(F.array(x["kind"], x["source_url"], x["anchor_text"]), lambda y: F.coalesce(y, F.lit("")) != ""), ": ")
    plain = [n for n, kind in PAGE_FIELDS if not kind.startswith("array") and n not in ("body_truncated",)]
    flat = pages.select(
        "site_id", "run_id", *[_text(F.col(n)).alias(n) for n in plain], _yes(F.col("body_truncated")).alias("body_truncated"),
        _joined("schema_types", lambda x: x).alias("schema_types"), _joined("discovery_sources", found).alias("discovery_sources"),
        _joined("redirect_chain", hop).alias("redirect_chain"), _joined("hreflangs", hreflang).alias("hreflangs"),
        F.coalesce(F.size("images"), F.lit(0)).cast("string").alias("images"), F.coalesce(F.size("issues"), F.lit(0)).cast("string").alias("issues_count"),
        _joined("issues", lambda x: F.concat(_text(x["severity"]), F.lit(": "), _text(x["message"]))).alias("issues"),
    )
    return tables.spreadsheet_safe(flat)


#: Rows at the head of a single-page export: label and column.
AUDIT_FIELDS = (
    ("URL", "final_url"), ("HTTP status", "http_status"), ("Response time (ms)", "response_time_ms"), ("Title", "title"), ("Description", "meta_description"),
    ("Canonical", "canonical"), ("H1", "h1_count"), ("Images", "images"), ("Links", "links"),
)


def audit_export(pages: DataFrame) -> DataFrame:
    """(site_id, run_id, url, nr, a, b, c, d, e): the export of each page by itself, its facts, an empty row, then a row for each issue."""
    cell = lambda name: F.coalesce(F.size(name), F.lit(0)).cast("string") if dict(PAGE_FIELDS)[name].startswith("array") else _text(F.col(name))
    row = lambda *c: F.struct(*[x.alias(n) for n, x in zip("abcde", [*c, *[F.lit("")] * (5 - len(c))])])
    head = F.array(row(F.lit("Field"), F.lit("Value")), *[row(F.lit(label), cell(name)) for label, name in AUDIT_FIELDS], row(F.lit("")), row(*map(F.lit, ("Type", "Severity", "Category", "Message", "Recommendation"))))
    issues = F.transform(F.coalesce("issues", F.array().cast(dict(PAGE_FIELDS)["issues"])), lambda x: row(F.lit("Issue"), *[_text(x[k]) for k in ("severity", "category", "message", "recommendation")]))
    rows = pages.select("site_id", "run_id", "url", F.posexplode(F.concat(head, issues)).alias("nr", "r")).select("site_id", "run_id", "url", "nr", "r.*")
    return tables.spreadsheet_safe(rows)


def nested_rows(pages: DataFrame, column: str) -> DataFrame:
    """One safe row for each link or image of each page, pages without any left out."""
    rows = pages.select("site_id", "run_id", "url", F.posexplode(column).alias("nr", "e")).select("site_id", "run_id", "url", "nr", "e.*")
    return tables.spreadsheet_safe(rows)


def gap_export(gaps: DataFrame, competitors: list[str]) -> DataFrame:
    """Backlink gaps ``(target, referring_domain, competitor_backlinks, max_competitor_spam_score)`` with two columns for each competitor."""
    of = F.map_from_entries(F.transform("competitor_backlinks", lambda x: F.struct(x["domain"], x)))
    cells = [x for d in competitors for x in (_text(of[d]["backlinks"]).alias(f"{d} backlinks"), _text(of[d]["rank"]).alias(f"{d} rank"))]
    return tables.spreadsheet_safe(gaps.select("target", "referring_domain", *cells, _text(F.col("max_competitor_spam_score")).alias("spam_score")))
