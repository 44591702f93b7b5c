"""Imports, sinks and stream logic over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.plans.inputs import cte, LINKS_SQL, page_links
from pagewright.plans.registry import Tables, query
from pagewright.sources import tables as src
from pagewright.streaming import ingest


@query("ranked_import_rows", "A8", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_size > 2 AND p_partkey % 5 <> 1")
def _(t: Tables):
    k = F.col("p_partkey")
    rows = t.part.select(k, F.when(k % 3 != 0, "kw").otherwise(" ").alias("keyword"), (F.col("p_size") - 2).alias("rank"), F.when(k % 5 == 1, "not a url").otherwise("https://a.example/").alias("url"))
    return src.ranked_results(rows)[0].select("p_partkey")


@query("imported_url_list", "A10", "SELECT CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE 'https://u.example/' || (s_suppkey % 40) END AS url, count(*)::BIGINT AS rows FROM supplier GROUP BY 1")
def _(t: Tables):
    k = F.col("s_suppkey")
    return src.url_list(t.supplier.select(F.when(k % 7 == 3, "mailto:x").otherwise(F.concat(F.lit(" HTTPS://U.example/"), k % 40, F.when(k % 2 == 0, "/").otherwise(""))).alias("u")), "u")


@query("caption_cues", "A15", "SELECT conv_id AS file, turn::INTEGER AS pos, (turn * 2000)::BIGINT AS start_ms, (turn * 2000 + 1500)::BIGINT AS end_ms, 'cue ' || turn AS text FROM conversations")
def _(t: Tables):
    c = t.conversations
    part = lambda ms, size, most: (F.floor(ms / size) % most).cast("int")
    sec = lambda ms: F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("int"), part(ms, 60_000, 60), part(ms, 1000, 60), (ms % 1000).cast("int"))
    cue = F.concat(sec(F.col("turn") * 2000), F.lit(" --> "), sec(F.col("turn") * 2000 + 1500), F.lit("\ncue "), F.col("turn"))
    files = c.groupBy(F.col("conv_id").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("text"))
    return src.captions(files)


@query("unseen_log_files", "A2", "SELECT min(doc_id)::VARCHAR AS path FROM documents GROUP BY sha256(text) HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def _(t: Tables):
    # Paths are padded so that the smallest text is the smallest number.
    files = t.documents.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").alias("content"))
    manifest = t.documents.where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return src.unseen_files(files, manifest).select(F.col("path").cast("long").cast("string").alias("path"))


@query("spreadsheet_safe_cells", "A19", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '''=' WHEN doc_id % 4 = 1 THEN '''-' WHEN doc_id % 4 = 2 THEN 'a=' ELSE '''@' END || source AS cell FROM documents")
def _(t: Tables):
    d = F.col("doc_id")
    mark = F.when(d % 4 == 0, "=").when(d % 4 == 1, "-").when(d % 4 == 2, "a=").otherwise("@")
    return src.spreadsheet_safe(t.documents.select("doc_id", F.concat(mark, "source").alias("cell")))


@query("run_listing", "A17", "SELECT o_custkey % 30 AS site_id, o_orderstatus AS run_id, count(*)::BIGINT AS pages FROM orders GROUP BY 1, 2")
def _(t: Tables):
    return src.list_runs(t.orders.select((F.col("o_custkey") % 30).alias("site_id"), F.col("o_orderstatus").alias("run_id"), F.col("o_orderdate").alias("completed_at"))).drop("completed_at")


@query("record_upsert", "A18", "SELECT o_custkey AS key, max(o_orderkey) AS version FROM orders GROUP BY 1")
def _(t: Tables):
    row = lambda df: df.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"))
    return src.upsert(row(t.orders), row(t.orders.where("o_orderstatus = 'F'")), ["key"], "version")


@query("erased_subjects", "A23", "SELECT o_custkey AS subject_id, count(*)::BIGINT AS erased FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def _(t: Tables):
    return src.erase_subject(t.orders.select(F.col("o_custkey").alias("subject_id"), "o_orderkey"), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("subject_id")))[1]


@query("nested_link_export", "A21", cte(l=LINKS_SQL) + "SELECT page_id, source AS url, target, anchor FROM l")
def _(t: Tables):
    per = page_links(t).groupBy("page_id", F.col("source").alias("url")).agg(F.collect_list(F.struct("target", "anchor")).alias("links"))
    return src.nested_export(per, "links")


@query("run_event_replay", "I5", """
WITH e AS (SELECT user_id AS run, event_id AS seq, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) AND user_id % 5 <> 0 THEN 'started' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'failed' ELSE 'page' END AS kind, value > 5 AS valid FROM events)
SELECT run, CASE WHEN arg_min(kind, seq) <> 'started' THEN 'malformed' WHEN count(*) FILTER (WHERE kind = 'failed') > 0 THEN 'failed' ELSE 'running' END AS state, count(*) FILTER (WHERE kind = 'page' AND valid)::BIGINT AS pages, count(*) FILTER (WHERE kind = 'page' AND NOT valid)::BIGINT AS invalid FROM e GROUP BY 1""")
def _(t: Tables):
    first = t.events.groupBy("user_id").agg(F.min("event_id").alias("first"))
    kind = F.when((F.col("event_id") == F.col("first")) & (F.col("user_id") % 5 != 0), "started").when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "failed").otherwise("page")
    ev = t.events.join(first, "user_id").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"), (F.col("value") > 5).alias("valid"))
    return ingest.replay_runs(ev).select("run", "state", "pages", "invalid")
