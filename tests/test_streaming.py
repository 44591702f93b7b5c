"""A file stream run to its end equals the batch result, and a second call adds nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagewright.plans.inputs import log_lines
from pagewright.plans.registry import Tables
from pagewright.sources import logs
from pagewright.streaming import ingest


def test_daily_counts_equal_batch(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    log_lines(Tables(spark, "/root/testdata/sf0.001")).repartition(3).write.text(src)
    stream = lambda: logs.parse_lines(ingest.log_stream(spark, src)).where("family IS NOT NULL").select("at", "path", "family", "status")
    ingest.run_available(stream(), out, ckpt)
    ingest.run_available(stream(), out, ckpt)
    want = logs.parse_lines(spark.read.text(src)).where("family IS NOT NULL").count()
    assert spark.read.schema("at timestamp, path string, family string, status int").parquet(out).count() == want > 0
    assert ingest.daily_bot_counts(ingest.log_stream(spark, src)).isStreaming


def test_first_seen_equals_the_batch(spark, tmp_path):
    schema = "project string, url string, at timestamp"
    rows = [("p", f"/{i % 7}", f"2024-01-0{1 + i % 5} 10:00:00") for i in range(40)]
    frame = spark.createDataFrame(rows, "project string, url string, at string").selectExpr("project", "url", "CAST(at AS timestamp) AS at")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    registry = spark.createDataFrame([("p", "/3"), ("q", "/1")], "project string, url string")
    stream = ingest.first_seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), registry)
    ingest.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted({r[1] for r in rows} - {"/3"})


def seen_rows():
    """Sights of three projects over ten days; p starts on the first day, q on the third, r is unknown."""
    out = []
    for i in range(120):
        day, project = i // 12, "pqr"[i % 3]
        out.append((project, f"/{(i * 7) % 23}", datetime(2024, 1, 1 + day, 8 + i % 12)))
    return out


PROJECTS = [("p", datetime(2024, 1, 1, 23)), ("q", datetime(2024, 1, 3, 23)), ("q", datetime(2024, 1, 5)), ("s", datetime(2024, 1, 1)), (None, datetime(2024, 1, 1))]
SIGHTS = "project string, url string, at timestamp"


def test_first_seen_state_equals_the_table_over_restarts(spark, tmp_path):
    from pagewright.streaming import first_seen

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    projects = spark.createDataFrame(PROJECTS, "project string, started timestamp")
    rows = seen_rows() + [("p", None, datetime(2024, 1, 2)), ("p", "/x", None)]
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for part in (rows[:40], rows[40:90], rows[90:]):  # the query stops after each part and starts again
        spark.createDataFrame(part, SIGHTS).coalesce(1).write.mode("append").parquet(src)
        stream = first_seen.first_seen_stream(spark.readStream.schema(SIGHTS).parquet(src), projects)
        ingest.run_available(stream, out, state)
    got = sorted(map(tuple, spark.read.schema(first_seen.OUT).parquet(out).collect()), key=repr)
    want = sorted(map(tuple, first_seen.first_seen_table(spark.createDataFrame(rows, SIGHTS), projects).collect()), key=repr)
    assert got == want and {r[0] for r in got} == {"p", "q"}
    # brute force
    starts, first = {"p": PROJECTS[0][1], "q": PROJECTS[1][1]}, {}
    for project, url, at in seen_rows():
        first[project, url] = min(at, first.get((project, url), at))
    for project, url, at, first_at, is_new in got:
        start = first[project, url]
        assert first_at == (None if start <= starts[project] else start)
        assert is_new == (start > starts[project] and at - start <= timedelta(hours=24))
    assert any(r[4] for r in got) and any(r[3] and not r[4] for r in got)
    kept = {(r.project, r.url): (r.baseline, r.first_at) for r in first_seen.stored_state(spark, state).collect()}
    assert kept == {k: (v <= starts[k[0]], v) for k, v in first.items() if k[0] in starts}


def test_first_seen_state_drops_after_its_lifetime(spark, tmp_path):
    from pagewright.streaming import first_seen

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    projects = spark.createDataFrame([("p", datetime(2024, 1, 1))], "project string, started timestamp")
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for day, urls in ((2, "ab"), (5, "b"), (9, "c"), (12, "ab")):
        spark.createDataFrame([("p", f"/{u}", datetime(2024, 1, day)) for u in urls], SIGHTS).coalesce(1).write.mode("append").parquet(src)
        stream = first_seen.first_seen_stream(spark.readStream.schema(SIGHTS).parquet(src), projects, lifetime=timedelta(days=5), late="1 hour")
        ingest.run_available(stream, out, state)
    rows = [(r.url, r["at"].day, r.first_at.day, r.is_new) for r in spark.read.schema(first_seen.OUT).parquet(out).orderBy("at", "url").collect()]
    # a is forgotten seven days after its only sight, b was seen in between and its state dropped on the tenth
    assert rows == [("/a", 2, 2, True), ("/b", 2, 2, True), ("/b", 5, 2, False), ("/c", 9, 9, True), ("/a", 12, 12, True), ("/b", 12, 2, False)]


AGENTS = ("Mozilla/5.0 (compatible; Googlebot/2.1)", "GPTBot/1.2", "Mozilla/5.0 (X11; Linux)")


def log_text(rng, day, n):
    stamp = lambda: f"{day:02d}/Jan/2024:{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d} +0000"
    return [f'66.249.{rng.randrange(80)}.1 - - [{stamp()}] "GET /p{rng.randrange(4)}?x=1 HTTP/1.1" {rng.choice([200, 301, 404, 503, 101])} {rng.choice(["12", "-"])} "-" "{rng.choice(AGENTS)}" 0.5' for _ in range(n)]


def test_landing_counts_each_file_and_late_line_once(spark, tmp_path):
    import gzip
    import random

    from pagewright.operators import logs as ops
    from pagewright.streaming import landing

    rng = random.Random(3)
    src, table, state = tmp_path / "in", f"{tmp_path}/table", f"{tmp_path}/state"
    src.mkdir()
    first, second = log_text(rng, 3, 40) + ["torn line"], log_text(rng, 5, 30) + log_text(rng, 3, 10)
    late = log_text(rng, 2, 15) + log_text(rng, 3, 15)
    (src / "a.log").write_text("\n".join(first) + "\n")
    with gzip.open(src / "a-rotated.log.gz", "wt") as f:  # lands together with its plain copy
        f.write("\n".join(first) + "\n")
    bounds = logs.cidr_bounds(spark.createDataFrame([("googlebot", "66.249.0.0/18")], "family string, cidr string"))
    run = lambda: landing.run_landing(landing.numbered_lines(spark, str(src)), table, state, bounds=bounds)
    run()
    (src / "b.log").write_text("\n".join(second) + "\n")
    run()
    with gzip.open(src / "b.log.1.gz", "wt") as f:  # lands a run after its plain copy
        f.write("\n".join(second) + "\n")
    (src / "c.log").write_text("\n".join(late) + "\n")
    run()
    run()  # nothing new

    whole = logs.parse_lines(spark.createDataFrame([(x,) for x in first + second + late], "value string"))
    hits = ops.with_verdict(whole.where("at IS NOT NULL"), ops.verify_by_range(whole, bounds)).where("family IS NOT NULL AND status BETWEEN 200 AND 599").withColumn("day", F.to_date("at"))
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(landing.day_counts(spark, table)) == rows(landing.partial_counts(hits))
    totals = landing.import_state(spark, table).first()
    assert (totals.lines, totals.malformed, totals.other) == (len(first + second + late), 1, len(first + second + late) - 1 - hits.count())
    assert [d.day for d in totals.days] == [2, 3, 5] and totals.first_at.day == 2 and totals.last_at.day == 5
    assert sorted(r.file.rsplit("/", 1)[1] for r in landing.stored(spark, f"{table}/files", landing.FILES).collect()) == ["a-rotated.log.gz", "b.log", "c.log"]

    # a batch that runs again replaces its own rows
    again = spark.createDataFrame([(x, "file:/c.log") for x in late], "value string, file string")
    landing.land_batch(again, 2, table, bounds=bounds)
    assert rows(landing.day_counts(spark, table)) == rows(landing.partial_counts(hits))

    # gaps of a day by the times of visits, late ones among them
    gaps = {(r.path, r.family, r.verdict): (r.hits, r.gap_sum_ms, r.max_gap_ms) for r in landing.compact_days(spark, table, "2024-01-03", "2024-01-03").collect()}
    want = {}
    for r in hits.where("day = DATE '2024-01-03'").orderBy("at").collect():
        want.setdefault((r.path, r.family, r.verdict), []).append(r["at"].timestamp() * 1000)
    assert gaps == {k: (len(v), int(v[-1] - v[0]), int(max(b - a for a, b in zip(v, v[1:]))) if len(v) > 1 else None) for k, v in want.items()}
    assert rows(spark.read.parquet(f"{table}/compact").where("day <> DATE '2024-01-03'")) == []


def test_stored_counts_add_up(spark):
    from pagewright.streaming import landing

    visits = logs.parse_lines(log_lines(Tables(spark, "/root/testdata/sf0.001"))).where("family IS NOT NULL").selectExpr("to_date(at) AS day", "*", "'claimed' AS verdict")
    parts = [landing.partial_counts(visits.where(f"crc32(value) % 3 = {k}")) for k in range(3)]
    merged = landing.merged_counts(parts[0].union(parts[1]).union(parts[2]))
    rows = lambda df: sorted(str(r) for r in df.withColumn("latency_sum_ms", F.round("latency_sum_ms", 3)).collect())
    assert rows(merged) == rows(landing.partial_counts(visits))
