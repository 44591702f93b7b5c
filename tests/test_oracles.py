"""A cross-section of the registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "url_comparison_keys", "alt_text_checks", "page_links", "main_content_text", "index_states", "robots_decisions", "directory_rollup", "parsed_log_lines", "first_seen_urls",
    "custom_search_results", "crawl_page_rows", "sitemap_addresses", "late_log_merge", "new_address_sights", "passage_windows", "query_cannibalization", "ctr_outliers", "interventions_asof", "exact_duplicate_documents", "vector_neighbours", "hub_areas", "crawl_diff", "holm_adjusted_tests", "url_protection",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    state, rows, *_, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert state == "ok", note
    assert rows > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["lang", "left", "right", "distance"]


def test_queries_are_listed_before_a_session():
    """The driver reads the registry before it starts Spark."""
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 250, len(e.oracle_sql()) > 250)"], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert said.stdout.split() == ["True", "True"], said.stderr[-500:]
