"""Queries that cover all rows of their tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.runtime import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_hydrate_all(spark):
    pages = table(spark, SF, "pages").select(F.col("id").alias("page_id")).distinct()
    want = sum(table(spark, SF, t).select("id", "page_id").distinct().join(pages, "page_id").count() for t in ("page_blocks", "page_documents"))
    assert entry.queries()["search_hydrate"](spark, SF).count() == want


def test_crawl_stats(spark):
    rows = entry.queries()["crawl_stats"](spark, SF)
    assert rows.agg(F.sum(sum(F.col(c) for c in ("queued", "rendering", "parsed", "batched", "failed")))).first()[0] == table(spark, SF, "events").count()


def test_feedback_valid(spark):
    own = table(spark, SF, "events").filter("event_id % 7 < 5").groupBy("event_type").agg(F.avg(1 + F.col("event_id") % 7)).collect()
    assert {(r["event_type"], r["rating"]) for r in entry.queries()["feedback_summary"](spark, SF).collect()} == {tuple(r) for r in own}


def test_page_waves(spark):
    rows = {r["url"]: r["depth"] for r in entry.queries()["frontier_page_waves"](spark, SF).collect()}
    own = {r["url"] for r in table(spark, SF, "pages").select("url").distinct().collect()}
    linked = {r["href"] for r in table(spark, SF, "page_links").select("href").distinct().collect()}
    assert rows and all(u in own if d == 0 else u in linked for u, d in rows.items()) and max(rows.values()) >= 1
