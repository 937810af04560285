"""Task events, upserts, stored indexes, page structures and session rules on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions import text as T
from millrace.operators import frontier as K
from millrace.operators import ingest as I
from millrace.operators import retrieval as R
from millrace.sources import dom
from millrace.streaming import crawl


def test_text_validity(spark):
    raw = spark.createDataFrame([(1, bytearray("a�b".encode())), (2, bytearray(b"a\xffb\xef\xbf\xbd")), (3, None)], "i int, b binary")
    rows = raw.orderBy("i").select(T.valid_text(F.col("b").cast("string")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["a�b", "ab�", None]
    assert len(T.RU_STOP) == len(set(T.RU_STOP)) == 240


def test_upserts(spark):
    stored = spark.createDataFrame([("1", "u", "t1", "en"), ("2", "v", "t2", None)], "id string, url string, title string, language string")
    new = spark.createDataFrame([("2", None, "de"), ("3", "t3", None)], "id string, title string, language string")
    got = {r["id"]: tuple(r)[1:] for r in I.update_fields(stored, new, "id", ["title", "language"]).collect()}
    assert got == {"1": ("u", "t1", "en"), "2": ("v", None, "de"), "3": (None, "t3", None)}
    sources = spark.createDataFrame([("1", "https://a.example/", True)], "id string, source_url string, enabled boolean")
    come = spark.createDataFrame([(None, "https://a.example/", False), (None, "//B.example/X?q", True), ("9", "x.example", None), ("1", "http://C.example", None)], sources.schema)
    got = sorted((str(r["id"]), str(r["source_url"]), r["action"]) for r in I.upsert_sources(sources, come, ["enabled"]).collect())
    assert got == [("1", "http://c.example", "update"), ("1", "https://a.example/", "update"), ("9", "None", "unknown"), ("None", "https://b.example/x", "insert")]
    bad = spark.createDataFrame([("1", "nowhere"), ("2", "//Y.example/a"), ("3", None)], "id string, url string")
    assert [tuple(r) for r in I.drop_bad_urls(bad, "url").collect()] == [("2", "https://y.example/a")]


def test_task_events(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", "PAGE_BATCH", 1, at(1)), ("a", "PAGE_BATCH", 2, at(2)), ("a", "TASK_COMPLETED", None, at(3)), ("a", "TASK_FAILED", None, at(4)),
            ("b", "PAGE_BATCH", 1, at(1)), ("c", "PAGE_BATCH", 1, at(1)), ("c", "TASK_FAILED", None, at(1)), ("d", None, None, at(1))]
    events = spark.createDataFrame(rows, "task_id string, type string, seq int, ts timestamp")
    states = {r["task_id"]: (r["status"], r["finished_at"]) for r in I.task_states(events).collect()}
    assert states == {"a": ("COMPLETED", at(3)), "b": ("RUNNING", None), "c": ("FAILED", at(1)), "d": ("RUNNING", None)}
    tasks = spark.createDataFrame([("a", "RUNNING"), ("b", "COMPLETED"), ("a", "RUNNING")], "task_id string, status string")
    assert [r["leads_to"] for r in I.dispatch_events(events, tasks).orderBy("ts").collect()] == ["RUNNING", "RUNNING", "COMPLETED", "FAILED"]
    order = {r["task"]: r["in_order"] for r in crawl.event_order(events.filter("type is not null").withColumnRenamed("task_id", "task")).collect()}
    assert order == {"a": False, "b": False, "c": True}
    assert crawl.event_order(events.withColumnRenamed("task_id", "task").limit(0)).count() == 0


def test_event_modes(spark):
    rows = [("t", i, datetime(2024, 1, 1, 0, i // 30, i % 30)) for i in range(45)]
    pages = spark.createDataFrame(rows, "task string, id long, ts timestamp")
    told = sorted((r["type"], r["seq"], r["pages"]) for r in crawl.crawl_events(pages).collect() if r["type"] == "PAGE_BATCH")
    assert [s for _, s, _ in told] == list(range(1, len(told) + 1)) and sum(n for *_, n in told) == 45
    assert [tuple(r) for r in crawl.crawl_events(pages, batched=False).collect()] == [("t", "TASK_COMPLETED", None, 45)]
    out, rest = crawl.drain_parsed(spark.createDataFrame([("t", u, "parsed") for u in "abc"] + [("t", "d", None)], "task string, url string, status string"), 2)
    assert {r["url"] for r in out.collect()} == {"a", "b"} and {r["url"] for r in rest.collect()} == {"c", "d"}


def test_limits(spark):
    rows = [("t", f"u{i}", i % 3, "pdf" if i == 4 else None, i) for i in range(6)]
    got = K.within_limits(spark.createDataFrame(rows, "task string, url string, depth int, hint string, place int"), 2, 1)
    assert {r["url"] for r in got.collect()} == {"u0", "u1", "u4"}
    stats = K.crawl_stats(spark.createDataFrame([("a", "batched"), ("a", "queued"), ("b", "failed"), ("c", "batched")], "task string, s string"), "task", "s", 1)
    assert {r["task"]: (r["state"], r["reason"]) for r in stats.collect()} == {"a": ("COMPLETED", "MAX_PAGES_REACHED"), "b": ("FAILED", "INTERNAL_ERROR"), "c": ("COMPLETED", "MAX_PAGES_REACHED")}
    urls = spark.createDataFrame([("/a/x",), ("/b/x",), ("/a/y",)], "url string")
    assert [r["url"] for r in urls.filter(K.wanted(F.col("url"), ("^/a/",), ("y$",))).collect()] == ["/a/x"]
    edges = spark.createDataFrame([("/p0", f"/p{i}", "x y", True) for i in range(1, 9)] + [("/p1", "/q", "x y", True)], "source_url string, href string, anchor_text string, internal boolean")
    start = spark.createDataFrame([("/p0", 0)], "url string, depth int")
    assert K.crawl_waves(start, edges, 5).count() == 10 and K.crawl_waves(start, edges, 5, 4).count() == 4
    assert {r["url"] for r in K.crawl_waves(start, edges, 5, include=("p[01]",)).collect()} == {"/p0", "/p1"}


def test_stored_index(spark, tmp_path):
    texts = spark.createDataFrame([(f"block:{i}", t) for i, t in enumerate(["red fox", "red red dog", "", None, "a blue fox"])], "key string, text string")
    R.write_text_index(texts, str(tmp_path / "index"))
    index = R.open_text_index(spark, str(tmp_path / "index"))
    one = [(r["key"], r["score"]) for r in R.search_text(index, "Red fox, red!").orderBy("rank").collect()]
    asked = spark.createDataFrame([(0, "Red fox, red!")], "query_id long, text string")
    assert one == [(r["key"], r["score"]) for r in R.bm25(asked, texts).orderBy("rank").collect()] and len(one) == 3
    assert R.search_text(index, " ?").count() == 0


def test_full_context(spark):
    hit = "query_id long, key string, kind string, id string, page_id string, url string, title string, text string, score_final double"
    hits = [(1, "block:b2", "block", "b2", "p", "u", "T", "two", 0.9), (1, "block:b1", "block", "b1", "p", "u", "T", "one", 0.8), (1, "document:d", "document", "d", "p", "f", None, "x", 0.7), (1, "block:z", "block", "z", "q", "w", "Z", "z", None)]
    blocks = spark.createDataFrame([("b1", "p", 0, "one"), ("b2", "p", 1, "two"), ("b2", "p", 1, "two"), ("b3", "p", 2, None)], "id string, page_id string, ord int, text string")
    files = spark.createDataFrame([("d", "f", "About", "whole file"), ("e", "u", "Of the page", None)], "id string, url string, description string, extracted_text string")
    got = [tuple(r) for r in R.full_context(spark.createDataFrame(hits, hit), blocks, files).orderBy("num").collect()]
    assert got == [(1, 1, "block:b2", "u", "[1] u\ntitle: T\ndescription: Of the page\ncontent: one\ntwo\n"), (1, 2, "document:d", "f", "[2] f\ntitle: \ndescription: About\ncontent: whole file")]


def test_page_parts():
    page = dom.parse_page("https://x.example/", '<head><meta http-equiv="last-modified" content="2024-02-30T00:00:00Z"></head><p>x')
    assert page["last_modified"] is None and page["page_type"] == "unknown"
    assert dom.parse_page("", '<meta property="article:modified_time" content="2024-02-03T04:05:06.7+03:00">')["last_modified"] == "2024-02-03T04:05:06.7+03:00"
    root = dom.parse_html("<body><div>loose</div><article><p>in</p></article><main><ul><li>item</ul></main></body>")
    assert dom.content_root(root).tag == "main"
    assert [(b["tag"], b["text"]) for b in dom.segment_plain(root)] == [("p", "in"), ("li", "item"), ("div", "loose")]


def test_session_rules(spark, monkeypatch):
    small = spark.createDataFrame([("x" * 1000, [1, 2])], "a string, b array<int>")
    assert 1000 < runtime.measured_bytes(small) < 2000

    kept = runtime.materialize(small)
    assert kept.count() == 1 and kept._millrace_path in kept.inputFiles()[0]
    runtime.release(kept)
    runtime.release(small)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.schema(small.schema).parquet(kept._millrace_path).count()

    class Elsewhere:
        sparkContext = type("C", (), {"master": "spark://x:7077", "getConf": lambda self: type("D", (), {"get": lambda self, k, d: d})()})()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Elsewhere())


def test_queue_with_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"task": "t", "n": 1}\nnot json\n{"task": "u", "n": "x"}\n\n{"task": null}\n')
    stream = crawl.queue_source(spark, str(tmp_path / "in"), "task string, n int")
    crawl.sink(stream, str(tmp_path / "out"), str(tmp_path / "check"), "ok").awaitTermination(60)
    good = spark.read.parquet(str(tmp_path / "out" / "good"))
    assert sorted((r["message"]["task"], r["message"]["n"]) for r in good.filter("message.task is not null").collect()) == [("t", 1)]
    bad = {r["value"] for r in spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()}
    assert {"not json", '{"task": "u", "n": "x"}'} <= bad and good.count() + len(bad) == 5
