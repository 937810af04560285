"""Operators on small inputs: truth tables, edge cases, brute force."""

import io
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import blocks as B
from millrace.operators import frontier as K
from millrace.operators import ingest as I
from millrace.operators import merging as M
from millrace.operators import rendering as S
from millrace.operators import retrieval as R
from millrace.sources import dom, office
from millrace.streaming import crawl


def values(spark, rows, column, name="x", kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


ALLOWED = {
    U.allowed_extension: ["/novosti", "/spravka/raspisanie", "/karta?foto=vid.jpg", "/otchet.pdf", "/jpg"],
    U.no_trap: ["/raspisanie", "/page/7", "/?page=50", "/?poisk=most", "/page/0009", "/events/x2024"],
    lambda u: U.few_parameters(u, 3): ["/most", "/?x=1&y=2&z=3", "/?x=1&x=2&x=3&x=4"],
    U.has_content: ["/raspisanie", "/zametki/how-to-login-here", "/caf%C3%A9"],
}
REFUSED = {
    U.allowed_extension: ["/vid.jpg", "/Vid.PNG?w=3", "/zapis.mp4#t", "/vse.zip", "/vid.css", "/menu.js"],
    U.no_trap: ["/page/63", "/?page=51", "/cdn-cgi/l/email", "/calendar/1999", "/event/2031/5", "/?sort=name", "/?a=1&Order=up", "/?filter=x", "/page/99999999999999999999"],
    lambda u: U.few_parameters(u, 3): ["/?v=1&x=2&y=3&z=4"],
    U.has_content: ["/login", "/signin/", "/signup", "/logout", "/cart", "/checkout", "/print/7", "/feed.xml", "/rss.xml", "/sitemap.xml", "/robots.txt", "/%6Cogin"],
}


def test_url_filters(spark):
    for want, cases in ((True, ALLOWED), (False, REFUSED)):
        for rule, paths in cases.items():
            urls = ["https://lurepo.example" + p for p in paths]
            assert values(spark, urls, rule(F.col("x"))) == [want] * len(urls), paths


def test_link_scores(spark):
    urls = ["/r/s/t/u/v/w", "/", "/docs", "/category/author", "/docs/most"]
    got = values(spark, ["https://lurepo.example" + u for u in urls], F.round(U.url_score(F.col("x")), 6))
    assert got == pytest.approx([0.28, 1.0, 1.0, 0.61, 0.96])
    anchors = ["", "read more", "next", "The old bridge at night", "Bridges", "#", "→", None, "a b c d e f g h i"]
    assert values(spark, anchors, U.anchor_score(F.col("x"))) == [0.3, 0.1, 0.1, 1.0, 0.6, 0.3, 0.1, 0.3, 0.7]


def test_url_forms(spark):
    pairs = {
        "https://lurepo.example/most?utm_source=mail&utm_term=x": "https://lurepo.example/most",
        "https://lurepo.example/most?kto=ya&UTM_id=7": "https://lurepo.example/most?kto=ya",
        "https://lurepo.example/most?kto=ya#verh": "https://lurepo.example/most?kto=ya",
        "https://lurepo.example/most?z=2&b=1": "https://lurepo.example/most?b=1&z=2",
    }
    assert values(spark, list(pairs), U.normalize_for_parser(F.col("x"))) == list(pairs.values())
    stored = {
        "HTTP://User@Lurepo.EXAMPLE:8080/A/./b/../C?x=1#f": "http://lurepo.example:8080/a/c",
        "//Lurepo.example/x": "https://lurepo.example/x",
        "/no/host": None,
        "mailto:x": None,
        "https://lurepo.example": "https://lurepo.example",
        None: None,
    }
    assert values(spark, list(stored), U.normalize_for_store(F.col("x"))) == list(stored.values())
    hosts = ["https://lurepo.example/a", "https://sub.lurepo.example", "https://notlurepo.example", "/rel", "https://LUREPO.example"]
    assert values(spark, hosts, U.classify_link(F.col("x"), F.lit("lurepo.example"))) == ["internal", "internal", "external", "internal", "internal"]
    assert values(spark, ["a/b.PDF", "a.pdf?x=1", "x.jpg", "n"], U.mime_type(F.col("x"))) == ["application/pdf", "application/octet-stream", "image/jpeg", "application/octet-stream"]
    assert values(spark, ["Привет мир hello", "x", None], U.anchor_position(F.col("x"), F.lit("hello"))) == [11, 0, 0]
    assert len(values(spark, ["aaaaaaaaaahellobbbbbbbbbb"], U.anchor_snippet(F.col("x"), F.lit("hello"), 5))[0]) == 15


def test_text(spark):
    assert values(spark, ["  a  b\n c​ ", "", None], T.normalize_text(F.col("x"))) == ["a b c", "", None]
    assert values(spark, ["a  b　c", " ", None], T.word_count(F.col("x"))) == [3, 0, 0]
    assert values(spark, ["«Это» — не 12 the!"], T.letter_tokens(F.col("x"))) == [["это", "не", "the"]]


RAW = "page_id string, idx int, tag string, type string, heading_level int, text string, link_density double, position double, ancestors array<string>, html_id string, group_idx int"


def raw(spark, rows):
    """(type, level, text) of one page."""
    n = len(rows)
    full = [("p", i, f"h{lv}" if k == "heading" else "p", k, lv, t, 0.0, i / n, [], None, -1) for i, (k, lv, t) in enumerate(rows)]
    return spark.createDataFrame(full, RAW)


def test_filters(spark):
    p = "a text of several words here"
    rows = [("heading", 2, "References"), ("paragraph", None, p), ("heading", 2, "Next part of it"), ("paragraph", None, p + "!")]
    assert [r["text"] for r in B.filter_blocks(raw(spark, rows)).collect()] == [p + "!"]
    early = [("paragraph", None, p), ("heading", 2, "Читайте также")] + [("paragraph", None, p)] * 8
    late = [("paragraph", None, p)] * 6 + [("heading", 2, "Читайте также"), ("paragraph", None, p)]
    assert B.truncate_tail(raw(spark, early)).count() == 10 and B.truncate_tail(raw(spark, late)).count() == 6
    cases = [("p", [], 0.5), ("p", [], 0.6), ("p", ["article"], 0.75), ("p", ["main"], 0.8), ("table", [], 1.0)]
    df = spark.createDataFrame(cases, "t string, a array<string>, d double")
    assert [r[0] for r in df.select(B.few_links(F.col("t"), F.col("a"), F.col("d"))).collect()] == [True, False, True, False, True]


@pytest.mark.parametrize("m", [0, 1, 10, 50, 100])
def test_floor(spark, m):
    scores = [float(i + 1) for i in range(m)] + [0.0, -1.0]
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate(scores)], "page_id string, idx int, score double")
    got = {r["floor"] for r in B.page_floors(df).collect()}
    at = min(int(m * (0.15 + 0.10 * min(1.0, m / 50))), m - 1)
    assert got == {float(at + 1) if m else 0.0}


def brute_clusters(scores, floor):
    out, i = [], 0
    while i < len(scores):
        if scores[i] < floor:
            i += 1
            continue
        last, j = i, i + 1
        while j < len(scores) and j - last <= 6:
            if scores[j] >= floor:
                last = j
            j += 1
        out.append((i, last))
        i = last + 1
    return out


def test_clusters(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        scores = [float(round(x, 3)) for x in rng.exponential(1, 90) * (rng.random(90) < 0.15)]
        df = spark.createDataFrame([("p", i, s, 0.5) for i, s in enumerate(scores)], "page_id string, idx int, score double, floor double")
        got = sorted((r["first"], r["last"], round(r["total"], 3)) for r in B.find_clusters(df).collect())
        assert got == [(a, b, round(sum(scores[a : b + 1]), 3)) for a, b in brute_clusters(scores, 0.5)]


def test_merging(spark):
    heads = raw(spark, [("heading", 1, "A"), ("heading", 2, "B"), ("paragraph", None, "x"), ("heading", 2, "end")])
    assert [(r["text"], r["heading_level"]) for r in M.absorb_headings(heads).collect()] == [("A\nB\nx", 1)]
    asks = raw(spark, [("listItem", None, "Why?"), ("listItem", None, "What?"), ("listItem", None, "So."), ("paragraph", None, "p")])
    assert [(r["type"], r["text"]) for r in M.pair_questions(asks).orderBy("idx").collect()] == [("listItem", "Why?"), ("paragraph", "What?\nSo."), ("paragraph", "p")]
    short = raw(spark, [("paragraph", None, "w " * 10), ("listItem", None, "w " * 285), ("listItem", None, "w " * 20)])
    assert [r["text"].count("w") for r in M.join_short(short).orderBy("idx").collect()] == [295, 20]
    items = raw(spark, [("listItem", None, "w " * 100)] * 4)
    assert [r["text"].count("w") for r in M.join_lists(items).orderBy("idx").collect()] == [300, 100]
    assert M.merge_blocks(heads.limit(0)).count() == 0


def test_chunks(spark):
    long = "a" * 998 + ". " + "b" * 1500
    schema = "page_id string, idx int, type string, html_id string, heading_level int, text string"
    df = spark.createDataFrame([("one", 0, "p", "h", None, long), ("two", 0, "p", "h", None, long), ("two", 1, "p", "i", None, "short")], schema)
    parts = I.split_chunks(df)
    got = {(r["page_id"], r["idx"], r["part"]): (len(r["text"]), r["html_id"]) for r in parts.collect()}
    assert got[("one", 0, 0)] == (2500, "h") and got[("two", 0, 0)] == (1000, "h") and got[("two", 0, 1)] == (1000, None) and got[("two", 0, 2)] == (500, None)
    assert "".join(r["text"] for r in sorted(parts.filter("page_id = 'two' and idx = 0").collect(), key=lambda r: r["part"])) == long
    last = I.merge_short_chunks(parts).filter("page_id = 'two'").orderBy(F.desc("idx")).first()
    assert last["text"].endswith("b short")


def test_folds_keep_pages_apart(spark):
    rows = [(p, i, "p", "listItem", None, t, 0.0, 0.0, [], None, -1) for p in ("a", "b", "c") for i, t in enumerate(["x", None, "y " * 299, "z"])]
    got = [tuple(r) for r in M.join_lists(spark.createDataFrame(rows, RAW)).orderBy("page_id", "idx").select("page_id", "idx", F.length("text")).collect()]
    assert got == [(p, i, n) for p in ("a", "b", "c") for i, n in enumerate([2 + 1 + 598 - 1 + 1, 1])]


def walk_back(rows):
    """The headings over each block by their definition, one block at a time."""
    out = []
    for i, (kind, level, text) in enumerate(rows):
        least, hit = 7, kind == "heading" and text == "Notes"
        for k, lv, t in reversed(rows[:i]):
            if k == "heading" and (lv or 0) < least:
                least, hit = lv or 0, hit or t == "Notes"
        out.append(not hit)
    return out


def test_terminal_sections(spark):
    rng = np.random.default_rng(2)
    rows = [("heading", int(rng.integers(0, 7)), "Notes" if rng.random() < 0.2 else "Part") if rng.random() < 0.6 else ("paragraph", None, "x") for _ in range(200)]
    got = [r["outside"] for r in B.outside_terminal(raw(spark, rows)).orderBy("idx").collect()]
    assert got == walk_back(rows) and True in got and False in got


def test_delta(spark):
    rows = lambda n, t="x": [("p", t)] * n
    for old, new in ((2, 3), (3, 1), (0, 2), (2, 0)):
        a, b = (spark.createDataFrame(rows(k), "page_id string, text string") for k in (old, new))
        got = [r["action"] for r in I.child_diff(a, b, "page_id", ["text"]).collect()]
        assert (got.count("keep"), got.count("insert"), got.count("delete")) == (min(old, new), max(0, new - old), max(0, old - new))
    a = spark.createDataFrame([("p", None), ("p", None)], "page_id string, text string")
    assert {r["action"] for r in I.child_diff(a, a, "page_id", ["text"]).collect()} == {"keep"}
    store = spark.createDataFrame([("k", 1, "old"), ("l", 1, "stays")], "key string, v int, x string")
    fresh = spark.createDataFrame([("k", 1, "new"), ("m", 5, "first"), ("l", None, "void")], "key string, v int, x string")
    assert {r["key"]: r["x"] for r in I.upsert(store, fresh, "key", "v").collect()} == {"k": "new", "l": "stays", "m": "first"}


def test_bm25(spark):
    docs = {1: "red fox", 2: "red red dog", 3: "", 4: "blue"}
    texts = spark.createDataFrame(list(docs.items()), "key long, text string")
    queries = spark.createDataFrame([(1, "red red"), (2, "unseen"), (3, None), (4, "BLUE!")], "query_id long, text string")
    got = {(r["query_id"], r["key"]): r["score"] for r in R.bm25(queries, texts).collect()}
    n, mean = 4, 6 / 4
    score = lambda tf, dl, df: np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    assert got == {(1, 1): pytest.approx(2 * score(1, 2, 2), abs=1e-6), (1, 2): pytest.approx(2 * score(2, 3, 2), abs=1e-6), (4, 4): pytest.approx(score(1, 1, 1), abs=1e-6)}


def test_knn_and_fusion(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, []), (91, None), (92, [0.0] * 8)]
    own = spark.createDataFrame(rows, "key long, values array<float>")
    got = R.knn(own.filter("key < 5").withColumnRenamed("key", "query_id"), own, 7).collect()
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for q in range(5):
        want = sorted(range(60), key=lambda k: (-round(float(unit[q] @ unit[k]), 6), k))[:7]
        assert [r["key"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    hit = "query_id long, key long, score double, rank int"
    both = R.fuse(spark.createDataFrame([(1, 1, 9.0, 1), (1, 2, 8.0, 2)], hit), spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.4, 2)], hit))
    assert {r["key"]: r["fusion"] for r in both.collect()} == {1: 0.016393, 2: 0.032522, 3: 0.016129}
    assert [r["key"] for r in R.top(both, "fusion", 2).orderBy("rank").collect()] == [2, 1]


def test_embeddings(spark):
    texts = spark.createDataFrame([(1, "one two two"), (2, ""), (3, None)], "key long, text string")
    got = {r["key"]: r["values"] for r in R.hashed_embeddings(texts).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and set(got[2]) == set(got[3]) == {0.0}


def test_citations(spark):
    answers = spark.createDataFrame([(1, "a [1][2] b [12] [a] [3]"), (2, "none"), (3, None)], "query_id long, answer string")
    entries = spark.createDataFrame([(1, 1, 10), (1, 3, 30)], "query_id long, num int, key long")
    got = [(r["place"], r["num"], r["key"]) for r in R.citations(answers, entries).orderBy("place").collect()]
    assert got == [(0, 1, 10), (1, 2, None), (2, 12, None), (3, 3, 30)]


def test_frontier(spark):
    c = spark.createDataFrame([("low", 0.1), ("high", 0.9), ("mid", 0.5), ("also", 0.5)], "url string, score double")
    assert [r["url"] for r in K.best_first(c, 3).collect()] == ["high", "also", "mid"]
    assert K.unseen(c.union(c), c.filter("score > 0.4")).count() == 1
    mimes = ["application/pdf", "x/wordprocessingml", "x/spreadsheetml.y", "application/vnd.ms-excel", "image/png"]
    assert values(spark, mimes, K.document_hint(F.col("x"))) == ["pdf", "docx", "xlsx", "xls", None]


def test_rendering(spark):
    assert values(spark, ["PDF", "Docx", "xls", "odt", None], S.document_kind(F.col("x"))) == ["pdf", "docx", "xlsx", None, None]
    assert values(spark, ["pdf", "html", "", None], S.parser_for(F.col("x"))) == ["document", "html", "html", "html"]


def hidden(style):
    return f'<div {style}><p>secret words here</p></div><p>visible words here</p>'


@pytest.mark.parametrize(
    "style", ['aria-hidden="true"', "hidden", 'style="display:none"', 'style="display: none"', 'style="visibility:hidden"', 'style="opacity:0"', 'style="position:absolute;left:-9999px"', 'class="cookie banner"', 'role="dialog"']
)
def test_pruning(style):
    texts = [b["text"] for b in dom.parse_page("https://e.com", hidden(style))["blocks"]]
    assert texts == ["visible words here"]
    assert len(dom.parse_page("https://e.com", hidden('style="color:red"'))["blocks"]) == 2


def test_broken_html():
    page = dom.parse_page("https://lurepo.example/x", '<p><b>one<br>two<p>three<script>"</p>"</script><ul><li>a<li>b</ul>&amp;<!-- c --><table><tr><td>1<td>2</table>')
    assert [b["text"] for b in page["blocks"]] == ["onetwo", "three", "a", "b", "1, 2."]
    assert page["title"] == "Untitled"
    junk = "".join(f'<a href="{h}">x</a>' for h in ("#", "javascript:void(0)", "mailto:a@b", "tel:1", "/real", "/real#f", "f.pdf", "http://[bad"))
    assert [x["href"] for x in dom.parse_page("https://lurepo.example/x", junk)["links"]][0] == "https://lurepo.example/real"
    assert dom.parse_page("u", "")["blocks"] == [] and dom.parse_page("u", None) == {"error": "PARSE_ERROR"}


def docx(parts):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for t, s in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Sheet A" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c><c/></row></sheetData></worksheet>')
    return out.getvalue()


def test_office(spark):
    parts = [("Hello &amp; world", "Normal"), ("Chapter", "Heading1"), ("Section", "Heading"), ("", "Normal"), ("item", "ListBullet")]
    rows = [(0, docx(parts), "docx"), (1, xlsx(), "xlsx"), (2, b"broken", "docx"), (3, b"x", "odt"), (4, None, "docx")]
    df = spark.createDataFrame(rows, "i int, data binary, kind string")
    got = {r["i"]: r["rendered"] for r in office.render_documents(df, "data", F.col("kind")).collect()}
    assert got[0]["html"] == "<html><body><p>Hello &amp; world</p><h1>Chapter</h1><h2>Section</h2><li>item</li></body></html>"
    assert got[1]["html"] == "<html><body><h2>Sheet A</h2><table><tr><td>name</td><td>5</td><td></td></tr></table></body></html>"
    assert all(got[i]["html"] is None and got[i]["error"] for i in (2, 3, 4))


START = datetime(2024, 1, 1)


def test_micro_batches(spark):
    at = [0, 1, 2, 3, 70, 71, 72, 200]
    rows = [("t", START + timedelta(seconds=s), i) for i, s in enumerate(at)] + [(None, START, 99)]
    df = spark.createDataFrame(rows, "task string, ts timestamp, id long")
    got = [(r["seq"], r["size"]) for r in crawl.micro_batches(df, 3).orderBy("seq").collect()]
    assert got == [(1, 3), (2, 1), (3, 3), (4, 1)]
    assert crawl.micro_batches(df.limit(0)).count() == 0
    capped = crawl.cap_documents(spark.createDataFrame([(["a", "b", "c"],)], "documents array<string>"), most=2)
    assert capped.first()[0] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(1, 30, 120))
    rows = [("t", START + timedelta(seconds=int(s)), i) for i, s in enumerate(t)] + [("t", START + timedelta(days=2), 999)]
    df = spark.createDataFrame(rows, "task string, ts timestamp, id long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = crawl.sink(crawl.micro_batch_stream(stream, 5), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out/good")).drop("batch")
    want = crawl.micro_batches(df, 5)
    flushed = {(r["seq"], r["size"], r["first"]) for r in got.collect()}
    assert flushed == {(r["seq"], r["size"], r["first"]) for r in want.filter("last < '2024-01-02'").collect()}


def test_streamed_expiry_and_sessions(spark, tmp_path):
    rows = [("a", START), ("b", START + timedelta(minutes=1)), ("c", START + timedelta(days=1))]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    res = spark.createDataFrame([("a", START + timedelta(minutes=4)), ("b", START + timedelta(minutes=9))], "key string, ts timestamp")
    assert {r["key"] for r in crawl.expired(df, res).collect()} == {"b", "c"}
    ev = df.withColumn("user_id", F.lit(1)).drop("key")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")).withWatermark("ts", "1 minute")
    q = crawl.sliding_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(90)
    got = {(r["start"], r["writes"]) for r in spark.table("sessions").collect()}
    assert got <= {(r["start"], r["writes"]) for r in crawl.sliding_sessions(ev).collect()} and (START, 2) in got
