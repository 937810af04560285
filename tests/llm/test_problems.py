"""Each operator against a brute force or a round trip, and on nulls, empty and very long texts, ties and empty tables."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import abuse, languages, main_body, mixing, near_pages, residue, site_lines, splitting, tokens
from millrace.llm import textkernel as tk

BLOCK = "id string, page_id string, ord int, type string, text string, source_id string"
PAGE = "id string, source_id string, title string, language string"
SCRAPE = "scrape_id string, source_id string, title string, blocks array<struct<type:string,text:string>>"


def blocks(spark, rows):
    """(id, page, ord, text) with columns of clashing names beside."""
    full = [(i, p, o, "paragraph", t, "s", 1, "k") for i, p, o, t in rows]
    return spark.createDataFrame(full, BLOCK + ", n int, key string")


# ---- 1


SAMPLES = [
    ("en", "The local council of Kelbar updates the list of opening hours before the end of the month."),
    ("en", "According to the plan, the search service keeps several old photographs on the third floor."),
    ("de", "Der neue Katalog zeigt die Liste der Öffnungszeiten nach einer langen Aussprache im dritten Stock."),
    ("de", "Das Archiv von Kelbar prüft den Fahrplan für das Wochenende und eine Sicherung der Datenbank."),
    ("ru", "Городской совет Келбар обновляет список часов работы до конца месяца на третьем этаже."),
    ("ru", "Согласно плану служба поиска хранит старые фотографии площади по просьбе учителей."),
]


def test_languages(spark):
    model = languages.fit(spark.createDataFrame(SAMPLES, "lang string, text string"))
    en, de, ru = (next(t for x, t in SAMPLES if x == lang) for lang in ("en", "de", "ru"))
    b = blocks(
        spark,
        [("b1", "p1", 0, en), ("b2", "p1", 1, f"{en} {de} {en}"), ("b2", "p1", 1, f"{en} {de} {en}"), ("b3", "p2", 0, ru), ("b4", "p2", 1, None),
         ("b5", "p2", 2, ""), ("b6", "p2", 3, "12 — 34"), ("b7", "p3", 0, None), ("b8", "p2", 4, (ru + " ") * 300)],
    )
    pages = spark.createDataFrame([("p1", "s", "t", "de"), ("p2", "s", "t", " RU-xx"), ("p3", "s", "t", None), ("p4", "s", "t", None)], PAGE)
    found = {tuple(r) for r in languages.label_cases(pages, b, model).collect()}
    assert found == {("page", "p1", "en"), ("block", "b2", "de")}
    assert languages.label_cases(pages, b.limit(0), model).count() == 0


def test_passages(spark):
    model = languages.fit(spark.createDataFrame(SAMPLES, "lang string, text string"))
    en, de, ru = (next(t for x, t in SAMPLES if x == lang) for lang in ("en", "de", "ru"))
    text = f"{en} {de} {en} {ru} {en} {de}"
    b = blocks(spark, [("b1", "p1", 0, " ".join([en] * 9)), ("b2", "p1", 1, text), ("b3", "p1", 2, f"- {de} "), ("b4", "p1", 3, None)])
    rows = languages.infer_languages(b, model)[1].collect()
    texts = {"b2": text, "b3": f"- {de} "}
    got = sorted((r["block_id"], r["begin"], r["lang"], texts[r["block_id"]][r["begin"] : r["end"]]) for r in rows)
    cut = lambda s: s.rstrip(".")
    first = len(en) + 1
    assert [x[2:] for x in got] == [("de", cut(de)), ("ru", cut(ru)), ("de", cut(de)), ("de", cut(de))]
    assert got[0][1] == first and all(0 < r["confidence"] <= 1 for r in rows)


def test_languages_within_the_penalty(monkeypatch):
    model = languages.NgramModel(sorted(SAMPLES))
    texts = [next(t for x, t in SAMPLES if x == lang) for lang in ("en", "de")]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array(["p", "p"]), pa.array(texts)], names=["id", "page_id", "text"])
    shared = type("Shared", (), {"value": model})

    def near() -> list[int]:
        return [r["passages"][0]["near"] for b in languages._infer(shared, 40)(iter([batch])) for r in b.to_pylist()]

    en, de = (1 << model.langs.index(x) for x in ("en", "de"))
    assert near() == [en, de]
    monkeypatch.setattr(languages, "PENALTY", 1e9)  # now every language comes within it
    assert near() == [7, 7]


# ---- 2


@pytest.mark.parametrize("text", ["a" * 5000, "word " * 900, "One. " * 700, ("x" * 1500 + ". ") * 3, "L\n" * 1200, "ab. " + "c" * 1200 + " d. " + "e" * 10])
def test_pieces(text):
    t = text.strip()
    (pieces,), (forced,) = splitting.cut_texts([t], 1000, 100)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
    assert all(0 < e - b <= 1000 for b, e in pieces)
    for (_, e), (b, _) in itertools.pairwise(pieces):
        assert e - 120 <= b <= e
    stretches = re.split(r"\n|(?<=[.!?…])\s", t)
    assert forced == int(max(len(s.strip()) for s in stretches) > 1000)
    greedy = [0]  # the same cuts, one after another
    while greedy[-1] < len(t):
        after = [b for b in range(len(pieces)) if pieces[b][1] > greedy[-1]]
        greedy.append(pieces[after[0]][1])
    assert greedy[1:] == [e for _, e in pieces]


def test_split_edges(spark):
    rows = [("block:1", "x " * 800, "n"), ("block:1", "x " * 800, "n"), ("block:2", None, "n"), ("block:3", "  " * 900, "n"), (None, "x" * 2000, "n"), ("block:4", "y" * 1000, "n")]
    got = splitting.split_oversized(spark.createDataFrame(rows, "item_key string, text string, k string")).collect()
    assert {r["item_key"] for r in got} == {"block:1"} and {r["forced"] for r in got} == {1}
    assert "".join(r["piece"] for r in sorted(got, key=lambda r: r["piece_no"])).count("x") >= 800


# ---- 3


def test_repeated_lines(spark):
    rows = [(f"b{i}", f"p{i}", 0, f"Own text number {'abcdefghij'[i]} of page\n{'© 2020 ALL RIGHTS' if i % 2 else '© 2021 All  rights'}") for i in range(8)]
    rows += [("c1", "q1", 0, "© 2020 all rights"), ("c2", "q2", 0, None), ("c3", "q3", 0, ""), ("b0", "p0", 0, rows[0][3]), ("d1", "none", 0, "© 2020 all rights")]
    pages = spark.createDataFrame([(f"p{i}", "s1", "t", None) for i in range(8)] + [("p0", "s1", "t", None), ("q1", "s2", "t", None), ("q2", None, "t", None)], PAGE)
    b = blocks(spark, rows)
    found = site_lines.repeated_lines(b, pages)
    assert {tuple(r) for r in site_lines.same_lines(found).collect()} == {(f"b{i}", 1) for i in range(8)}
    clean = {r["id"]: r["text"] for r in site_lines.remove_lines(b.dropDuplicates(["id"]), found).collect()}
    assert clean["b3"] == "Own text number d of page" and clean["c1"] == "© 2020 all rights" and clean["c2"] is None
    assert site_lines.repeated_lines(b.limit(0), pages).count() == 0
    assert site_lines.similar_lines(b, site_lines.repeated_lines(b.limit(0), pages)).count() == 0


def test_similar_lines(spark):
    notice = "the editors of this small paper do not answer for what its readers write below any of the texts"
    rows = [(f"a{i}", f"p{i}", 0, f"Report {n}\n{notice}") for i, n in enumerate("Vasko Torma,Pelda Ruvi,Kimor Tal,Zerim Osta,Lunde Fara,Bramo Keld,Ostra Vin,Mirel Dosk,Falko Brun".split(","))]
    rows += [("b1", "q1", 0, notice + " here"), ("b2", "q2", 0, notice.replace("small", "little").replace("readers", "guests")), ("b3", "q3", 0, None)]
    pages = spark.createDataFrame([(r[1], "s1", "t", None) for r in rows], PAGE)
    b = blocks(spark, rows)
    found = site_lines.similar_lines(b, site_lines.repeated_lines(b, pages))
    gone = {(r["block_id"], r["line_no"]) for r in found.collect()}
    assert gone == {(f"a{i}", 1) for i in range(9)} | {("b1", 0)}  # not headings of one form, nor the line with two words changed


# ---- 4


def page_runs(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_near_pages(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for g in range(12):
        base = list(rng.choice(words, 80))
        for k in range(4):
            own = list(base)
            for _ in range(int(rng.integers(0, 9))):
                own[int(rng.integers(0, 80))] = f"e{rng.integers(0, 999)}"
            texts[f"{g:02}-{k}"] = " ".join(own)
    texts |= {"x1": "one two three", "x2": "One, two: three!", "x3": "one two", "x4": "one two"}
    rows = [(f"{p}-{o}", p, o, t) for p, text in texts.items() for o, t in enumerate(re.split(r"(?<=w7) ", text))]
    b = blocks(spark, rows + rows[:5] + [("n", "x5", 0, None), ("m", "x1", 9, None)])
    want = set()
    for a, c in itertools.combinations(sorted(texts), 2):
        x, y = page_runs(texts[a]), page_runs(texts[c])
        if x and y and 10 * len(x & y) >= 7 * len(x | y):
            want.add((a, c))
    assert {tuple(r) for r in near_pages.near_page_pairs(b).collect()} == want and len(want) > 10
    classes = {r["page_id"]: r["class_id"] for r in near_pages.page_classes(b).collect()}
    assert all(classes[a] == classes[c] for a, c in want)
    assert near_pages.near_page_pairs(b.limit(0)).count() == 0


def test_copied_pages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_pages, "BLOCK", 3)
    monkeypatch.setattr(near_pages, "CELL", 2)
    text = "the tram to the harbour is late again because the rails are wet and the driver is new"
    rows = [(f"c{i:02}-0", f"c{i:02}", 0, text) for i in range(10)] + [(f"d{i}-0", f"d{i}", 0, text + " indeed" * i) for i in range(1, 4)]
    got = [tuple(r) for r in near_pages.near_page_pairs(blocks(spark, rows)).collect()]
    sets = {r[1]: page_runs(r[3]) for r in rows}
    assert len(got) == len(set(got))
    assert set(got) == {(a, c) for a, c in itertools.combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[c]) >= 7 * len(sets[a] | sets[c])}


# ---- 5 and 6


def test_main_body(spark):
    rows, furniture = [], set()
    topics = "river bridge market school garden tower museum harbour library station castle mill".split()
    for i, t in enumerate(topics):
        page = f"p{i}"
        lines = [
            "Home | News | Contacts", f"The {t} was rebuilt by {i + 2} men who came over the {topics[i - 1]} road at night.", f"© {2000 + i} Quimel Torva. All rights reserved",
            f"Share this page: mail {i}\nNobody in the {t} had heard the {topics[i - 2]} bells ring so late.", None if i else "",
        ]
        rows += [(f"{page}-{o}", page, o, "paragraph", x, f"s{i % 6}") for o, x in enumerate(lines)]
        furniture |= {(f"page:{page}", 0), (f"page:{page}", 2), (f"page:{page}", 4)}
    b = spark.createDataFrame(rows + rows[:3], BLOCK)
    s = spark.createDataFrame([("x", "s1", "t", [("paragraph", "Home | News | Contacts")]), ("y", "s1", "t", None)], SCRAPE)
    got = {tuple(r) for r in main_body.furniture_blocks(main_body.page_streams(b, s)).collect()}
    assert got == furniture | {("scrape:x", 0)}
    assert main_body.furniture_blocks(main_body.page_streams(b.limit(0), s.limit(0))).count() == 0


def test_main_body_text(spark):
    topics = "river bridge market school garden tower museum harbour library station castle mill".split()
    rows = [(f"p{i}-{o}", f"p{i}", o, "paragraph", x, f"s{i % 6}")
            for i, t in enumerate(topics)
            for o, x in enumerate(["Home | News | Contacts", f"Share this page: mail {i}\nNobody in the {t} had heard the {topics[i - 2]} bells ring so late.\n12"])]
    b = spark.createDataFrame([*rows, *rows[:3]], BLOCK)
    got = {tuple(r) for r in main_body.main_body(main_body.page_streams(b, spark.createDataFrame([], SCRAPE))).collect()}
    assert got == {(f"page:p{i}", 1, f"Nobody in the {t} had heard the {topics[i - 2]} bells ring so late.\n12", 1) for i, t in enumerate(topics)}


def test_main_body_of_large_site(spark):
    rows = [(f"p{i}-{o}", f"p{i}", o, "paragraph", x, "s" if i % 2 else None)
            for i in range(300)
            for o, x in enumerate([f"a{i} b{i} c{i} d{i} e{i}", *(["the desk is closed for a week"] if i < 14 else [])])]
    pages = spark.createDataFrame([(f"p{i}", "s", "t", None) for i in range(300)], PAGE)
    streams = main_body.page_streams(spark.createDataFrame(rows, BLOCK), spark.createDataFrame([], SCRAPE), pages)
    assert {tuple(r) for r in main_body.furniture_blocks(streams).collect()} == {(f"page:p{i}", 1) for i in range(14)}
    twice = [("x", "p0", 0, "paragraph", "\n".join(["the desk is closed for a week"] * 20), "s")]  # many lines, one page
    streams = main_body.page_streams(spark.createDataFrame(twice, BLOCK), spark.createDataFrame([], SCRAPE))
    assert main_body.furniture_blocks(streams).count() == 0


def test_wrappers(spark):
    """A constant, an optional, a repeated group and a slot of one host, with pages in several chunks."""
    rows = []
    for i in range(200):
        lines = ["Home of the club", *(["Members only"] if i % 3 == 0 else []), *["Read more here"] * (i % 4), f"Advert. Buy the {'abcdefgh'[i % 8] * 3} lamp now", f"own words {i} x{i} y{i}"]
        rows += [(f"p{i}-{o}", f"p{i}", o, "paragraph", t, "s") for o, t in enumerate(lines)]
    streams = main_body.page_streams(spark.createDataFrame(rows + rows[:40], BLOCK), spark.createDataFrame([], SCRAPE))
    items = main_body.host_wrappers(streams.mapInArrow(main_body._segments, main_body._SCHEMA)).collect()
    by_pages = {r["pages"]: r for r in items if r["kind"] == "t"}
    home, members, more = by_pages[200], by_pages[67], by_pages[150]
    assert not home["optional"] and not home["repeated"] and home["lines"] == 200
    assert members["optional"] and not members["repeated"] and home["place"] < members["place"]
    assert more["repeated"] and more["lines"] == 300
    slot = next(r for r in items if r["kind"] == "p" and r["pages"] == 200)
    assert slot["least"] < slot["most"]
    found = {r["page_key"] for r in main_body.furniture_blocks(streams).collect()}
    assert found == {f"page:p{i}" for i in range(200)}


def test_place_in_wrapper(spark):
    """On few pages, lines that keep their order are furniture; one that moves about them isn't."""
    rows = []
    for i, t in enumerate("river bridge market school garden tower museum harbour library station".split()):
        lines = ["Home of the club", f"they rebuilt a {t} by night", "the desk is closed for a week"]
        lines.insert(3 * (i % 2), "nobody knows where the river ends")
        rows += [(f"p{i}-{o}", f"p{i}", o, "paragraph", x, "s") for o, x in enumerate(lines)]
    streams = main_body.page_streams(spark.createDataFrame(rows, BLOCK), spark.createDataFrame([], SCRAPE))
    got = {tuple(r) for r in main_body.furniture_blocks(streams).collect()}
    assert got == {(f"page:{r[1]}", r[2]) for r in rows if r[4] in ("Home of the club", "the desk is closed for a week")}


def test_letter_case(spark):
    rows = [(f"p{i}-0", f"p{i}", 0, "paragraph", "Published by Kelmo Tarvi for the town", "s") for i in range(15)]
    rows += [("q-0", "q", 0, "paragraph", "PUBLISHED BY KELMO TARVI FOR THE TOWN", "s"), ("r-0", "r", 0, "paragraph", "PUBLISHED BY KELMO TARVI FOR A FRIEND", "s")]
    streams = main_body.page_streams(spark.createDataFrame(rows, BLOCK), spark.createDataFrame([], SCRAPE))
    got = {r["page_key"] for r in main_body.furniture_blocks(streams).collect()}
    assert "page:q" in got and "page:r" not in got and len(got) == 16


def test_residue(spark):
    bad = ["404 Not Found", "СТРАНИЦА НЕ НАЙДЕНА!", "Please  enable JavaScript to view this page. Incident 12", "Lorem ipsum dolor sit amet.", "The {{ doc.name }} of ${city}", "[object Object]"]
    good = ["How to fix error 404 in Kelbar", "In a template of X the expression {{ name }} is replaced by a value.", "Untitled", "", None, "The 404 page was redesigned by the team.", "{ x: 1 }"]
    rows = [("k", "s", t, [("paragraph", t)]) for t in bad + good]
    rows = [(f"{i}", *r[1:]) for i, r in enumerate(rows)] + [("z", "s", None, None)]
    pages = spark.createDataFrame([("p", "s", bad[0], None), ("p", "s", bad[0], None), ("q", None, None, None)], PAGE)
    got = {tuple(r) for r in residue.find_residue(residue.searched_texts(pages, spark.createDataFrame(rows, SCRAPE))).collect()}
    assert got == {(f"scrape:{i}", n) for i in range(len(bad)) for n in (-1, 0)} | {("page:p", -1)}
    empty = residue.searched_texts(pages.limit(0), spark.createDataFrame([], SCRAPE))
    assert residue.find_residue(empty).count() == 0


def test_residue_candidates(spark):
    words = "alder birch cedar elm fir hazel larch maple".split()
    texts = [" ".join([*words[:i], w, *words[i:]]) for i in range(1, 9) for w in ("oak", "pine", "rowan")]
    rows = spark.createDataFrame([("k", n, t) for n, t in enumerate([*texts, "alder birch cedar", "oak pine"])], "page_key string, block_no int, text string")
    got = {r["block_no"] for r in residue.find_residue(rows, [" ".join(words)]).collect()}
    assert got == set(range(len(texts)))  # one word in nine is new: all are similar


def test_residue_sentences(spark):
    bad = ["Извините. Страница не найдена.", "Oops! We can't find the page you are looking for", "All is well here. The tram is late. Access denied."]
    good = ["Oops! I left the keys at home", "Oops.", "A variable has no value. Access denied. That is what the template shows."]
    rows = spark.createDataFrame([("k", n, t) for n, t in enumerate(bad + good)], "page_key string, block_no int, text string")
    assert {r["block_no"] for r in residue.find_residue(rows).collect()} == set(range(len(bad)))


# ---- 7 and 8


TEXTS = [None, "", " ", "\n\n  x", "it's the end", "Привет,  мир 123!", "a" * 3000, "深夜 ½ №", "<|endoftext|>", "‏שלום", "tabs\t\tand\r\nlines ", "same", "same"]


def test_tokens(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    whole = tokens.encoder(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs).collect()}
    assert got == {i: whole.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0
    spread = tokens.encode_corpus(docs.repartition(5), group=1)  # several chunks, each its own join key
    assert {r["doc_id"]: r["ids"] for r in spread.collect()} == got


def test_budgets():
    leaves = [(("d", "en"), "a", 0.5, 100.0), (("d", "en"), "b", 0.3, 1000.0), (("e", "en"), "c", 0.2, 1000.0)]
    assert mixing.budgets(leaves) == pytest.approx({"a": 100, "b": 60, "c": 40})
    assert mixing.budgets(leaves, 400) == pytest.approx({"a": 100, "b": 220, "c": 80})  # the sibling first
    assert mixing.budgets([*leaves, (("f",), "none", 1.0, 0.0)], 100) == pytest.approx({"a": 50, "b": 30, "c": 20, "none": 0})
    assert mixing.budgets([]) == {}


def test_mix(spark):
    docs = spark.createDataFrame(
        [(i, " word" * (5 + i % 7), ("a", "b", "c")[i % 3], "en") for i in range(300)] + [(900, None, "a", None), (901, "", "b", "en"), (902, "x", "other", "en"), (903, " w" * 30, "d", "en")],
        "doc_id long, text string, source string, lang string",
    )
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.1, 1), ("d", 0.1, 3), ("gone", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, targets)
    rows, by = mix.collect(), {r["source"]: r for r in report.collect()}
    assert {r["source"] for r in rows} == {"a", "b", "c", "d"} and by["gone"]["tokens"] == 0 and by["d"]["most_uses"] == 3
    most = {"a": 1, "b": 2, "c": 1, "d": 3}
    uses = {}
    for r in rows:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        assert uses[r["doc_id"]] <= most[r["source"]]
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.1), ("d", 0.1)):
        assert by[s]["share"] == pytest.approx(share / 0.9, abs=0.03)
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(7), targets)[0].collect())) == sorted(map(tuple, rows))
    assert mixing.mix_sources(docs.limit(0), targets)[0].count() == 0


# ---- 9


def test_abuse(spark):
    rng = np.random.default_rng(1)
    calm = ["The council updates the list of opening hours.", "The rules forbid insults such as the word idiot.", "Stars are visible to the naked eye."]
    rude = ["You are a complete idiot and should rot!!!", "Shut up, y0u 1d1ot", "Hot nude sex shows tonight"]
    rows = []
    for i in range(240):
        parts = [calm[int(rng.integers(0, 3))] for _ in range(3)] + ([rude[i % 3]] if i % 6 == 0 else [])
        rows.append((i, " ".join(parts), "s"))
    rows += [(990, None, "s"), (991, "", "t"), (992, "   ", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = [(i, int(i % 6 == 0), None) for i in range(0, 240, 2)] + [(0, 1, None), (3, None, None), (5, 7, None)]
    model = abuse.fit(docs, spark.createDataFrame(labels, "doc_id long, abusive int, reviewed_at timestamp"))
    s = {r["doc_id"]: r["score"] for r in abuse.score_documents(docs, model).collect()}
    held_out = range(1, 240, 2)
    assert all((s[i] >= 0.5) == (i % 6 == 0) for i in range(0, 240, 2)) and all(s[i] < 0.5 for i in held_out)
    assert s[990] < 0.5 and s[991] < 0.5 and len(s) == 243
    rates = {r["source"]: r for r in abuse.source_rates(docs, abuse.score_documents(docs, model)).collect()}
    assert rates["s"]["flagged"] == 40 and rates["t"]["flagged"] == 0
    none = abuse.fit(docs, spark.createDataFrame([], "doc_id long, abusive int"))
    assert none is None and {r["score"] for r in abuse.score_documents(docs, none).collect()} == {0.0}


def test_folding():
    assert [abuse._fold(w)[0] for w in ("АНАЛ", "idiоt", "1d1ot", "п.р.я.м.о", "e-x-p-l-i-c-i-t", "мудааааак")] == ["анал", "idiot", "idiot", "прямо", "explicit", "мудак"]


def test_isotonic():
    at, score = abuse.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert np.interp([0, 1, 2, 3], at, score).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_kernel():
    values, begins = tk.shingles(np.array([1, 2, 3, 4, 9], np.uint64), np.array([0, 4, 5, 5]), 3)
    assert begins.tolist() == [0, 2, 3, 3] and len(set(values.tolist())) == 3
    assert tk.minhash(values, begins, 4).shape == (3, 4)
    for numbers in ([], [0], [127, 128, 0, 1 << 20, (1 << 48) - 1]):
        assert tk.unpacked(tk.packed(np.array(numbers, np.uint64))).tolist() == numbers
