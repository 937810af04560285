"""The text search over tables whose pairs of query and text are too many to be written down."""

import math
import os
import random
import re

import pytest

import __spark_entry__ as entry

from millrace.operators import retrieval as R
from millrace.operators import textindex


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    return store.executorSummary("driver").totalShuffleWrite()


def scores(texts, queries, n):
    words = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries.items():
        found = {}
        for t in (text or "").lower().split():
            for k, w in words.items() if t in df else ():
                if c := w.count(t):
                    idf = math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
                    found[k] = found.get(k, 0) + idf * c / (c + 1.2 * (0.25 + 0.75 * len(w) / mean))
        out[q] = sorted(found, key=lambda k: (-round(found[k], 6), k))[:n]
    return out


def test_bm25_writes_no_pairs(spark):
    texts = spark.createDataFrame([(i, f"the of w{i % 97} x{i}") for i in range(4000)], "key long, text string")
    queries = spark.createDataFrame([(i, f"the of w{i % 97}") for i in range(400)], "query_id long, text string")
    before = shuffled(spark)
    assert R.bm25(queries, texts).count() == 400 * 50
    assert shuffled(spark) - before < 4e6  # 1.6 million pairs took more


def test_bm25_groups(spark, monkeypatch):
    rnd = random.Random(3)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(60)]
    texts = {f"k{i:03}": " ".join(rnd.choices(common, k=rnd.randint(1, 6)) + rnd.choices(rare, k=rnd.randint(0, 2))) for i in range(300)}
    texts |= {f"copy{i}": texts["k000"] for i in range(30)} | {"none": None, "blank": " "}
    queries = {i: " ".join(rnd.choices(common, k=rnd.randint(0, 4)) + rnd.choices(rare + ["unseen"], k=2)) for i in range(40)} | {98: None, 99: texts["k000"]}
    monkeypatch.setattr(R, "GROUP_TEXTS", 70)
    monkeypatch.setattr(R, "QUERIES", 16)
    monkeypatch.setattr(textindex, "PART_TEXTS", 50)
    own = spark.createDataFrame(list(texts.items()), "key string, text string").repartition(4)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    for n in (1, 12):
        got = {}
        for r in R.bm25(asked, own, n).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["key"])
        assert got == {q: k for q, k in scores(texts, queries, n).items() if k}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts that share their title's words, of which every twentieth is asked: 150 queries that all 3,000 texts answer."""
    at, rnd = tmp_path_factory.mktemp("tables"), random.Random(5)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = [f"the list of {' '.join(word() for _ in range(rnd.randint(40, 120)))}" for _ in range(3000)]
    docs = [(i, f"the list of {word()}", t, f"s{i % 40}" if i % 7 else "portal.velmora.example", f"http://u/{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, title string, text string, source string, url string").repartition(4).write.parquet(f"{at}/documents.parquet")
    vectors = [(i, [rnd.random() for _ in range(4)]) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    page = lambda i: f"p{i // 4}"
    spark.createDataFrame([(f"b{i}", page(i), i % 4, "s", t) for i, t in enumerate(texts)], "id string, page_id string, ord int, source_id string, text string").repartition(4).write.parquet(f"{at}/page_blocks.parquet")
    spark.createDataFrame([(f"p{i}", "s", f"http://u/p{i}", "T") for i in range(750)], "id string, source_id string, url string, title string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([("d", "p1", "http://u/d", "About", "the file")], "id string, page_id string, url string, description string, extracted_text string").write.parquet(f"{at}/page_documents.parquet")
    return str(at)


#: The most MB that each query shuffles; with pairs of query and text it was at least 13 for blocks and 3.6 for the others.
SHUFFLED = {
    "search_blocks_context": 7,
    "search_blocks_topk": 7,
    "search_hybrid_rrf": 1,
    "search_source_scoped_post": 1,
    "search_dedupe_by_page": 1,
    "search_prompt": 1,
    "search_rerank_lexical": 1,
    "search_result_view": 1,
    "search_context": 1,
}


@pytest.mark.parametrize("name", SHUFFLED)
def test_query_shuffles_no_pairs(spark, tables, name):
    before = shuffled(spark)
    assert entry.queries()[name](spark, tables).count()
    assert (shuffled(spark) - before) / 1e6 < SHUFFLED[name]


def on_disk(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return sum(os.path.getsize(f) for f in files.split("\n") if "shuffle_" in f and os.path.exists(f))


def test_search_keeps_no_shuffle_files(spark, tables, monkeypatch):
    monkeypatch.setattr(R, "QUERIES", 50)
    before = on_disk(spark)
    found = entry.queries()["search_blocks_topk"](spark, tables)
    assert on_disk(spark) - before < 1e5  # they stayed until the driver collected its garbage
    assert found.count() == 150 * 50
