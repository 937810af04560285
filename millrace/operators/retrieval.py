"""Retrieval over a batch of queries: BM25, exact kNN, fusion, deduplication, reranking, context, citations, feedback.

Queries are (query_id, text); index texts are (key, text); vectors are (key, values array<float>). Ranks go by the
rounded score, then by key, so that a rerun and another engine give the same order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..runtime import broadcast_if_small, materialize, release, settings, shared_path
from . import textindex

#: Most texts and postings of a group of the text search, and queries of a chunk that meets it.
GROUP_TEXTS, GROUP_POSTINGS, QUERIES = 524_288, 4_000_000, 8192
#: Files of a shuffle are deleted once what needs them is written, not when the driver happens to collect its garbage; and few rows
#: are read at a time, as a row of postings may hold a whole part.
PACKED = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true", "spark__sql__parquet__columnarReaderBatchSize": "128", "spark__sql__execution__arrow__maxRecordsPerBatch": "1024"}
#: Rows of vectors in one block of the exact search.
BLOCK = 2048


@dataclass(frozen=True)
class Mode:
    """How many candidates each stage passes on."""

    text_top: int
    vector_top: int
    rrf_k: int
    rerank_top: int
    final_top: int

    def __post_init__(self) -> None:
        if min(self.text_top, self.vector_top, self.rrf_k, self.rerank_top, self.final_top) <= 0:
            raise ValueError("every number of a mode must be positive")


FAST = Mode(50, 50, 60, 8, 4)
DEEP = Mode(100, 100, 60, 16, 8)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(texts: DataFrame) -> DataFrame:
    """(term, key, tf, dl): how often each term stands in each text, and the text's length."""
    words = texts.select("key", tokens(F.col("text")).alias("w"))
    words = words.select("key", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy("term", "key", "dl").agg(F.count("*").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf): texts and places of each term."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top(scored: DataFrame, score: str, n: int, by: str = "query_id", tie: str = "key") -> DataFrame:
    """The best ``n`` rows of each query with their ``rank`` from 1."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


@dataclass(frozen=True)
class TextIndex:
    """Packed postings (see ``textindex``) in the order of terms, and the number and mean length of all texts."""

    postings: DataFrame
    size: DataFrame


def _words(texts: DataFrame) -> DataFrame:
    return texts.select("key", tokens(F.col("text")).alias("w"))


def write_text_index(texts: DataFrame, path: str) -> None:
    """Packed postings sorted by term in files that don't overlap in terms, so that a search reads only its terms' row groups and
    the keys; a frequent term is cut by part. Tokens are worked out once."""
    with settings(texts.sparkSession, **PACKED):
        counted = materialize(textindex.packed(_words(texts)))  # the ranges are sampled first, which would count all words twice
        ordered = counted.repartitionByRange("term", "part").sortWithinPartitions("term", "part")
        ordered.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/postings")  # snappy takes memory off the heap by pages, which are long here
        _size(counted).write.mode("overwrite").parquet(f"{path}/size")
    release(counted)


def open_text_index(spark, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/size"))


def _size(packed: DataFrame) -> DataFrame:
    whole = packed.filter("term is null")
    return whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), (F.sum("total") / F.sum("n")).alias("mean"))


def bm25(queries: DataFrame, texts: DataFrame | TextIndex, n: int = FAST.text_top) -> DataFrame:
    """(query_id, key, score, rank). Only the queries' terms are looked up in the postings, stored ones or those of a table
    of texts; a repeated query term counts each time; an empty query finds nothing. The corpus has one row for each key.

    Chunks of queries are ranked one after another, so that the postings are shuffled for one of them at a time."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    packed = texts.postings if isinstance(texts, TextIndex) else textindex.packed(_words(texts))
    with settings(spark, **PACKED):
        asked = materialize(asked)  # read again and again, and its size is estimated from what is written
        wanted = asked.select(F.col("term").alias("_term")).distinct().withColumn("_asked", F.lit(True))
        own = F.coalesce("term", F.concat(F.lit(" "), "part"))  # rows without a term are spread where the join shuffles
        post = packed.withColumn("_term", own).join(broadcast_if_small(wanted), "_term", "left").filter("term is null or _asked")
        post = materialize(post.select(packed.columns))
        weighed = materialize(_weighed(asked, post, texts.size if isinstance(texts, TextIndex) else _size(post)))
        groups, chunks = _groups(post), max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
        path = shared_path(spark)
        for i in range(chunks):
            met = _ranked(weighed.filter(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == i), post, groups, n)
            met.write.option("compression", "zstd").mode("append").parquet(path)
    for used in (asked, post, weighed):
        release(used)
    found = spark.read.schema(met.schema).parquet(path)
    found._millrace_path = path
    return found


def _weighed(asked: DataFrame, post: DataFrame, size: DataFrame) -> DataFrame:
    """(query_id, term, weight, mean): the terms that stand in texts, each with its idf times its count in the query."""
    df = post.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(size))  # size is one row
    return weighed.select("query_id", "term", (F.col("qtf") * idf).alias("weight"), "mean")


def _groups(post: DataFrame) -> int:
    many = post.agg(F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("texts"), F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("postings")).first()
    return max(1, -(-(many["texts"] or 0) // GROUP_TEXTS), -(-(many["postings"] or 0) // GROUP_POSTINGS))


def _ranked(weighed: DataFrame, post: DataFrame, groups: int, n: int) -> DataFrame:
    """Groups of parts meet the queries; each passes on its best ``n`` for each query."""
    left = post.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)))
    right = weighed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    kinds = dict(weighed.dtypes)["query_id"], dict(post.dtypes)["keys"].removeprefix("array<")[:-1]
    rank = textindex.ranking(n, to_arrow_type(weighed.schema["query_id"].dataType))
    met = left.groupBy("group").cogroup(right.groupBy("group"))
    found = met.applyInArrow(rank, f"query_id {kinds[0]}, key {kinds[1]}, score double")
    return top(found.withColumn("score", F.round("score", 6)), "score", n)


def search_text(index: TextIndex, text: str, n: int = FAST.text_top) -> DataFrame:
    """R01 for one query on a stored index: its terms are literals, which the scan takes as a filter on row groups."""
    words = Counter(re.findall(r"[^\W_]+", text.lower()))
    spark = index.postings.sparkSession
    asked = F.broadcast(spark.createDataFrame([(0, w, c) for w, c in sorted(words.items())], "query_id long, term string, qtf long"))
    post = index.postings.filter(F.col("term").isNull() | F.col("term").isin(*words))
    return _ranked(_weighed(asked, post, index.size), post, _groups(post), n)


def _packed(vectors: DataFrame, key: str, values: str, blocks: int) -> DataFrame:
    """Vectors in ``blocks`` blocks of float64 rows; null and empty vectors are left out."""
    rows = vectors.filter(F.size(values) > 0).select(F.col(key).alias("k"), F.col(values).cast("array<double>").alias("v"))
    return rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("k", "v")).alias("rows"))


def knn(queries: DataFrame, vectors: DataFrame, n: int = FAST.vector_top, key_type: str = "long") -> DataFrame:
    """(query_id, key, score, rank) by cosine over all vectors, exactly. Query blocks meet vector blocks, each pair a
    matrix product that passes on its best ``n`` for each query; blocks hold about ``BLOCK`` rows however large the table."""
    q_blocks = max(1, -(-queries.count() // BLOCK))
    v_blocks = max(1, -(-vectors.count() // BLOCK))
    q = _packed(queries, "query_id", "values", q_blocks).select(F.col("rows").alias("q"))
    v = _packed(vectors, "key", "values", v_blocks).select(F.col("rows").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_rows, v_rows in zip(b["q"], b["v"]):
                qm, vm = (np.array([r["v"] for r in rows], float) for rows in (q_rows, v_rows))
                qn, vn = (np.linalg.norm(m, axis=1, keepdims=True) for m in (qm, vm))
                s = np.round((qm / np.where(qn == 0, 1, qn)) @ (vm / np.where(vn == 0, 1, vn)).T, 6)
                keys = np.array([r["k"] for r in v_rows])
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :n]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat([r["k"] for r in q_rows], order.shape[1]),
                        "key": keys[order].reshape(-1),
                        "score": np.take_along_axis(s, order, 1).reshape(-1),
                    }
                )

    # blocks against blocks, not rows against rows
    met = v.repartition(v_blocks).crossJoin(q).mapInPandas(run, f"query_id long, key {key_type}, score double")
    return top(met, "score", n)


def fuse(text_hits: DataFrame, vector_hits: DataFrame, k: int = FAST.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion: (query_id, key, score_sparse, score_dense, fusion)."""
    one = F.lit(1.0) / (k + F.col("rank"))
    a = text_hits.select("query_id", "key", F.col("score").alias("s"), F.lit(None).cast("double").alias("d"), one.alias("f"))
    b = vector_hits.select("query_id", "key", F.lit(None).cast("double").alias("s"), F.col("score").alias("d"), one.alias("f"))
    return a.unionByName(b).groupBy("query_id", "key").agg(
        F.max("s").alias("score_sparse"), F.max("d").alias("score_dense"), F.round(F.sum("f"), 6).alias("fusion")
    )


def route(hits: DataFrame) -> DataFrame:
    """Adds kind (block, document) and id; other and blank keys are dropped."""
    kind = F.when(F.col("key").startswith("block:"), "block").when(F.col("key").startswith("document:"), "document")
    id_ = F.regexp_replace("key", "^(block|document):", "")
    return hits.select("*", kind.alias("kind"), id_.alias("id")).filter("kind is not null and trim(id) <> ''")


def hydrate(hits: DataFrame, blocks: DataFrame, documents: DataFrame, pages: DataFrame, source_id: Column | None = None) -> DataFrame:
    """Hits with page_id, url, title, text and ord, for one source where given; null source_id means all."""
    page = pages.select(F.col("id").alias("page_id"), "source_id", F.col("url").alias("page_url"), F.col("title").alias("page_title")).dropDuplicates(["page_id"])
    if source_id is not None:
        page = page.filter(F.col("source_id") == source_id)
    own = blocks.select(F.col("id"), "page_id", "text", "ord").dropDuplicates(["id"]).join(page, "page_id")
    own = own.select(F.lit("block").alias("kind"), "id", "page_id", F.col("page_url").alias("url"), F.col("page_title").alias("title"), "text", "ord")
    files = documents.select("id", "page_id", "url", F.col("description").alias("title"), F.col("extracted_text").alias("text")).dropDuplicates(["id"])
    files = files.join(page.select("page_id"), "page_id").select(F.lit("document").alias("kind"), "id", "page_id", "url", "title", "text", F.lit(None).cast("int").alias("ord"))
    return route(hits).join(own.unionByName(files), ["kind", "id"])


def one_for_page(hits: DataFrame, score: str = "fusion") -> DataFrame:
    """Of a page's blocks the best one; documents are left alone."""
    group = F.when(F.col("kind") == "block", F.col("page_id").cast("string")).otherwise(F.col("key").cast("string"))
    order = Window.partitionBy("query_id", "kind", group).orderBy(F.col(score).desc(), "key")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def lexical_score(query: Column, text: Column) -> Column:
    """R08 offline: the share of the query's distinct words that the text holds."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6)).otherwise(F.lit(0.0))


def of_keys(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``sources`` whose key stands in ``rows``, which are read twice."""
    return sources.join(broadcast_if_small(rows.select("key").distinct()), "key", "left_semi")


def rerank(hits: DataFrame, queries: DataFrame, n: int = FAST.rerank_top, scorer=lexical_score, sources: DataFrame | None = None) -> DataFrame:
    """The best ``n`` by fusion get a score from (query, text), the others keep the fusion as theirs.

    With ``sources`` (key, text, one row for each key), hits have no text of their own: only the best ``n`` get theirs while they are scored.
    """
    asked = queries.select("query_id", F.col("text").alias("_asked"))
    ranked = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("fusion").desc(), "key")))
    best = F.col("_n") <= n
    score = F.coalesce(F.when(best, scorer(F.col("_asked"), F.col("text"))), F.col("fusion"))
    if sources is None:
        return ranked.join(asked, "query_id", "left").withColumn("score_final", score).drop("_n", "_asked")
    ranked = materialize(ranked)
    head = ranked.filter(best)
    head = head.join(of_keys(sources.select("key", "text"), head), "key", "left").join(asked, "query_id", "left").withColumn("score_final", score)
    out = materialize(head.select(*ranked.columns, "score_final").unionByName(ranked.filter(~best).withColumn("score_final", F.col("fusion"))).drop("_n"))
    release(ranked)
    return out


def context(ranked: DataFrame, n: int = FAST.final_top, sources: DataFrame | None = None) -> DataFrame:
    """(query_id, num, key, url, entry): one numbered entry for a page or document, best first, with the hit's own text, or
    with url, title and text of ``sources`` (key, url, title, text, one row for each key)."""
    best = top(ranked.filter("score_final is not null").drop("rank"), "score_final", n).drop("rank")
    entries = top(one_for_page(best, "score_final"), "score_final", n).withColumnRenamed("rank", "num")
    if sources is not None:
        entries = materialize(entries)
        entries = entries.join(of_keys(sources.select("key", "url", "title", "text"), entries), "key", "left")
    nvl = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat(F.lit("["), F.col("num"), F.lit("] "), nvl("url"), F.lit("\ntitle: "), nvl("title"), F.lit("\ncontent: "), nvl("text"))
    return entries.select("query_id", "num", "key", "url", text.alias("entry"))


def full_context(ranked: DataFrame, blocks: DataFrame, documents: DataFrame, n: int = FAST.final_top) -> DataFrame:
    """R10, R11 with full sources: (query_id, num, key, url, entry). A page's entry holds all its blocks in their order, a
    file's all its text; a line with the description is there where the file, or a file with the page's URL, has one.

    Only pages and files of the best hits are read together, each once for all queries.
    """
    best = top(ranked.filter("score_final is not null").drop("rank"), "score_final", n).drop("rank")
    best = materialize(top(one_for_page(best, "score_final"), "score_final", n).withColumnRenamed("rank", "num").drop("text"))
    pages = best.filter("kind = 'block'").select("page_id").distinct()
    own = blocks.select("id", "page_id", "ord", "text").dropDuplicates(["id"]).join(broadcast_if_small(pages), "page_id", "left_semi")
    own = own.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", F.coalesce("text", F.lit("")).alias("text")))).alias("b"))
    own = own.select("page_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("_page"))
    files = documents.select(F.concat(F.lit("document:"), "id").alias("key"), F.col("extracted_text").alias("_file"), F.col("description").alias("_own"))
    whole = of_keys(files, best).dropDuplicates(["key"])
    about = documents.filter("description is not null").groupBy("url").agg(F.min("description").alias("_about"))
    out = best.join(own, "page_id", "left").join(whole, "key", "left").join(about, "url", "left")
    nvl = lambda c: F.coalesce(c, F.lit(""))
    page = F.col("kind") == "block"
    described = F.when(page, F.col("_about")).otherwise(F.col("_own"))
    line = F.when(F.trim(nvl(described)) != "", F.concat(F.lit("description: "), described, F.lit("\n"))).otherwise("")
    text = F.when(page, F.col("_page")).otherwise(F.col("_file"))
    head = F.concat(F.lit("["), F.col("num"), F.lit("] "), nvl(F.col("url")), F.lit("\ntitle: "), nvl(F.col("title")), F.lit("\n"))
    return out.select("query_id", "num", "key", "url", F.concat(head, line, F.lit("content: "), nvl(text)).alias("entry"))


def result_view(ranked: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, key, score_final, text): each scored hit with its context entry, by exact key; "not found" without one."""
    shown = entries.select("query_id", "key", "entry")
    out = ranked.filter("score_final is not null").join(shown, ["query_id", "key"], "left")
    return out.select("query_id", "key", "score_final", F.coalesce("entry", F.lit("not found")).alias("text"))


def feedback(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are stored, rows that are refused): a rating is a number from 1 to 5, or a thumb up (5) or down (1)."""
    thumb = F.lower(F.trim(F.col("rating").cast("string")))
    rating = F.when(thumb == "up", 5).when(thumb == "down", 1).otherwise(F.expr("try_cast(rating as int)"))
    rated = rows.withColumn("_r", rating)
    good = F.coalesce(F.col("_r").between(1, 5), F.lit(False))
    return rated.filter(good).withColumn("rating", F.col("_r")).drop("_r"), rated.filter(~good).drop("_r")


def prompts(entries: DataFrame, queries: DataFrame, template: str = "Context\n{context}\n\nQuestion\n{question}\n") -> DataFrame:
    """(query_id, prompt); the entries in order, with a blank line between."""
    joined = entries.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("num", "entry"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n")
    out = queries.join(joined, "query_id").select("query_id", F.col("text").alias("q"), text.alias("c"))
    head, mid, tail = template.partition("{context}")[0], template.partition("{context}")[2].partition("{question}")[0], template.partition("{question}")[2]
    return out.select("query_id", F.concat(F.lit(head), "c", F.lit(mid), "q", F.lit(tail)).alias("prompt"))


def citations(answers: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, place, num, key): the [n] marks of each answer, with the entry where there is one."""
    marks = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,9})\]"), 1)).alias("place", "n"))
    marks = marks.select("query_id", "place", F.col("n").cast("int").alias("num"))
    return marks.join(entries.select("query_id", "num", "key"), ["query_id", "num"], "left").select("query_id", "place", "num", "key")


def hashed_embeddings(texts: DataFrame, dims: int = 64) -> DataFrame:
    """R15 offline: (key, values): signed feature hashing of each text's words by their MD5, scaled to length one; all zeros for a text
    without words. Words are summed by slot before anything is gathered, so a long text costs ``dims`` values."""
    words = texts.select("key", F.explode(tokens(F.col("text"))).alias("w"))
    words = words.select("key", F.md5("w").alias("h"))
    number = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")
    sign = F.when(number(9) % 2 == 0, 1).otherwise(-1)
    slots = words.groupBy("key", (number(1) % dims).cast("int").alias("slot")).agg(F.sum(sign).alias("v"))
    packed = slots.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    value = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm")).otherwise(F.lit(0.0))
    )
    out = texts.select("key").join(packed.select("key", value.alias("values")), "key", "left")
    return out.select("key", F.coalesce("values", F.array_repeat(F.lit(0.0), dims)).alias("values"))


def extractive_answer(entries: DataFrame) -> DataFrame:
    """R12 offline: the best entry's text with its mark."""
    return entries.filter("num = 1").select("query_id", F.concat(F.regexp_extract("entry", r"(?s)content: (.*)$", 1), F.lit(" [1]")).alias("answer"))


def query_guard(text: Column, vector: Column, hits: Column) -> Column:
    """Why a query can't be answered; null where it can. Nothing is raised for a row."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "query is blank")
        .when(F.coalesce(F.size(vector), F.lit(0)) <= 0, "query vector is missing")
        .when(F.coalesce(hits, F.lit(0)) == 0, "no sources found")
    )
