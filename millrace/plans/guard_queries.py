"""Queries of responses, guards and link keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import rendering as S
from ..operators import retrieval as R
from ..registry import query
from ..runtime import table
from .url_queries import HOST


@query(
    "scrape_responses",
    """with r as (select distinct scrape_id, task_id, url, title, description from scrapped_pages),
        c as (select *, case when description is null and scrape_id < '4' then coalesce(nullif(substring(scrape_id, 1, 1), '0'), 'NETWORK_ERROR') when trim(coalesce(title, '')) = '' then 'PARSE_ERROR' end as code from r)
        select scrape_id, task_id, url, code is null as success, case when code is null then title end as html, code from c""",
)
def scrape_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Scrapes as render results: the title stands for the HTML, some without a description for failures."""
    rows = table(spark, sf, "scrapped_pages").dropDuplicates(["scrape_id"])
    failed = F.col("description").isNull() & (F.col("scrape_id") < "4")
    renders = rows.select("task_id", "url", (~failed).alias("success"), F.col("title").alias("html"), F.nullif(F.substring("scrape_id", 1, 1), F.lit("0")).alias("code"), F.create_map(F.lit("id"), "scrape_id").alias("metadata"))
    return S.scrape_responses(renders).select(F.col("metadata")["id"].alias("scrape_id"), "task_id", "url", "success", "html", "code")


@query(
    "query_guards",
    """select doc_id, case when trim(coalesce(title, '')) = '' then 'query is blank' when e.vec_id is null then 'query vector is missing'
            when coalesce(n_chars, 0) = 0 then 'no sources found' end as error
        from documents d left join embeddings e on e.vec_id = d.doc_id""",
)
def query_guards(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf, "documents").join(vectors, "doc_id", "left")
    return docs.select("doc_id", R.query_guard(F.col("title"), F.col("embedding"), F.col("n_chars")).alias("error"))


@query(
    "links_plain",
    f"""select distinct l.page_id, regexp_replace(l.href, '#.*$', '') as href, {HOST('l.href')} = {HOST('p.url')} as internal
        from page_links l join (select distinct id, url from pages) p on p.id = l.page_id where regexp_matches(lower(l.href), '^https?://')""",
)
def links_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Web links, each URL once for a page, internal on the very same host."""
    pages = table(spark, sf, "pages").select(F.col("id").alias("page_id"), "url").dropDuplicates(["page_id"])
    links = table(spark, sf, "page_links").withColumn("key", U.followed_once(F.col("href"))).filter("key is not null").join(pages, "page_id")
    return links.select("page_id", F.col("key").alias("href"), (U.host(F.col("href")) == U.host(F.col("url"))).alias("internal")).distinct()
