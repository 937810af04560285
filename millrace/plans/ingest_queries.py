"""Queries of ingestion, delta sync and index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import ingest as I
from ..registry import query
from ..runtime import table

BLOCKS = "(select distinct id, page_id, ord, html_id, type, heading_level, text from page_blocks)"


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "page_blocks").dropDuplicates(["id"])
    return b.select("page_id", F.col("ord").alias("idx"), "type", "html_id", "heading_level", "text")


@query(
    "chunks",
    rf"""with recursive b as (select page_id, ord as idx, text from {BLOCKS}),
        t as (select *, count(*) over w > 1 and max(cast(regexp_matches(text, '[^\s\x0B\x{{85}}\p{{Z}}]') and not length(text) between 100 and 1000 as int)) over w = 1 as touch
              from b window w as (partition by page_id)),
        c(page_id, idx, part, start, stop, text) as (
            select page_id, idx, 0, 0, 0, text from t where touch and length(text) > 1000
            union all
            select page_id, idx, part + 1, stop, case
                when stop + 1000 >= length(text) then length(text)
                when strpos(reverse(substring(text, stop + 1, 1001)), ' .') between 1 and 999
                    then stop + 1001 - strpos(reverse(substring(text, stop + 1, 1001)), ' .') + 1
                else stop + 1000 end, text
            from c where stop < length(text)),
        p as (select page_id, idx, part, substring(text, start + 1, stop - start) as text, true as touch from c where part > 0
              union all select page_id, idx, 1, text, touch from t where not (touch and length(text) > 1000)),
        g as (select *, sum(cast(first or not touch or length(text) >= 100 as int)) over (partition by page_id order by idx, part) as g
              from (select *, row_number() over (partition by page_id order by idx, part) = 1 as first from p))
        select page_id, cast(g - 1 as int) as idx, string_agg(text, ' ' order by idx, part) as text from g group by 1, 2""",
)
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge_short_chunks(I.split_chunks(page_blocks(spark, sf).filter("text is not null"))).select("page_id", "idx", "text")


@query(
    "delta_changed_pages",
    """with s as (select distinct id, url, title, description, content_hash from pages),
        n as (select url, max(title) as title from (select url, title from s union all select url, title || ' (new)' from s where content_hash like '%7') group by 1)
        select n.url, n.title from n join (select url, max(title) as title from s group by 1) o on o.url = n.url where n.title <> o.title""",
)
def delta_changed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages against a copy of which some titles changed: only those come out."""
    pages = table(spark, sf, "pages").dropDuplicates(["id"])
    new = pages.select("url", "title").union(pages.filter("content_hash like '%7'").select("url", F.concat("title", F.lit(" (new)"))))
    stored, new = (d.groupBy("url").agg(F.max("title").alias("title")).withColumn("hash", I.content_hash("title")) for d in (pages, new))
    return I.changed_pages(new, stored).filter("title is not null").select("url", "title")


@query(
    "delta_children",
    f"""with e as (select page_id, text from {BLOCKS}),
        c as (select page_id, case when ord % 7 = 3 then text || '!' else text end as text from {BLOCKS} where ord % 11 <> 5),
        x as (select *, row_number() over (partition by page_id, text) as n from e), y as (select *, row_number() over (partition by page_id, text) as n from c)
        select coalesce(x.page_id, y.page_id) as page_id, coalesce(x.text, y.text) as text,
            case when x.n is null then 'insert' when y.n is null then 'delete' else 'keep' end as action
        from x full outer join y on x.page_id = y.page_id and x.text is not distinct from y.text and x.n = y.n""",
)
def delta_children(spark: SparkSession, sf: str) -> DataFrame:
    blocks = page_blocks(spark, sf)
    text = F.when(F.col("idx") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return I.child_diff(blocks, blocks.filter("idx % 11 <> 5").withColumn("text", text), "page_id", ["text"])


@query(
    "index_upsert",
    """with r as (select scrape_id, lower(url) as url, title, scraped_at from scrapped_pages)
        select url, scrape_id, title from (select *, row_number() over (partition by url order by scraped_at desc nulls last, scrape_id) as n from
            (select distinct url, scrape_id, title, scraped_at from r)) where n = 1""",
)
def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated scrapes, the last one of each URL; half of them are stored already, the others come in."""
    rows = table(spark, sf, "scrapped_pages").dropDuplicates(["scrape_id"]).select(F.lower("url").alias("url"), "scrape_id", "title", "scraped_at")
    version = F.struct("scraped_at", F.translate("scrape_id", "0123456789abcdef", "fedcba9876543210"))
    rows = rows.withColumn("version", version)
    stored = F.right("scrape_id", F.lit(1)) < "8"
    return I.upsert(rows.filter(stored), rows.filter(~stored), "url", "version").select("url", "scrape_id", "title")


@query(
    "auto_sync_due",
    """select id, source_url from (select distinct * from sources)
        where enabled and (last_synced_at is null or last_synced_at + to_minutes(interval_minutes) < timestamptz '2025-08-01 00:00:00+00')""",
)
def auto_sync_due(spark: SparkSession, sf: str) -> DataFrame:
    return I.due_sources(table(spark, sf, "sources").distinct(), F.lit("2025-08-01 00:00:00").cast("timestamp")).select("id", "source_url")


@query(
    "index_text_projection",
    f"""select 'block:' || id as key, text from (select distinct id, text from page_blocks)
        union all select 'document:' || id, extracted_text from (select distinct id, extracted_text from page_documents)
        where regexp_matches(extracted_text, '[^{WS[1:]}')""",
)
def index_text_projection(spark: SparkSession, sf: str) -> DataFrame:
    return I.index_texts(table(spark, sf, "page_blocks").dropDuplicates(["id"]), table(spark, sf, "page_documents").dropDuplicates(["id"]))


@query(
    "index_stale_cleanup",
    """with p as (select distinct id from pages where language is not null),
        v as (select 'block:' || id as key from page_blocks where page_id in (select id from p) union select 'document:' || id from page_documents where page_id in (select id from p)),
        i as (select 'block:' || id as key from page_blocks union select 'document:' || id from page_documents)
        select key, key not in (select key from v) as stale from i""",
)
def index_stale_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    blocks, files = table(spark, sf, "page_blocks"), table(spark, sf, "page_documents")
    index = blocks.select(F.concat(F.lit("block:"), "id").alias("key")).union(files.select(F.concat(F.lit("document:"), "id"))).distinct()
    keys = I.valid_keys(table(spark, sf, "pages").filter("language is not null"), blocks, files)
    return I.live_rows(index, keys).withColumn("stale", F.lit(False)).union(I.stale_rows(index, keys).withColumn("stale", F.lit(True)))


@query(
    "cascade_delete",
    """with s as (select id from sources where not enabled), p as (select distinct id from pages where source_id not in (select id from s))
        select 'page' as kind, id from p union all select distinct 'block', id from page_blocks where page_id in (select id from p)""",
)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "sources").filter("not enabled").select(F.col("id").alias("source_id"))
    pages, blocks = I.cascade_delete(gone, table(spark, sf, "pages").dropDuplicates(["id"]), table(spark, sf, "page_blocks").dropDuplicates(["id"]))
    return pages.select(F.lit("page").alias("kind"), "id").union(blocks.select(F.lit("block"), "id"))
