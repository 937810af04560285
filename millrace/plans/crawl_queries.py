"""Queries of the crawl frontier, rendering, HTML parsing, event streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import frontier as K
from ..operators import rendering as S
from ..operators import retrieval as R
from ..registry import query
from ..runtime import table
from ..sources.dom import parse_pages
from ..streaming import crawl as T
from .url_queries import ALLOWED, HOST, SCORE


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links between stored pages: every link leads to a page of the same site by number, so that waves have a graph."""
    pages = table(spark, sf, "pages").select("id", "url").dropDuplicates(["id"])
    links = table(spark, sf, "page_links").dropDuplicates(["id"]).join(pages.withColumnRenamed("id", "page_id"), "page_id")
    internal = U.classify_link(F.col("href"), U.host(F.col("url"))) == "internal"
    return links.select(F.col("url").alias("source_url"), "href", "anchor_text", internal.alias("internal"))


def page_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Page i links to pages 2i + 1 and 2i + 2 in the order of URLs, beside its own links."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("https://site.example/docs/"), "doc_id").alias("source_url"))
    child = F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1, F.col("doc_id") % 7 + 1))
    docs = docs.select("source_url", child.alias("child"))
    return docs.select("source_url", F.concat(F.lit("https://site.example/docs/"), "child").alias("href"), F.lit("read on").alias("anchor_text"), F.lit(True).alias("internal"))


@query(
    "frontier_bfs_waves",
    """with recursive e as (select doc_id as a, unnest([doc_id * 2, doc_id * 2 + 1, doc_id % 7 + 1]) as b from documents),
        w(n, depth) as (select 1, 0 union select e.b, w.depth + 1 from w join e on e.a = w.n where w.depth < 6)
        select 'https://site.example/docs/' || n as url, cast(min(depth) as int) as depth from w group by n""",
)
def frontier_bfs_waves(spark: SparkSession, sf: str) -> DataFrame:
    start = spark.createDataFrame([("https://site.example/docs/1", 0)], "url string, depth int")
    return K.crawl_waves(start, page_graph(spark, sf), 6)


@query("frontier_page_waves")
def frontier_page_waves(spark: SparkSession, sf: str) -> DataFrame:
    """Waves from every site's least page URL over the stored pages' own links, to depth 6."""
    pages = table(spark, sf, "pages").filter("source_id is not null and url is not null")
    start = pages.groupBy("source_id").agg(F.min("url").alias("url")).select("url", F.lit(0).alias("depth")).distinct()
    return K.crawl_waves(start, edges(spark, sf), 6)


@query(
    "frontier_best_first",
    f"""with l as (select distinct l.id, l.href, l.anchor_text, p.url from page_links l join (select distinct id, url from pages) p on p.id = l.page_id),
        i as (select href as url, anchor_text from l where ({HOST('href')} = '' or {HOST('href')} = {HOST('url')} or ends_with({HOST('href')}, '.' || {HOST('url')}))),
        f as ({ALLOWED.format(urls="select distinct url from i")}),
        s as ({SCORE.format(links="select url as href, anchor_text from i where url in (select url from f where allowed)")})
        select href as url, cast(1 as int) as depth, max(score) as score from s group by 1 order by score desc, url limit 100""",
)
def frontier_best_first(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred best candidates; a top-k by design."""
    pages = table(spark, sf, "pages").select("url").distinct().withColumn("depth", F.lit(0))
    return K.best_first(K.link_candidates(pages, edges(spark, sf)), 100)


@query(
    "frontier_unseen",
    f"""select distinct href as url from page_links l where not exists (select 1 from pages p where p.url = l.href)
        and {HOST('href')} <> ''""",
)
def frontier_unseen(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "page_links").select(F.col("href").alias("url")).filter(U.host(F.col("url")) != "")
    return K.unseen(links, table(spark, sf, "pages"))


def event_status() -> Column:
    """A crawl status for each kind of event."""
    kind = F.col("event_type")
    return F.when(kind == "view", "queued").when(kind == "click", "rendering").when(kind == "signup", "parsed").when(kind == "purchase", "batched").otherwise("failed")


@query(
    "crawl_stats",
    """with s as (select user_id, case event_type when 'view' then 'queued' when 'click' then 'rendering' when 'signup' then 'parsed' when 'purchase' then 'batched' else 'failed' end as status from events),
        c as (select user_id, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'rendering') as rendering, count(*) filter (status = 'parsed') as parsed,
            count(*) filter (status = 'batched') as batched, count(*) filter (status = 'failed') as failed from s group by 1)
        select *, queued + rendering + parsed = 0 as done, case when queued + rendering + parsed > 0 then 'RUNNING' when batched = 0 then 'FAILED' else 'COMPLETED' end as state,
            case when queued + rendering + parsed = 0 then case when batched = 0 then 'INTERNAL_ERROR' else 'FRONTIER_EMPTY' end end as reason from c""",
)
def crawl_stats(spark: SparkSession, sf: str) -> DataFrame:
    """K18, K19, T04 over all events."""
    return K.crawl_stats(table(spark, sf, "events").withColumn("status", event_status()), "user_id", "status")


@query(
    "render_error_class",
    """with m as (select distinct scrape_id, lower(coalesce(title, '')) as m from scrapped_pages)
        select scrape_id, case when contains(m, 'timeout') then 'TIMEOUT' when contains(m, 'name_not_resolved') or contains(m, 'connection_refused') or contains(m, 'connection refused') then 'NETWORK_ERROR'
            when contains(m, 'aborted') and contains(m, '404') then 'PAGE_NOT_FOUND' when contains(m, '403') or contains(m, '401') then 'ACCESS_DENIED'
            when contains(m, 'invalid url') then 'INVALID_URL' else 'NETWORK_ERROR' end as code from m""",
)
def render_error_class(spark: SparkSession, sf: str) -> DataFrame:
    """S02 over the titles of all scrapes, failed fetches among them."""
    rows = table(spark, sf, "scrapped_pages").dropDuplicates(["scrape_id"])
    return rows.select("scrape_id", S.error_code(F.col("title"), F.lit(False)).alias("code"))


@query(
    "render_final_attempts",
    """with a as (select 'u' || user_id as url, row_number() over (partition by user_id order by ts, event_id) as attempt, event_type from events),
        c as (select url, attempt, case event_type when 'error' then 'TIMEOUT' when 'click' then 'NETWORK_ERROR' when 'view' then 'PAGE_NOT_FOUND' end as code from a),
        s as (select *, code is null or code = 'PAGE_NOT_FOUND' or attempt >= 4 or attempt = max(attempt) over (partition by url) as stop from c)
        select url, min(attempt) as attempt, arg_min(coalesce(code, 'OK'), attempt) as code from s where stop group by 1""",
)
def render_final_attempts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    code = F.when(F.col("event_type") == "error", "TIMEOUT").when(F.col("event_type") == "click", "NETWORK_ERROR").when(F.col("event_type") == "view", "PAGE_NOT_FOUND")
    rows = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), number.cast("long").alias("attempt"), code.alias("code"))
    return S.final_attempts(rows).select("url", "attempt", F.coalesce("code", F.lit("OK")).alias("code"))


def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pages as HTML, with furniture around that pruning has to take away."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    b = table(spark, sf, "page_blocks").dropDuplicates(["id"])
    tag = F.when(F.lower("type") == "heading", F.concat(F.lit("h"), F.coalesce("heading_level", F.lit(2)))).otherwise("p")
    item = F.concat(F.lit("<"), tag, F.lit(">"), esc(F.coalesce("text", F.lit(""))), F.when(tag == "p", "").otherwise(F.concat(F.lit("</"), tag, F.lit(">"))))
    body = b.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("h")))).alias("x"))
    pages = table(spark, sf, "pages").dropDuplicates(["id"]).join(body, F.col("id") == F.col("page_id"))
    html = F.concat(
        F.lit('<html lang="xx"><head><title> '), esc(F.coalesce("title", F.lit(""))), F.lit('</title><script>var a = "</p>";</script></head><body><nav><ul><li><a href="/a?b=2&amp;a=1&amp;utm_x=1#f">Menu entry here</a></ul></nav><article>'),
        F.array_join(F.transform("x", lambda s: s["h"]), "\n"), F.lit('</article><div class="promo">Buy these things now</div><footer>All the rest</footer></body></html>'),
    )
    return pages.select(F.col("id").alias("page_id"), "url", html.alias("html"))


@query(
    "dom_blocks",
    r"""with b as (select distinct id, page_id, ord, type, regexp_replace(text, '^[\s\x0B\x{85}\p{Z}\x1c-\x1f]+|[\s\x0B\x{85}\p{Z}\x1c-\x1f]+$', '', 'g') as text from page_blocks)
        select page_id, cast(row_number() over (partition by page_id order by ord) - 1 as int) as idx, case when lower(type) = 'heading' then 'heading' else 'paragraph' end as type, text
        from b where text <> '' and page_id in (select id from pages)""",
)
def dom_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered pages back to their blocks: what comes out must be what was stored, without the furniture."""
    parsed = parse_pages(html_pages(spark, sf)).select("page_id", F.explode("page.blocks").alias("b"))
    return parsed.select("page_id", "b.idx", "b.type", "b.text")


@query(
    "page_metadata",
    r"""select id as page_id, coalesce(nullif(regexp_replace(any_value(title), '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g'), ''), 'Untitled') as title, 'xx' as language,
            regexp_extract(any_value(url), '^([a-zA-Z]+://[^/?#]+)', 1) || '/a?a=1&b=2' as link
        from pages where id in (select page_id from page_blocks) group by id""",
)
def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_pages(html_pages(spark, sf))
    return parsed.select("page_id", "page.title", "page.language", F.col("page.links")[0]["href"].alias("link"))


def task_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("task"), "ts", F.col("event_id").alias("id"))


@query(
    "micro_batches",
    """with recursive e as (select cast(user_id % 20 as varchar) as task, ts, row_number() over (partition by user_id % 20 order by ts, event_id) as i from events),
        b(task, i, seq, first, size) as (
            select task, 1::bigint, 1, ts, 1 from e where i = 1
            union all
            select e.task, e.i, case when b.size >= 20 or e.ts - b.first >= interval 60 second then b.seq + 1 else b.seq end,
                case when b.size >= 20 or e.ts - b.first >= interval 60 second then e.ts else b.first end,
                case when b.size >= 20 or e.ts - b.first >= interval 60 second then 1 else b.size + 1 end
            from b join e on e.task = b.task and e.i = b.i + 1)
        select b.task, cast(seq as int) as seq, cast(max(size) as int) as size, min(e.ts) as first, max(e.ts) as last from b join e on e.task = b.task and e.i = b.i group by 1, 2""",
)
def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    return T.micro_batches(task_pages(spark, sf))


@query(
    "inflight_ttl",
    """select v.user_id || '-' || v.event_id as key, v.ts as sent_ts from events v where v.event_type = 'view' and not exists (
        select 1 from events p where p.event_type = 'purchase' and p.user_id = v.user_id and p.ts >= v.ts and p.ts <= v.ts + interval 5 minute)""",
)
def inflight_ttl(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    sent = events.filter("event_type = 'view'").select(F.struct("user_id", "event_id").alias("full"), F.col("user_id").alias("key"), "ts")
    results = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts")
    late = T.expired(sent.select("key", "ts"), results)
    back = sent.select("full", "key", F.col("ts").alias("sent_ts"))
    return back.join(late, ["key", "sent_ts"], "left_semi").select(F.concat_ws("-", "full.user_id", "full.event_id").alias("key"), "sent_ts")


@query(
    "rate_limit",
    """select event_id, recent, recent > 2 as refused from (select event_id,
        count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as recent from events)""",
)
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return T.over_limit(table(spark, sf, "events"), 2, 3600).select("event_id", "recent", "refused")


@query(
    "active_query_guard",
    "select event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) < 3600000000, false) as refused from events where event_type = 'click'",
)
def active_query_guard(spark: SparkSession, sf: str) -> DataFrame:
    return T.active_queries(table(spark, sf, "events").filter("event_type = 'click'"), 60).select("event_id", "refused")


@query("user_last_seen", "select user_id, min(ts) as first_seen, max(ts) as last_seen, arg_min(event_type, (ts, event_id)) as first_event from events group by 1")
def user_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    return T.users(table(spark, sf, "events"))


@query(
    "session_ttl",
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 100 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
        s as (select *, sum(new) over (partition by user_id order by ts range between unbounded preceding and current row) as n from g)
        select user_id, min(ts) as start, max(ts) as last_write, count(*) as writes from s group by user_id, n""",
)
def session_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return T.sliding_sessions(table(spark, sf, "events"))


@query("feedback_summary", "select event_type, count(*) as n, avg(1 + event_id % 7) as rating from events where 1 + event_id % 7 between 1 and 5 group by 1")
def feedback_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Refused ratings are left out of the report."""
    rows = R.feedback(table(spark, sf, "events").withColumn("rating", 1 + F.col("event_id") % 7))[0]
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("rating").alias("rating"))
