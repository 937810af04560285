"""Queries of task events, upserts, routing, page structures and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import urls as U
from ..operators import frontier as K
from ..operators import ingest as I
from ..operators import rendering as S
from ..operators import retrieval as R
from ..registry import query
from ..runtime import table
from ..sources.dom import parse_pages
from ..streaming import crawl as T
from .url_queries import EXT, HOST, ITEMS, PAGES, map_sql

STORE_URL = f"""case when {HOST('u')} <> '' then (case when regexp_extract(u, '{U.PARTS}', 1) = '' then 'https' else lower(regexp_extract(u, '{U.PARTS}', 1)) end) || '://' || {HOST('u')}
    || regexp_extract(u, '{U.PARTS}', 3) || array_to_string(list_reduce(list_transform(string_split(lower(regexp_extract(u, '{U.PARTS}', 4)), '/'), lambda x: [x]),
       lambda a, b: case when b[1] = '..' then a[1:greatest(len(a) - 1, 1)] when b[1] = '.' then a else list_concat(a, b) end), '/') end"""


@query(
    "delta_bad_urls",
    f"""with x as (select 'page' as kind, id, url as u from {PAGES} union all select 'link', id, case when id < '8' then href else 'nowhere/' || href end from (select distinct id, href from page_links)
                   union all select 'document', id, url from (select distinct id, url from page_documents))
        select kind, id, {STORE_URL} as url from x where {HOST('u')} <> ''""",
)
def delta_bad_urls(spark: SparkSession, sf: str) -> DataFrame:
    """D05 over pages, links and files; half of the links are made unusable."""
    links = table(spark, sf, "page_links").dropDuplicates(["id"])
    links = links.withColumn("url", F.when(F.col("id") < "8", F.col("href")).otherwise(F.concat(F.lit("nowhere/"), "href")))
    kinds = (("page", table(spark, sf, "pages").dropDuplicates(["id"])), ("link", links), ("document", table(spark, sf, "page_documents").dropDuplicates(["id"])))
    parts = [I.drop_bad_urls(d.select("id", "url"), "url").select(F.lit(k).alias("kind"), "id", "url") for k, d in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "delta_update_fields",
    """select distinct id, url, case when language is null then 'Seen: ' || coalesce(title, '') else title end as title, coalesce(language, 'und') as language from pages
       union all select 'new-' || id, null, 'Seen: ' || title, 'und' from (select distinct id, title from pages) where id < '1'""",
)
def delta_update_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and languages of pages without a label are updated, some pages are new."""
    pages = table(spark, sf, "pages").dropDuplicates(["id"]).select("id", "url", "title", "language")
    seen = F.concat(F.lit("Seen: "), F.coalesce("title", F.lit(""))).alias("title")
    changed = pages.filter("language is null").select("id", seen, F.lit("und").alias("language"))
    new = pages.filter("id < '1'").select(F.concat(F.lit("new-"), "id").alias("id"), F.concat(F.lit("Seen: "), "title").alias("title"), F.lit("und").alias("language"))
    return I.update_fields(pages, changed.unionByName(new), "id", ["title", "language"])


@query(
    "source_upsert",
    f"""with s as (select distinct id, source_url, enabled from sources),
        n as (select case when id < '6' then id end as id, case when id > 'c' then 'HTTPS://New.' || regexp_extract(source_url, '{U.PARTS}', 2) || '/A' else source_url end as u, not enabled as enabled from s
              union all select 'nobody', 'https://nobody.example/', true),
        m as (select coalesce(n.id, s.id) as id, u, n.enabled, case when n.id is not null and i.id is null then 'unknown' when n.id is null and s.id is null then 'insert' else 'update' end as action
              from n left join s i on i.id = n.id left join s on n.id is null and s.source_url = n.u)
        select id, {STORE_URL} as source_url, enabled, action from m""",
)
def source_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Some sources come by id, some by their URL, some are new, one has an id nobody has."""
    stored = table(spark, sf, "sources").distinct().select("id", "source_url", "enabled")
    moved = F.concat(F.lit("HTTPS://New."), U.part(F.col("source_url"), 2), F.lit("/A"))
    come = stored.select(
        F.when(F.col("id") < "6", F.col("id")).alias("id"), F.when(F.col("id") > "c", moved).otherwise(F.col("source_url")).alias("source_url"), (~F.col("enabled")).alias("enabled")
    )
    odd = spark.createDataFrame([("nobody", "https://nobody.example/", True)], come.schema)
    return I.upsert_sources(stored, come.unionByName(odd), ["enabled"])


KIND = "case event_type when 'view' then 'PAGE_BATCH' when 'purchase' then 'TASK_COMPLETED' when 'error' then 'TASK_FAILED' else 'PING' end"


def task_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    kind = F.when(kind == "view", "PAGE_BATCH").when(kind == "purchase", "TASK_COMPLETED").when(kind == "error", "TASK_FAILED").otherwise("PING")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("task_id"), kind.alias("type"), "ts")


@query(
    "event_dispatch",
    f"""with e as (select event_id, user_id, {KIND} as type from events)
        select event_id, type in ('TASK_COMPLETED', 'PAGE_BATCH') as stores_pages,
            case type when 'TASK_COMPLETED' then 'COMPLETED' when 'TASK_FAILED' then 'FAILED' when 'PAGE_BATCH' then 'RUNNING' else 'IGNORED' end as leads_to
        from e where user_id % 3 <> 0""",
)
def event_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the tasks isn't running."""
    events = task_events(spark, sf)
    tasks = events.select("task_id").distinct().withColumn("status", F.when(F.col("task_id") % 3 == 0, "COMPLETED").otherwise("RUNNING"))
    return I.dispatch_events(events, tasks).select("event_id", "stores_pages", "leads_to")


@query(
    "task_states",
    f"""with e as (select user_id as task_id, {KIND} as type, ts from events),
        f as (select task_id, type, ts, row_number() over (partition by task_id order by ts, type) as n from e where type in ('TASK_COMPLETED', 'TASK_FAILED'))
        select t.task_id, case when f.type is null then 'RUNNING' when f.type = 'TASK_COMPLETED' then 'COMPLETED' else 'FAILED' end as status, f.ts as finished_at
        from (select distinct task_id from e) t left join f on f.task_id = t.task_id and f.n = 1""",
)
def task_states(spark: SparkSession, sf: str) -> DataFrame:
    return I.task_states(task_events(spark, sf))


@query(
    "event_order",
    f"""with e as (select user_id % 200 as task, case when event_type = 'purchase' then 'TASK_COMPLETED' else 'PAGE_BATCH' end as type, ts, event_id from events),
        s as (select *, row_number() over (partition by task, type order by ts, event_id) + case when task % 5 = 0 then 1 else 0 end as seq from e),
        g as (select task, count(*) as events, count(*) filter (type <> 'PAGE_BATCH') as ends, count(*) filter (type = 'PAGE_BATCH') as n, min(seq) filter (type = 'PAGE_BATCH') as lo,
                     max(ts) filter (type = 'PAGE_BATCH') as last, min(ts) filter (type <> 'PAGE_BATCH') as stop from s group by 1)
        select task, events, ends, (n = 0 or lo = 1) and ends = 1 and (last is null or last <= stop) as in_order from g""",
)
def event_order(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a fifth of the tasks are numbered from 2."""
    kind = F.when(F.col("event_type") == "purchase", "TASK_COMPLETED").otherwise("PAGE_BATCH")
    rows = table(spark, sf, "events").select((F.col("user_id") % 200).alias("task"), kind.alias("type"), "ts", "event_id")
    number = F.row_number().over(Window.partitionBy("task", "type").orderBy("ts", "event_id"))
    return T.event_order(rows.withColumn("seq", number + F.when(F.col("task") % 5 == 0, 1).otherwise(0)))


@query(
    "crawl_event_modes",
    """select cast(user_id % 20 as varchar) as task, 'TASK_COMPLETED' as type, cast(null as int) as seq, cast(count(*) as int) as pages from events group by 1""",
)
def crawl_event_modes(spark: SparkSession, sf: str) -> DataFrame:
    """T07 without batches: the completion carries all pages."""
    pages = table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("task"), "ts", F.col("event_id").alias("id"))
    return T.crawl_events(pages, batched=False)


@query(
    "drain_parsed",
    """with p as (select user_id % 50 as task, 'u' || event_id as url, case event_type when 'click' then 'parsed' else 'rendering' end as status from events)
        select task, url, status, status = 'parsed' and row_number() over (partition by task, status order by url) <= 30 as drained from p""",
)
def drain_parsed(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "parsed").otherwise("rendering")
    rows = table(spark, sf, "events").select((F.col("user_id") % 50).alias("task"), F.concat(F.lit("u"), "event_id").alias("url"), status.alias("status"))
    out, rest = T.drain_parsed(rows, 30)
    return out.withColumn("drained", F.lit(True)).unionByName(rest.withColumn("drained", F.lit(False)))


@query(
    "frontier_limits",
    """with c as (select distinct id, page_id, href as url, position % 5 as depth, case when type = 'external' then 'pdf' end as hint from page_links),
        t as (select substring(page_id, 1, 1) as task, url, depth, hint, id as place from c),
        n as (select *, sum(cast(hint is null and depth <= 3 as int)) over (partition by task order by place, url) as n from t)
        select task, url, depth, hint, place from n where hint is not null or (depth <= 3 and n <= 20)""",
)
def frontier_limits(spark: SparkSession, sf: str) -> DataFrame:
    """External links stand for attached files, which are exempt."""
    links = table(spark, sf, "page_links").dropDuplicates(["id"])
    hint = F.when(F.col("type") == "external", "pdf")
    rows = links.select(F.substring("page_id", 1, 1).alias("task"), F.col("href").alias("url"), (F.col("position") % 5).alias("depth"), hint.alias("hint"), F.col("id").alias("place"))
    return K.within_limits(rows, 20, 3)


@query("frontier_patterns", "select distinct url from pages where regexp_matches(url, '/[a-m][^/]*') and not regexp_matches(url, '[?#]')")
def frontier_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """K20."""
    return table(spark, sf, "pages").select("url").distinct().filter(K.wanted(F.col("url"), ("/[a-m][^/]*",), (r"\?", "#")))


@query(
    "crawl_page_map",
    """select scrape_id, url, nullif(source_page_url, '') as source_page_url, cast(coalesce(len(blocks), -1) as int) as blocks, cast(coalesce(len(links), -1) as int) as links,
              cast(coalesce(len(documents), -1) as int) as documents, blocks[1].text as first_text, links[1].href as first_link, documents[1].url as first_file from scrapped_pages""",
)
def crawl_page_map(spark: SparkSession, sf: str) -> DataFrame:
    """K17 over all scrapes."""
    rows = table(spark, sf, "scrapped_pages")
    kept = rows.withColumn("description", F.col("scrape_id"))  # the id, in a field that passes through
    mapped = K.crawled_page(kept, F.col("source_page_url"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(-1)).alias(c)
    first = [F.get(c, F.lit(0))[f].alias(n) for c, f, n in (("blocks", "text", "first_text"), ("links", "href", "first_link"), ("documents", "url", "first_file"))]
    return mapped.select(F.col("description").alias("scrape_id"), "url", "source_page_url", size("blocks"), size("links"), size("documents"), *first)


@query(
    "document_routes",
    """with d as (select distinct id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) as hint from page_documents)
        select id, case when hint = 'pdf' then 'pdf' when hint in ('doc', 'docx') then 'docx' when hint in ('xls', 'xlsx') then 'xlsx' end as renderer,
            case when hint not in ('', 'html') then 'document' else 'html' end as parser from d""",
)
def document_routes(spark: SparkSession, sf: str) -> DataFrame:
    """S07, S08."""
    files = table(spark, sf, "page_documents").dropDuplicates(["id"])
    hint = F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)
    return files.select("id", S.document_kind(hint).alias("renderer"), S.parser_for(hint).alias("parser"))


@query(
    "http_classes",
    """select event_id, case s when 404 then 'PAGE_NOT_FOUND' when 401 then 'ACCESS_DENIED' when 403 then 'ACCESS_DENIED' when 500 then 'NETWORK_ERROR' when 429 then 'NETWORK_ERROR' end as code
       from (select event_id, [200, 404, 401, 403, 500, 301, 429][event_id % 7 + 1] as s from events)""",
)
def http_classes(spark: SparkSession, sf: str) -> DataFrame:
    """S01's status classes."""
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 404, 401, 403, 500, 301, 429)]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", S.http_code(status).alias("code"))


@query(
    "noise_quality",
    rf"""with b as (select distinct id, page_id, ord, lower(coalesce(text, '')) as t from page_blocks),
        w as (select *, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') as w from b)
        select id, case when len(w) > 0 then len(list_filter(w, lambda x: x in ({", ".join(f"'{x}'" for x in X.NOISE_TOKENS)}))) / len(w) end as share,
            {" + ".join(f"cast(contains(t, '{p}') as int)" for p in X.NOISE_PHRASES)} as phrases from w""",
)
def noise_quality(spark: SparkSession, sf: str) -> DataFrame:
    """F07 over every block."""
    blocks = table(spark, sf, "page_blocks").dropDuplicates(["id"])
    return blocks.select("id", X.noise_share(R.tokens(X.normalize_query(F.col("text")))).alias("share"), X.noise_phrases(F.col("text")).alias("phrases"))


@query(
    "feedback_insert",
    """with r as (select event_id, case when event_id % 11 = 0 then 'up' when event_id % 13 = 0 then ' Down' else cast(event_id % 8 as varchar) end as r from events)
        select event_id, case when trim(lower(r)) = 'up' then 5 when trim(lower(r)) = 'down' then 1 else try_cast(r as int) end as rating,
            coalesce(case when trim(lower(r)) in ('up', 'down') then 3 else try_cast(r as int) end between 1 and 5, false) as stored from r""",
)
def feedback_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and thumbs."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(e, F.when(e % 11 == 0, "up").when(e % 13 == 0, " Down").otherwise((e % 8).cast("string")).alias("rating"))
    good, bad = R.feedback(rows)
    return good.withColumn("stored", F.lit(True)).unionByName(bad.withColumn("rating", F.expr("try_cast(rating as int)")).withColumn("stored", F.lit(False)))


def _html(spark: SparkSession, sf: str, item: Column, head: str, tail: str) -> DataFrame:
    """(page_id, url, html): each page that has links, with one item for each in the order of ids between head and tail."""
    rows = table(spark, sf, "page_links").dropDuplicates(["id"]).withColumn("item", item)
    body = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("x"))
    pages = table(spark, sf, "pages").dropDuplicates(["id"]).select(F.col("id").alias("page_id"), "url").join(body, "page_id")
    items = F.array_join(F.transform("x", lambda s: s["item"]), "")
    return pages.select("page_id", "url", F.concat(F.lit(head), items, F.lit(tail)).alias("html"))


WORDS = "one two three four five six seven eight nine ten eleven"


@query(
    "dom_lists",
    f"""with l as (select distinct id, page_id from page_links where page_id in (select id from pages)),
        o as (select page_id, id, row_number() over (partition by page_id order by id) as i, count(*) over (partition by page_id) as n from l)
        select page_id, cast(i - 1 as int) as idx, 'li' as tag, 'listItem' as type, id as text, 1.0::double as link_density, 'main' as area from o
        union all select page_id, cast(any_value(n) as int), 'ol', 'paragraph', string_agg('{WORDS} ' || id, chr(10) order by id), 0.0, 'main' from o group by 1
        union all select page_id, cast(any_value(n) + 1 as int), 'div', 'paragraph', 'Two words, then four more words', round(2 / 6, 6), null from o group by 1""",
)
def dom_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A list of short items, one of long items, and a div with a link."""
    item = F.concat(F.lit('<li><a href="/x">'), "id", F.lit("</a>"))
    short = _html(spark, sf, item, "<body><main><ul>", "</ul>")
    long = _html(spark, sf, F.concat(F.lit(f"<li>{WORDS} "), "id", F.lit("</li>")), "<ol>", '</ol></main><div><a href="/y">Two words,</a> then four more words</div></body>')
    both = short.join(long.select("page_id", F.col("html").alias("more")), "page_id").withColumn("html", F.concat("html", "more"))
    parsed = parse_pages(both).select("page_id", F.explode("page.blocks").alias("b"))
    return parsed.select("page_id", "b.idx", "b.tag", "b.type", "b.text", F.round("b.link_density", 6).alias("link_density"), F.get("b.ancestors", F.lit(0)).alias("area"))


@query(
    "dom_tables",
    """with l as (select distinct id, page_id, type from page_links where page_id in (select id from pages))
        select page_id, cast(0 as int) as idx, 'p' as tag, 'Shadow words stay' as text from l group by 1
        union all select page_id, 1, 'table', 'Kind, Number.' || chr(10) || string_agg(type || ', ' || id || '.', chr(10) order by id) from l group by 1""",
)
def dom_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table, an open shadow tree, and parts that can't be seen."""
    row = F.concat(F.lit("<tr><td>"), "type", F.lit("<td>"), "id", F.lit("</tr>"))
    head = '<body><template shadowrootmode="open"><p>Shadow words stay</p></template><p style="display:none">Not seen</p><div hidden>Nor this one</div><form>Nor that</form>'
    parsed = parse_pages(_html(spark, sf, row, head + "<table><tr><th>Kind<th>Number</tr>", '</table><p aria-hidden="true">Nor here</p></body>'))
    return parsed.select("page_id", F.explode("page.blocks").alias("b")).select("page_id", "b.idx", "b.tag", "b.text")


FILE_TYPES = {**U.DOCUMENT_TYPES, **U.IMAGE_TYPES}


@query(
    "dom_files",
    f"""with f as (select distinct id, page_id, url from page_documents where page_id in (select id from pages) and {EXT('url')} in ({", ".join(f"'{e}'" for e in FILE_TYPES)})),
        u as (select page_id, url, min(id) as id from f group by 1, 2)
        select page_id, url, {map_sql(FILE_TYPES, EXT('url'))} as mime_type, case when id < '8' then 'File ' || id when regexp_matches(url, '\\.[^./A-Z]*$') then regexp_extract(url, '([^/]*)\\.[^./]*$', 1) else regexp_extract(url, '([^/]*)$', 1) end as description,
            case when id < '8' then 'PARAGRAPH' else 'FILENAME' end as description_source from u""",
)
def dom_files(spark: SparkSession, sf: str) -> DataFrame:
    """Links to attached files, half of them with a name in the text."""
    files = table(spark, sf, "page_documents").dropDuplicates(["id"])
    anchor = F.when(F.col("id") < "8", F.concat(F.lit("File "), "id")).otherwise("")
    item = F.concat(F.lit('<p><a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">'), anchor, F.lit("</a></p>"))
    body = files.withColumn("item", item).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("x"))
    pages = table(spark, sf, "pages").dropDuplicates(["id"]).select(F.col("id").alias("page_id"), "url").join(body, "page_id")
    html = pages.select("page_id", "url", F.concat(F.lit("<body>"), F.array_join(F.transform("x", lambda s: s["item"]), ""), F.lit("</body>")).alias("html"))
    return parse_pages(html).select("page_id", F.explode("page.documents").alias("d")).select("page_id", "d.*")


@query(
    "page_times",
    """select distinct id as page_id, 'unknown' as page_type, case when id < '8' then date_trunc('second', created) at time zone 'UTC' end as last_modified from pages""",
)
def page_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times by RFC 3339 are read, others are none."""
    form = F.when(F.col("id") < "8", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(form.isNotNull(), F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("created", "d MMM yyyy"))
    html = F.concat(F.lit('<html><head><meta property="article:modified_time" content="'), text, F.lit('"></head><body><p>Words</p></body></html>'))
    pages = table(spark, sf, "pages").dropDuplicates(["id"]).select(F.col("id").alias("page_id"), "url", html.alias("html"))
    return parse_pages(pages).select("page_id", "page.page_type", "page.last_modified")


@query(
    "dom_links",
    f"""with l as (select distinct id, page_id, href from page_links where page_id in (select id from pages) and not regexp_matches(href, '[<>&"]')),
        x as (select l.*, p.url as base from l join {PAGES} p on p.id = l.page_id where {EXT('href')} not in ({", ".join(f"'{e}'" for e in U.DOCUMENT_TYPES)})),
        k as (select *, list_filter({ITEMS('href')}, lambda i: not starts_with(lower(i), 'utm_')) as keep from x),
        n as (select *, regexp_extract(href, '^([^?#]*)', 1) || case when len(keep) > 0 then '?' ||
                array_to_string(list_transform(list_sort(list_transform(keep, lambda v, i: {{'k': string_split(v, '=')[1], 'i': i, 'v': v}})), lambda s: s.v), '&') else '' end as clean from k)
        select page_id, clean as href, case when {HOST('href')} = '' or {HOST('href')} = {HOST('base')} or ends_with({HOST('href')}, '.' || {HOST('base')}) then 'internal' else 'external' end as type,
            id as anchor_text from (select *, row_number() over (partition by page_id, clean order by id) as nth from n) where nth = 1""",
)
def dom_links(spark: SparkSession, sf: str) -> DataFrame:
    """All of a page's links, the first of each URL."""
    links = table(spark, sf, "page_links").dropDuplicates(["id"]).filter(~F.col("href").rlike('[<>&"]'))
    item = F.concat(F.lit('<p><a href="'), "href", F.lit('">'), "id", F.lit('</a> <a href="#top">up</a> <a href="mailto:x@y.example">mail</a></p>'))
    body = links.withColumn("item", item).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("x"))
    pages = table(spark, sf, "pages").dropDuplicates(["id"]).select(F.col("id").alias("page_id"), "url").join(body, "page_id")
    html = pages.select("page_id", "url", F.concat(F.lit("<body>"), F.array_join(F.transform("x", lambda s: s["item"]), ""), F.lit("</body>")).alias("html"))
    return parse_pages(html).select("page_id", F.explode("page.links").alias("l")).select("page_id", "l.href", "l.type", "l.anchor_text")


@query(
    "document_hints",
    """select distinct id, case when mime_type = 'application/pdf' then 'pdf' when contains(mime_type, 'wordprocessingml') then 'docx'
        when contains(mime_type, 'spreadsheetml') then 'xlsx' when contains(mime_type, 'vnd.ms-excel') then 'xls' end as hint from page_documents""",
)
def document_hints(spark: SparkSession, sf: str) -> DataFrame:
    """K14."""
    return table(spark, sf, "page_documents").select("id", K.document_hint(F.col("mime_type")).alias("hint")).distinct()


@query(
    "seed_expansion",
    """select distinct unnest(case when id < '8' then [source_url, source_url || 'news'] else [regexp_extract(source_url, '^[^/]*//([^/]*)', 1)] end) as url, cast(0 as int) as depth from sources""",
)
def seed_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the tasks name their seeds, the others only a domain."""
    rows = table(spark, sf, "sources")
    seeds = F.when(F.col("id") < "8", F.array("source_url", F.concat("source_url", F.lit("news"))))
    return K.seeds(rows.select(seeds.alias("seeds"), F.regexp_extract("source_url", "^[^/]*//([^/]*)", 1).alias("domain")))


@query(
    "documents_cap",
    """select scrape_id, cast(coalesce(len(documents[1:2]), -1) as int) as kept, documents[1:2][2].url as last from scrapped_pages""",
)
def documents_cap(spark: SparkSession, sf: str) -> DataFrame:
    """T02, with two documents a page."""
    rows = T.cap_documents(table(spark, sf, "scrapped_pages").select("scrape_id", "documents"), most=2)
    return rows.select("scrape_id", F.when(F.col("documents").isNull(), -1).otherwise(F.size("documents")).alias("kept"), F.get("documents", F.lit(1))["url"].alias("last"))
