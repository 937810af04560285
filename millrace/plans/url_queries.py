"""Queries of the URL functions, over pages and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..registry import query
from ..runtime import table

PAGES = "(select distinct id, url from pages)"
LINKS = "(select distinct id, page_id, block_id, href, anchor_text from page_links)"
HOST = lambda u: f"lower(regexp_extract({u}, '{U.PARTS}', 2))"
ITEMS = lambda u: rf"list_filter(string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')"
KEYS = lambda u: f"list_distinct(list_transform({ITEMS(u)}, lambda x: string_split(x, '=')[1]))"
EXT = lambda u: rf"lower(regexp_extract({u}, '(\.[^./]*)$', 1))"


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def map_sql(types: dict[str, str], key: str) -> str:
    return "case " + key + "".join(f" when '{k}' then '{v}'" for k, v in types.items()) + " end"


@query(
    "url_normalize_core",
    f"""with u as (select id, url, regexp_extract(url, '{U.PARTS}', 1) as s, {HOST('url')} as h, regexp_extract(url, '{U.PARTS}', 3) as p,
                         lower(regexp_extract(url, '{U.PARTS}', 4)) as path from {PAGES})
        select id, case when h <> '' then (case when s = '' then 'https' else lower(s) end) || '://' || h || p ||
            array_to_string(list_reduce(list_transform(string_split(path, '/'), lambda x: [x]),
                lambda a, b: case when b[1] = '..' then a[1:greatest(len(a) - 1, 1)] when b[1] = '.' then a else list_concat(a, b) end), '/') end as url
        from u""",
)
def url_normalize_core(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").dropDuplicates(["id"]).select("id", U.normalize_for_store(F.col("url")).alias("url"))


@query(
    "url_normalize_parser",
    f"""with u as (select id, url, list_filter({ITEMS('url')}, lambda x: not starts_with(lower(x), 'utm_')) as keep from {PAGES})
        select id, regexp_extract(url, '^([^?#]*)', 1) || case when len(keep) > 0 then '?' ||
            array_to_string(list_transform(list_sort(list_transform(keep, lambda x, i: {{'k': string_split(x, '=')[1], 'i': i, 'x': x}})), lambda s: s.x), '&')
            else '' end as url from u""",
)
def url_normalize_parser(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").dropDuplicates(["id"]).select("id", U.normalize_for_parser(F.col("url")).alias("url"))


#: SQL of K01-K05 over ``{urls}``, and of K06-K08 over ``{links}``.
ALLOWED = rf"""with u as ({{urls}}),
        f as (select url,
            not regexp_matches(regexp_replace(lower(url), '[?#].*$', ''), '\.({'|'.join(U.BLOCKED)})$') as extension,
            not (regexp_matches(url, '(?i)/cdn-cgi/') or regexp_matches(url, '(?i)/(?:calendar|events?)/[0-9]{{{{4}}}}')
                 or coalesce(try_cast(nullif(regexp_extract(url, '(?i)[?&/](?:page|p)[=/]([0-9]+)', 1), '') as hugeint) > 50, false)
                 or len(list_filter({KEYS('url')}, lambda k: lower(k) in {in_list(U.TRAP_KEYS)})) > 0) as trap,
            len({KEYS('url')}) <= 4 as parameters,
            not regexp_matches(url_decode(regexp_extract(url, '^(?:[^/?#]*//[^/?#]*)?([^?#]*)', 1)), '{U.NO_CONTENT}') as content from u)
        select *, extension and trap and parameters and content as allowed from f"""
SCORE = rf"""with l as (select *, lower(trim(coalesce(anchor_text, ''))) as a,
                list_filter(string_split(regexp_replace(regexp_replace(lower(href), '^[^:]*://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') as seg
            from ({{links}})),
        b as (select *, list_filter(list_transform(seg, lambda x: case when regexp_matches(x, '{'|'.join(U.NOISY)}') then -0.15
                when regexp_matches(x, '{'|'.join(U.VALUABLE)}') then 0.2 end), lambda x: x is not null) as bonus,
                len(list_filter(regexp_split_to_array(a, '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) as words from l),
        s as (select *, cast(greatest(least(greatest(0.1, 1 - len(seg) * 0.12) + coalesce(bonus[len(bonus)], 0), 1), 0) as double) as url_score,
                cast(case when strlen(a) < 2 then 0.3 when a in {in_list(U.EMPTY_ANCHORS)} then 0.1 when words between 2 and 8 then 1.0 when words = 1 then 0.6 else 0.7 end as double) as anchor_score from b)
        select * exclude (a, seg, bonus, words, url_score), round(url_score, 6) as url_score, round(0.5 * url_score + 0.5 * anchor_score, 6) as score from s"""


@query("url_filter_chain", ALLOWED.format(urls="select distinct href as url from page_links union select distinct url from pages"))
def url_filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "page_links").select(F.col("href").alias("url")).union(table(spark, sf, "pages").select("url")).distinct()
    u = F.col("url")
    return urls.select(
        u,
        U.allowed_extension(u).alias("extension"),
        U.no_trap(u).alias("trap"),
        U.few_parameters(u).alias("parameters"),
        U.has_content(u).alias("content"),
        U.crawlable(u).alias("allowed"),
    )


@query("url_score", f"select id, url_score, anchor_score, score from ({SCORE.format(links=f'select * from {LINKS}')})")
def url_score(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "page_links").dropDuplicates(["id"])
    h, a = F.col("href"), F.col("anchor_text")
    return links.select("id", F.round(U.url_score(h), 6).alias("url_score"), U.anchor_score(a).alias("anchor_score"), F.round(U.link_score(h, a), 6).alias("score"))


@query(
    "links_classify",
    f"""select l.id, case when {HOST('l.href')} = '' or {HOST('l.href')} = {HOST('p.url')} or ends_with({HOST('l.href')}, '.' || {HOST('p.url')})
            then 'internal' else 'external' end as type from {LINKS} l join {PAGES} p on p.id = l.page_id""",
)
def links_classify(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("id").alias("page_id"), "url").dropDuplicates(["page_id"])
    links = table(spark, sf, "page_links").dropDuplicates(["id"]).join(pages, "page_id")
    return links.select("id", U.classify_link(F.col("href"), U.host(F.col("url"))).alias("type"))


@query(
    "link_places",
    f"""with b as (select distinct id, text from page_blocks)
        select l.id, greatest(strpos(b.text, l.anchor_text) - 1, 0) as position,
            case when strpos(b.text, l.anchor_text) > 0 then substring(b.text, greatest(strpos(b.text, l.anchor_text) - 50, 1),
                strpos(b.text, l.anchor_text) + length(l.anchor_text) + 50 - greatest(strpos(b.text, l.anchor_text) - 50, 1)) end as snippet
        from {LINKS} l join b on b.id = l.block_id where l.anchor_text is not null""",
)
def link_places(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "page_blocks").select(F.col("id").alias("block_id"), "text").dropDuplicates(["block_id"])
    links = table(spark, sf, "page_links").filter("anchor_text is not null").dropDuplicates(["id"]).join(blocks, "block_id")
    t, a = F.col("text"), F.col("anchor_text")
    return links.select("id", U.anchor_position(t, a).cast("long").alias("position"), U.anchor_snippet(t, a).alias("snippet"))


@query(
    "document_types",
    f"""with d as (select distinct id, url from page_documents)
        select id, {EXT('url')} as ext, coalesce({map_sql({**U.DOCUMENT_TYPES, **U.IMAGE_TYPES}, EXT('url'))}, 'application/octet-stream') as mime,
            {EXT('url')} in {in_list(U.DOCUMENT_TYPES)} as is_document, {EXT('url')} in {in_list(U.IMAGE_TYPES)} as is_image from d""",
)
def document_types(spark: SparkSession, sf: str) -> DataFrame:
    docs, u = table(spark, sf, "page_documents").dropDuplicates(["id"]), F.col("url")
    return docs.select("id", U.extension(u).alias("ext"), U.mime_type(u).alias("mime"), U.is_document(u).alias("is_document"), U.is_image(u).alias("is_image"))
