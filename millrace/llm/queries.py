"""The queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import abuse, languages, main_body, mixing, near_pages, residue, site_lines, splitting, tokens

WS = r"[\s\x0B\x{85}\p{Z}]"


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    model = languages.fit(table(spark, sf, "language_samples"))
    return languages.label_cases(table(spark, sf, "pages"), table(spark, sf, "page_blocks"), model)


def p1_pages(spark: SparkSession, sf: str) -> DataFrame:
    model = languages.fit(table(spark, sf, "language_samples"))
    return languages.infer_languages(table(spark, sf, "page_blocks"), model)[0]


def p1_passages(spark: SparkSession, sf: str) -> DataFrame:
    model = languages.fit(table(spark, sf, "language_samples"))
    return languages.infer_languages(table(spark, sf, "page_blocks"), model)[1]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = p2_pieces(spark, sf)
    return pieces.filter("piece_no = 0").select("item_key", "forced")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    items = splitting.oversized_items(table(spark, sf, "page_blocks"), table(spark, sf, "page_documents"))
    return splitting.split_oversized(items)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = site_lines.repeated_lines(table(spark, sf, "page_blocks"), table(spark, sf, "pages"))
    return site_lines.same_lines(found.filter("cluster_pages >= 8"))


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "page_blocks")
    found = site_lines.similar_lines(blocks, site_lines.repeated_lines(blocks, table(spark, sf, "pages")))
    return site_lines.remove_lines(blocks.dropDuplicates(["id"]), found).select("id", "text", "removed_lines")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_pages.near_page_pairs(table(spark, sf, "page_blocks"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_pages.page_classes(table(spark, sf, "page_blocks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pages, scrapes = table(spark, sf, "pages"), table(spark, sf, "scrapped_pages")
    drop = main_body.furniture_blocks(main_body.page_streams(table(spark, sf, "page_blocks"), scrapes, pages))
    return drop.join(residue.find_residue(residue.searched_texts(pages, scrapes)), ["page_key", "block_no"], "left_anti")


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    return main_body.main_body(main_body.page_streams(table(spark, sf, "page_blocks"), table(spark, sf, "scrapped_pages"), table(spark, sf, "pages")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find_residue(residue.searched_texts(table(spark, sf, "pages"), table(spark, sf, "scrapped_pages")))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


def p7_text(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, sf, "documents")))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return abuse.score_documents(docs, abuse.fit(docs, table(spark, sf, "review_labels")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_scores(spark, sf).filter("score >= 0.5").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.source_rates(table(spark, sf, "documents"), p9_scores(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pages, p1_passages, p2_found, p2_pieces, p3_found, p3_clean, p4_found, p4_classes, p5_found, p5_clean, p6_found, p7_ids, p7_text, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)
}

SQL: dict[str, str] = {
    "p2_found": rf"""
        with t as (
            select distinct 'block:' || id as item_key, text from page_blocks
            union
            select distinct 'document:' || id, extracted_text from page_documents
        ), u as (
            select item_key, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') as text from t where length(text) > 1000
        )
        select item_key,
               cast(list_max(list_transform(
                   string_split(regexp_replace(regexp_replace(text, '[\r\x0B\f\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'),
                                               '([.!?…]){WS}', '\1' || chr(10), 'g'), chr(10)),
                   lambda s: length(regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')))) > 1000 as int) as forced
        from u where length(text) > 1000""",
    "p3_found": r"""
        with b as (select distinct id, page_id, text from page_blocks),
        l as (
            select b.id as block_id, b.page_id, p.source_id, generate_subscripts(string_split(b.text, chr(10)), 1) - 1 as line_no,
                   unnest(string_split(b.text, chr(10))) as line
            from b join (select distinct id, source_id from pages where source_id is not null) p on p.id = b.page_id
        ), k as (
            select block_id, page_id, source_id, line_no, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) as letters from l
        ), f as (
            select source_id, letters from k where letters <> '' group by 1, 2 having count(distinct page_id) >= 8
        )
        select block_id, cast(line_no as int) as line_no from k join f using (source_id, letters)""",
    "p4_found": r"""
        with b as (select distinct id, page_id, ord, text from page_blocks),
        p as (select page_id, string_agg(text, chr(10) order by ord, id) as text from b group by 1),
        w as (select page_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from p),
        s as (select distinct page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) as run from w where len(w) > 2),
        n as (select page_id, count(*) as n from s group by 1),
        m as (select a.page_id as page_id_a, b.page_id as page_id_b, count(*) as n_both from s a join s b on a.run = b.run and a.page_id < b.page_id group by 1, 2)
        select page_id_a, page_id_b from m join n x on x.page_id = page_id_a join n y on y.page_id = page_id_b
        where n_both * 10 >= 7 * (x.n + y.n - n_both)""",
    "p7_text": "select doc_id, coalesce(text, '') as text from documents",
}
