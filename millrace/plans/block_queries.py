"""Queries of block filters, scores, clusters and merge rules, over the blocks of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WS, word_count
from ..operators import blocks as B
from ..operators import merging as M
from ..registry import query
from ..runtime import materialize, table
from .text_queries import STOP_SQL, fields_sql, tokens_sql
from .url_queries import in_list


def raw_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Stored blocks in the parser's form: link words from the link table, all after the first h1 in the article."""
    words = table(spark, sf, "page_links").dropDuplicates(["id"]).filter("block_id is not null")
    words = words.groupBy("block_id").agg(F.sum(word_count(F.col("anchor_text"))).alias("linked"))
    own = table(spark, sf, "page_blocks").dropDuplicates(["id"]).join(words, F.col("id") == F.col("block_id"), "left")
    page = Window.partitionBy("page_id")
    kind = F.when(F.lower("type") == "listitem", "listItem").otherwise(F.lower("type"))
    level = F.when(kind == "heading", F.coalesce("heading_level", F.lit(2)))
    tag = F.when(kind == "heading", F.concat(F.lit("h"), level)).when(kind == "listItem", "li").otherwise("p")
    start = F.min(F.when(level == 1, F.col("ord"))).over(page)
    n = word_count(F.col("text"))
    return own.select(
        "page_id",
        F.col("ord").alias("idx"),
        tag.alias("tag"),
        kind.alias("type"),
        level.alias("heading_level"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(n > 0, F.least(F.lit(1.0), F.coalesce("linked", F.lit(0)) / n)).otherwise(F.lit(0.0)).alias("link_density"),
        (F.col("ord") / F.count("*").over(page)).alias("position"),
        F.when(F.col("ord") >= start, F.array(F.lit("article"))).otherwise(F.array().cast("array<string>")).alias("ancestors"),
        "html_id",
        F.when(F.col("ord") % 5 < 3, (F.col("ord") / 5).cast("int")).otherwise(F.lit(-1)).alias("group_idx"),
    )


RAW = f"""b as (select distinct id, page_id, ord, type, heading_level, text, html_id from page_blocks),
l as (select block_id, sum(len({fields_sql('anchor_text')})) as linked from (select distinct id, block_id, anchor_text from page_links where block_id is not null) group by 1),
k as (select b.*, l.linked, case when lower(type) = 'listitem' then 'listItem' else lower(type) end as kind, coalesce(len({fields_sql('text')}), 0) as n
      from b left join l on l.block_id = b.id),
k2 as (select *, case when kind = 'heading' then coalesce(heading_level, 2) end as level from k),
raw as (select page_id, ord as idx, case kind when 'heading' then 'h' || level when 'listItem' then 'li' else 'p' end as tag, kind as type, level as heading_level,
      coalesce(text, '') as text, case when n > 0 then least(1.0, coalesce(linked, 0) / n) else 0.0 end as link_density,
      ord / count(*) over w as position, coalesce(ord >= min(case when level = 1 then ord end) over w, false) as article, html_id,
      case when ord % 5 < 3 then ord // 5 else -1 end as group_idx
      from k2 window w as (partition by page_id))"""

TRIM = lambda t: f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"
ANY = lambda t, phrases: "(" + " or ".join("contains(" + t + ", '" + p.replace("'", "''") + "')" for p in phrases) + ")"
TERMINAL = f"{TRIM('regexp_replace(' + TRIM('lower(text)') + ', ' + chr(39) + '(?s)^([^' + chr(92) + '[]+)' + chr(92) + '[.*$' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + ')')} in {in_list(B.TERMINAL_HEADINGS)}"

FILTERED = f"""{RAW},
c as (select *, min(case when type = 'heading' and idx >= floor(n * 0.2) and position >= 0.30 and {ANY(TRIM('lower(text)'), B.TAIL_HEADINGS)} then idx end)
      over (partition by page_id) as cut from (select *, count(*) over (partition by page_id) as n from raw)),
t as (select * exclude (cut, n), type = 'heading' and {TERMINAL} as terminal from c where cut is null or idx < cut),
h as (select page_id, idx, coalesce(heading_level, 0) as lvl, terminal from t where type = 'heading'),
inside as (select distinct t.page_id, t.idx from t join h j on j.page_id = t.page_id and j.idx < t.idx and j.terminal and j.lvl < 7
      where not exists (select 1 from h k where k.page_id = t.page_id and k.idx > j.idx and k.idx < t.idx and k.lvl <= j.lvl)),
f as (select t.* from t left join inside i on i.page_id = t.page_id and i.idx = t.idx
      where i.idx is null and not terminal and length(text) >= 10 and link_density <= case when article then 0.75 else 0.5 end
        and (type = 'heading' or len({fields_sql('text')}) >= 3) and not {ANY("lower(replace(text, chr(160), ' '))", B.TAIL_PHRASES)}),
kept as (select * exclude (idx), idx as old_idx, row_number() over (partition by page_id order by idx) - 1 as idx from f)"""

SCORED = f"""{FILTERED},
s0 as (select *, {tokens_sql('text')} as w,
      case when article then 3.0 else 0.0 end
      + case when regexp_matches(lower(coalesce(html_id, '')), '{'|'.join(B.BAD_IDS)}') then -2.0 when regexp_matches(lower(coalesce(html_id, '')), '{'|'.join(B.GOOD_IDS)}') then 2.0 else 0.0 end
      + case when position > 0.85 then -1.5 else 0.0 end
      + case tag when 'p' then 1.0 when 'li' then 0.5 else 0.0 end + length(text) - length(translate(text, ',，、', '')) + least(strlen(text) / 100.0, 3.0) as s from kept),
s1 as (select *, len(list_filter(w, lambda x: list_contains({STOP_SQL}, x))) / nullif(len(w), 0) as share from s0),
s2 as (select *, case when share is null or share < 0.10 then -2.0 else len(w) / (strlen(text) / 80.0 + 1) * (1 - link_density) end as d from s1),
scored as (select * exclude (w), round(cast(s + 0.5 * coalesce(lag(s) over o, 0) + 0.5 * coalesce(lead(s) over o, 0) + d
      + greatest(0.5 * coalesce(lag(d) over o, 0), 0.5 * coalesce(lead(d) over o, 0), 0) as double), 6) as score from s2 window o as (partition by page_id order by idx))"""

FLOORED = f"""{SCORED},
r as (select *, count(*) filter (score > 0) over (partition by page_id) as m,
      case when score > 0 then row_number() over (partition by page_id, score > 0 order by score, idx) - 1 end as rank from scored),
fl as (select *, coalesce(max(case when rank = least(cast(floor(m * (0.15 + 0.10 * least(1.0, m / 50.0))) as bigint), m - 1) then score end) over (partition by page_id), 0) as floor from r),
ov as (select *, idx - lag(idx) over (partition by page_id order by idx) > 6 as jump from fl where score >= floor),
c1 as (select *, sum(cast(coalesce(jump, false) as int)) over (partition by page_id order by idx) as cluster from ov),
c2 as (select page_id, cluster, min(idx) as first, max(idx) as last, any_value(floor) as floor from c1 group by 1, 2),
g1 as (select *, lag(last) over (partition by page_id order by first) as prev from c2),
g2 as (select g1.page_id, g1.cluster, g1.first, g1.last, g1.floor, g1.prev, avg(scored.score) as mean from g1
      left join scored on scored.page_id = g1.page_id and scored.idx > g1.prev and scored.idx < g1.first group by all),
g3 as (select *, prev is null or first - prev - 1 > 8 or (first - prev - 1 > 0 and round(mean, 6) < round(floor * 0.3, 6)) as new from g2),
g4 as (select *, sum(cast(new as int)) over (partition by page_id order by first) - 1 as merged from g3),
g5 as (select page_id, merged as cluster, min(first) as first, max(last) as last from g4 group by 1, 2),
cl as (select g5.page_id, g5.cluster, g5.first, g5.last, round(sum(scored.score), 6) as total from g5
      join scored on scored.page_id = g5.page_id and scored.idx between g5.first and g5.last group by all),
best as (select *, greatest(max(total) over (partition by page_id), 0) as best from cl),
keep as (select * from best where total >= round(best * 0.3, 6))"""


@query("block_filters", f"with {FILTERED} select page_id, cast(idx as int) as idx, text from kept")
def block_filters(spark: SparkSession, sf: str) -> DataFrame:
    return B.filter_blocks(raw_blocks(spark, sf)).select("page_id", "idx", "text")


@query("block_scores", f"with {SCORED} select page_id, cast(idx as int) as idx, score from scored")
def block_scores(spark: SparkSession, sf: str) -> DataFrame:
    return B.score_blocks(B.filter_blocks(raw_blocks(spark, sf))).select("page_id", "idx", "score")


@query("block_floor", f"with {FLOORED} select distinct page_id, floor from fl")
def block_floor(spark: SparkSession, sf: str) -> DataFrame:
    return B.page_floors(B.score_blocks(B.filter_blocks(raw_blocks(spark, sf)))).select("page_id", "floor").distinct()


@query("block_clusters", f"with {FLOORED} select page_id, cast(cluster as int) as cluster, cast(first as int) as first, cast(last as int) as last, total from keep")
def block_clusters(spark: SparkSession, sf: str) -> DataFrame:
    scored = materialize(B.page_floors(B.score_blocks(B.filter_blocks(raw_blocks(spark, sf)))))
    kept = B.keep_clusters(B.merge_clusters(scored, B.find_clusters(scored)))
    return kept.select("page_id", F.col("cluster").cast("int").alias("cluster"), "first", "last", "total")


@query(
    "block_content",
    f"""with {FLOORED},
        a as (select page_id, idx, text, coalesce(max(case when type <> 'heading' then idx end) over (partition by page_id order by idx rows between unbounded preceding and 1 preceding), -1) + 1 as begin from scored),
        span as (select k.page_id, a.begin, k.last from keep k join a on a.page_id = k.page_id and a.idx = k.first)
        select page_id, cast(idx as int) as idx, text from a where exists (select 1 from span s where s.page_id = a.page_id and a.idx between s.begin and s.last)""",
)
def block_content(spark: SparkSession, sf: str) -> DataFrame:
    return B.main_content(raw_blocks(spark, sf)).select("page_id", "idx", "text")


@query(
    "merge_headings",
    f"""with {RAW},
        g as (select *, coalesce(sum(cast(type <> 'heading' as int)) over (partition by page_id order by idx rows between unbounded preceding and 1 preceding), 0) as g from raw),
        m as (select page_id, g, string_agg(text, chr(10) order by idx) as text, arg_max(type, idx) as type, count(*) as n,
              arg_min(coalesce(heading_level, -1), idx) as level from g group by 1, 2)
        select page_id, cast(g as int) as idx, type, text, cast(case when n > 1 then nullif(level, -1) end as int) as heading_level from m where type <> 'heading'""",
)
def merge_headings(spark: SparkSession, sf: str) -> DataFrame:
    return M.absorb_headings(raw_blocks(spark, sf)).select("page_id", "idx", "type", "text", "heading_level")


@query(
    "merge_questions",
    f"""with {RAW},
        q as (select *, len({fields_sql('text')}) <= 40 and regexp_matches(trim(text), '[?？]$') as q from raw),
        t as (select *, q and not coalesce(lead(q) over o, true) as t, lead(text) over o as next from q window o as (partition by page_id order by idx)),
        g as (select *, coalesce(lag(t) over (partition by page_id order by idx), false) as gone from t)
        select page_id, idx, case when t then 'paragraph' else type end as type, case when t then text || chr(10) || next else text end as text from g where not gone""",
)
def merge_questions(spark: SparkSession, sf: str) -> DataFrame:
    return M.pair_questions(raw_blocks(spark, sf)).select("page_id", "idx", "type", "text")


def _fold_sql(joins: str, between: str, kind: str) -> str:
    """A greedy fold as a recursion over each page's blocks."""
    return f"""with recursive {RAW},
        x as (select page_id, row_number() over (partition by page_id order by idx) as i, type, text, len({fields_sql('text')}) as n, group_idx,
              count(*) over (partition by page_id, group_idx) <= 0.4 * count(*) over (partition by page_id) as small from raw),
        z(page_id, i, k, type, text, n, group_idx) as (
            select page_id, i, 0, type, text, n, case when group_idx >= 0 and small then group_idx end from x where i = 1
            union all
            select x.page_id, x.i, case when coalesce({joins}, false) then z.k else z.k + 1 end,
                case when coalesce({joins}, false) then {kind} else x.type end,
                case when coalesce({joins}, false) then z.text || {between} || x.text else x.text end,
                case when coalesce({joins}, false) then z.n + x.n else x.n end,
                case when coalesce({joins}, false) then z.group_idx when x.group_idx >= 0 and x.small then x.group_idx end
            from z join x on x.page_id = z.page_id and x.i = z.i + 1)
        select page_id, k as idx, arg_max(type, i) as type, arg_max(text, i) as text from z group by 1, 2"""


@query("merge_lists", _fold_sql("z.type = 'listItem' and x.type = 'listItem' and z.n + x.n <= 300", "chr(10)", "z.type"))
def merge_lists(spark: SparkSession, sf: str) -> DataFrame:
    return M.join_lists(raw_blocks(spark, sf)).select("page_id", "idx", "type", "text")


@query(
    "merge_siblings",
    _fold_sql(
        "z.group_idx = case when x.group_idx >= 0 and x.small then x.group_idx end and z.type <> 'heading' and x.type <> 'heading' and z.n + x.n <= 300", "chr(10)", "z.type"
    ),
)
def merge_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return M.join_siblings(raw_blocks(spark, sf)).select("page_id", "idx", "type", "text")


@query(
    "merge_short",
    _fold_sql("z.n < 30 and x.type <> 'heading' and z.n + x.n <= 300", "chr(10) || chr(10)", "case when z.type = x.type then z.type else 'paragraph' end"),
)
def merge_short(spark: SparkSession, sf: str) -> DataFrame:
    return M.join_short(raw_blocks(spark, sf)).select("page_id", "idx", "type", "text")


def _step(name: str, source: str, joins: str, between: str, kind: str = "z.type") -> str:
    """One greedy fold of the chain, with all that a block carries along."""
    pick = lambda joined, new: f"case when coalesce({joins}, false) then {joined} else {new} end"
    return f"""{name}_x as (select page_id, row_number() over (partition by page_id order by idx) as i, type, text, coalesce(len({fields_sql('text')}), 0) as n, html_id, heading_level,
            case when group_idx >= 0 and small then group_idx end as g
            from (select *, count(*) over (partition by page_id, group_idx) <= 0.4 * count(*) over (partition by page_id) as small from {source})),
        {name}_g as (select page_id, row_number() over (partition by page_id order by idx) as i, group_idx from {source}),
        {name}_z(page_id, i, k, type, text, n, g, html_id, heading_level) as (
            select page_id, i, 0, type, text, n, g, html_id, heading_level from {name}_x where i = 1
            union all
            select x.page_id, x.i, {pick('z.k', 'z.k + 1')}, {pick(kind, 'x.type')}, {pick('z.text || ' + between + ' || x.text', 'x.text')}, {pick('z.n + x.n', 'x.n')},
                {pick('z.g', 'x.g')}, {pick('z.html_id', 'x.html_id')}, {pick('z.heading_level', 'x.heading_level')}
            from {name}_z z join {name}_x x on x.page_id = z.page_id and x.i = z.i + 1),
        {name} as (select z.page_id, k as idx, arg_max(type, z.i) as type, arg_max(text, z.i) as text, max(html_id) as html_id, max(heading_level) as heading_level, arg_min(o.group_idx, z.i) as group_idx
            from {name}_z z join {name}_g o on o.page_id = z.page_id and o.i = z.i group by 1, 2)"""


@query(
    "merge_chain",
    f"""with recursive {RAW},
        {_step('m1', 'raw', "z.type = 'listItem' and x.type = 'listItem' and z.n + x.n <= 300", 'chr(10)')},
        {_step('m2', 'm1', "z.g = x.g and z.type <> 'heading' and x.type <> 'heading' and z.n + x.n <= 300", 'chr(10)')},
        h as (select *, coalesce(sum(cast(type <> 'heading' as int)) over (partition by page_id order by idx rows between unbounded preceding and 1 preceding), 0) as c from m2),
        m3 as (select page_id, c as idx, arg_max(type, idx) as type, string_agg(text, chr(10) order by idx) as text, (list(html_id order by idx))[-1] as html_id,
                      (list(heading_level order by idx))[1] as heading_level, -1 as group_idx from h group by page_id, c having arg_max(type, idx) <> 'heading'),
        q as (select *, coalesce(len({fields_sql('text')}), 0) <= 40 and regexp_matches(trim(text), '[?？]$') as q from m3),
        t as (select *, q and not coalesce(lead(q) over o, true) as t, lead(text) over o as next from q window o as (partition by page_id order by idx)),
        u as (select *, coalesce(lag(t) over (partition by page_id order by idx), false) as gone from t),
        m4 as (select page_id, idx, case when t then 'paragraph' else type end as type, case when t then text || chr(10) || next else text end as text, html_id, heading_level, group_idx from u where not gone),
        {_step('m5', 'm4', "z.n < 30 and x.type <> 'heading' and z.n + x.n <= 300", 'chr(10) || chr(10)', "case when z.type = x.type then z.type else 'paragraph' end")}
        select page_id, cast(idx as int) as idx, type, text, html_id, cast(case when heading_level > 0 then heading_level end as int) as heading_level from m5""",
)
def merge_chain(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge_blocks(raw_blocks(spark, sf))
