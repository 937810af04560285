"""Block filters, scores, clusters and selection.

Input: blocks (page_id, idx, tag, type, heading_level, text, link_density, position, ancestors array<string>,
html_id). Every operator partitions by page; a page's blocks are few, pages are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.text import STOP, letter_tokens, stop_density, text_density, trim_space, word_count
from ..runtime import materialize

# Headings from which a page's tail is cut.
TAIL_HEADINGS = [
    "новости", "все новости", "ещё новости", "еще новости", "последние новости", "читайте также", "смотрите также",
    "похожие материалы", "похожие статьи", "рекомендуем", "вам также может быть интересно", "другие программы",
    "другие бакалаврские программы", "другие магистерские программы", "другие курсы", "related articles", "related posts",
    "related stories", "more stories", "you may also like", "recommended for you", "also read", "further reading",
    "other programs", "trending", "trending now", "trending news", "most popular", "most read", "popular stories", "what's hot",
    "top rated comments", "reader comments", "user comments", "комментарии",
]

# Headings of sections that hold no content.
TERMINAL_HEADINGS = [
    "references", "see also", "external links", "further reading", "bibliography", "notes", "footnotes", "citations", "ссылки",
    "внешние ссылки", "примечания", "литература", "см. также", "источники", "сноски", "библиография", "навигация",
]

# Phrases of furniture at a page's end.
TAIL_PHRASES = [
    "условия использования материалов", "политика конфиденциальности", "© ниу вшэ", "файлы cookies", "файлов cookies", "cookie",
    "мы в соцсетях", "карта сайта", "minobrnauki.gov.ru", "edu.gov.ru", "все права защищены", "terms of use", "privacy policy",
    "all rights reserved", "шрифты hse sans", "разработаны в школе дизайна", "вам также может быть интересно",
]

# Parts of html ids that speak for content or against it.
GOOD_IDS = "article body content entry main page post text blog story".split()
BAD_IDS = """comment combx contact masthead media meta outbrain promo related scroll shoutbox sidebar sponsor shopping tags tool
widget social share banner menu advert""".split()

KEYS = ["page_id", "idx"]


def of_page() -> WindowSpec:
    return Window.partitionBy("page_id")


def in_order() -> WindowSpec:
    return of_page().orderBy("idx")


def contains_any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def truncate_tail(blocks: DataFrame) -> DataFrame:
    """everything goes from the first tail heading in the later part of the page."""
    n = F.count("*").over(of_page())
    cut = (F.col("type") == "heading") & (F.col("idx") >= F.floor(n * F.lit(0.2))) & (F.col("position") >= 0.30)
    cut = cut & contains_any(F.lower(trim_space(F.col("text"))), TAIL_HEADINGS)
    first = F.min(F.when(cut, F.col("idx"))).over(of_page())
    return blocks.withColumn("_cut", first).filter("_cut is null or idx < _cut").drop("_cut")


def long_enough(text: Column, least: int = 10) -> Column:
    """F02, in code points."""
    return F.length(text) >= least


def few_links(tag: Column, ancestors: Column, density: Column) -> Column:
    """tables are exempt, content areas may hold more links."""
    inside = F.array_contains(ancestors, "article") | F.array_contains(ancestors, "main")
    return (tag == "table") | (density <= F.when(inside, 0.75).otherwise(0.5))


def enough_words(kind: Column, text: Column, least: int = 3) -> Column:
    """headings are exempt."""
    return (kind == "heading") | (word_count(text) >= least)


def is_terminal(text: Column) -> Column:
    plain = F.lower(trim_space(text))
    return trim_space(F.regexp_replace(plain, r"(?s)^([^\[]+)\[.*$", "$1")).isin(*TERMINAL_HEADINGS)


def outside_terminal(blocks: DataFrame) -> DataFrame:
    """adds ``outside``. A block stands under the last heading of each level that no later heading of that level or a
    smaller one has closed; any of them may be terminal. It runs over the blocks as given, so it belongs before the other
    filters. Seven last values are carried along, one for each level, so the work is linear in the page."""
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumn("_level", F.when(F.col("type") == "heading", F.coalesce("heading_level", F.lit(0))))
    out = out.withColumn("_own", F.col("_level").isNotNull() & is_terminal(F.col("text")))
    last = [F.last(F.when(F.col("_level") == v, F.struct("idx", "_own")), True).over(before).alias(f"_{v}") for v in range(7)]
    out = out.select("*", *last)
    hit, closed = F.lit(False), F.lit(-1)
    for v in range(7):
        at = F.coalesce(F.col(f"_{v}.idx"), F.lit(-1))
        hit = hit | (F.coalesce(F.col(f"_{v}._own"), F.lit(False)) & (at > closed))
        closed = F.greatest(closed, at)
    return out.withColumn("outside", ~(F.col("_own") | hit)).drop("_level", "_own", *[f"_{v}" for v in range(7)])


def no_tail_phrase(text: Column) -> Column:
    """F06."""
    return ~contains_any(F.lower(F.replace(text, F.lit("\xa0"), F.lit(" "))), TAIL_PHRASES)


def filter_blocks(blocks: DataFrame) -> DataFrame:
    """The chain F01, then F02-F06 on each block; new ``idx`` without gaps."""
    kept = outside_terminal(truncate_tail(blocks)).filter(
        long_enough(F.col("text"))
        & few_links(F.col("tag"), F.col("ancestors"), F.col("link_density"))
        & enough_words(F.col("type"), F.col("text"))
        & F.col("outside")
        & no_tail_phrase(F.col("text"))
    )
    return kept.withColumn("idx", F.row_number().over(in_order()) - 1).drop("outside")


def structure_score(ancestors: Column, html_id: Column, position: Column) -> Column:
    """C01, C02, C03."""
    area = F.when(F.array_contains(ancestors, "main") | F.array_contains(ancestors, "article"), 3.0)
    area = area.when(F.array_contains(ancestors, "section"), 1.0).otherwise(0.0)
    name = F.lower(F.coalesce(html_id, F.lit("")))
    by_id = F.when(name.rlike("|".join(BAD_IDS)), -2.0).when(name.rlike("|".join(GOOD_IDS)), 2.0).otherwise(0.0)
    return area + by_id + F.when(position > 0.85, -1.5).otherwise(0.0)


def readability(tag: Column, text: Column) -> Column:
    """The tag's weight, a point a comma, and up to three for length in bytes."""
    weight = F.when(tag.isin("p", "blockquote", "pre"), 1.0).when(tag == "li", 0.5).when(tag == "td", -0.5).otherwise(0.0)
    commas = F.length(text) - F.length(F.translate(text, ",，、", ""))
    return weight + commas + F.least(F.octet_length(text) / F.lit(100.0), F.lit(3.0))


def score_blocks(blocks: DataFrame, stop: tuple[str, ...] = STOP) -> DataFrame:
    """Adds ``score``. Neighbours share half of the score so far, then of their density."""
    own = structure_score(F.col("ancestors"), F.col("html_id"), F.col("position")) + readability(F.col("tag"), F.col("text"))
    out = blocks.withColumn("_s", own).withColumn("_w", letter_tokens(F.col("text"))).withColumn("_share", stop_density(F.col("_w"), stop))
    out = out.withColumn("_d", text_density(F.col("text"), F.col("link_density"), F.col("_w"), F.col("_share"))).drop("_w", "_share")
    near = lambda c, f: F.coalesce(f(c).over(in_order()), F.lit(0.0))
    spread = F.col("_s") + 0.5 * near("_s", F.lag) + 0.5 * near("_s", F.lead)
    boost = F.greatest(0.5 * near("_d", F.lag), 0.5 * near("_d", F.lead), F.lit(0.0))
    return out.withColumn("score", F.round(spread + F.col("_d") + boost, 6)).drop("_s", "_d")


def page_floors(scored: DataFrame) -> DataFrame:
    """Adds ``floor``, an exact order statistic of the page's positive scores; 0 without any."""
    m = F.count(F.when(F.col("score") > 0, 1)).over(of_page())
    rank = F.when(F.col("score") > 0, F.row_number().over(of_page().orderBy((F.col("score") > 0).desc(), "score", "idx")) - 1)
    quantile = 0.15 + 0.10 * F.least(F.lit(1.0), m / F.lit(50.0))
    at = F.least(F.floor(m * quantile), m - 1)
    out = scored.withColumn("_r", rank).withColumn("_at", at)
    return out.withColumn("floor", F.coalesce(F.max(F.when(F.col("_r") == F.col("_at"), F.col("score"))).over(of_page()), F.lit(0.0))).drop("_r", "_at")


def find_clusters(floored: DataFrame, gap: int = 5) -> DataFrame:
    """(page_id, cluster, first, last, total, floor): runs of blocks at or over the floor that bridge gaps; bridged
    blocks count in the total."""
    over = floored.filter("score >= floor")
    jump = F.col("idx") - F.lag("idx").over(in_order()) > gap + 1
    runs = over.withColumn("cluster", F.sum(F.coalesce(jump, F.lit(False)).cast("int")).over(in_order()))
    runs = runs.groupBy("page_id", "cluster").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.first("floor").alias("floor"))
    return _totals(floored, runs)


def _totals(scored: DataFrame, runs: DataFrame) -> DataFrame:
    s, r = scored.select("page_id", "idx", "score").alias("s"), runs.drop("total").alias("r")
    inside = (F.col("s.page_id") == F.col("r.page_id")) & F.col("s.idx").between(F.col("r.first"), F.col("r.last"))
    return r.join(s, inside).groupBy("r.page_id", "r.cluster", "r.first", "r.last", "r.floor").agg(F.round(F.sum("s.score"), 6).alias("total"))


def merge_clusters(scored: DataFrame, clusters: DataFrame, distance: int = 8, ratio: float = 0.3) -> DataFrame:
    """C11: neighbours become one where the gap is short and its mean score high enough. Each pair of neighbours decides
    for itself, so a second pass over islands is enough."""
    by = of_page().orderBy("first")
    gaps = clusters.withColumn("_end", F.lag("last").over(by))
    g, s = gaps.alias("g"), scored.select("page_id", "idx", "score").alias("s")
    between = (F.col("s.page_id") == F.col("g.page_id")) & (F.col("s.idx") > F.col("g._end")) & (F.col("s.idx") < F.col("g.first"))
    mean = g.join(s, between, "left").groupBy("g.page_id", "g.cluster", "g.first", "g.last", "g.floor", "g._end").agg(F.avg("s.score").alias("mean"))
    length = F.col("first") - F.col("_end") - 1
    new = F.col("_end").isNull() | (length > distance) | ((length > 0) & (F.round("mean", 6) < F.round(F.col("floor") * ratio, 6)))
    out = mean.withColumn("cluster", F.sum(new.cast("int")).over(by) - 1)
    out = out.groupBy("page_id", "cluster").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("floor").alias("floor"))
    return _totals(scored, out)


def keep_clusters(clusters: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Clusters with at least this share of the page's best total."""
    best = F.greatest(F.max("total").over(of_page()), F.lit(0.0))
    return clusters.withColumn("_best", best).filter(F.col("total") >= F.round(F.col("_best") * ratio, 6)).drop("_best")


def select_content(scored: DataFrame, kept: DataFrame) -> DataFrame:
    """The blocks of the kept clusters, each with the unbroken run of headings right before it."""
    content = F.when(F.col("type") != "heading", F.col("idx"))
    last = F.max(content).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    marked = scored.withColumn("_after", F.coalesce(last, F.lit(-1)) + 1)
    starts = marked.select("page_id", F.col("idx").alias("first"), F.col("_after").alias("begin"))
    spans = kept.join(starts, ["page_id", "first"]).select("page_id", "begin", "last")
    b, k = marked.drop("_after").alias("b"), spans.alias("k")
    inside = (F.col("b.page_id") == F.col("k.page_id")) & F.col("b.idx").between(F.col("k.begin"), F.col("k.last"))
    return b.join(k, inside, "left_semi")


def select_all(scored: DataFrame) -> DataFrame:
    """C14: the selector that keeps every block."""
    return scored


def main_content(blocks: DataFrame) -> DataFrame:
    """The whole chain: filters, scores, floor, clusters, merging, selection."""
    scored = materialize(page_floors(score_blocks(filter_blocks(blocks))))  # four steps read it
    return select_content(scored, keep_clusters(merge_clusters(scored, find_clusters(scored))))
