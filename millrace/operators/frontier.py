"""The crawl frontier over an already fetched link table.

Edges are (source_url, href, anchor_text, internal boolean); a crawl is a loop of waves, each one join, with the visited
table written between waves so that lost executors cost no more than one wave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import crawlable, link_score
from ..runtime import materialize


def unseen(candidates: DataFrame, visited: DataFrame, *key: str) -> DataFrame:
    """Each exact URL once, and none visited before."""
    key = key or ("url",)
    return candidates.dropDuplicates(list(key)).join(visited.select(*key), list(key), "left_anti")


def document_hint(mime: Column) -> Column:
    """The parser's hint by type; null for what isn't parsed."""
    return (
        F.when(mime == "application/pdf", "pdf")
        .when(F.contains(mime, F.lit("wordprocessingml")), "docx")
        .when(F.contains(mime, F.lit("spreadsheetml")), "xlsx")
        .when(F.contains(mime, F.lit("vnd.ms-excel")), "xls")
    )


def seeds(tasks: DataFrame) -> DataFrame:
    """(url, depth): the task's seeds, or its domain where there are none."""
    own = F.when(F.size("seeds") > 0, F.col("seeds")).otherwise(F.array("domain"))
    return tasks.select(F.explode(own).alias("url")).distinct().withColumn("depth", F.lit(0))


def link_candidates(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """The internal links of fetched pages (url, depth) that pass the filters, one deeper, with a score."""
    out = edges.filter("internal").join(pages.select(F.col("url").alias("source_url"), "depth"), "source_url")
    out = out.filter(crawlable(F.col("href"))).select(
        F.col("href").alias("url"), (F.col("depth") + 1).alias("depth"), F.round(link_score(F.col("href"), F.col("anchor_text")), 6).alias("score")
    )
    return out.groupBy("url").agg(F.min("depth").alias("depth"), F.max("score").alias("score"))


def best_first(candidates: DataFrame, n: int) -> DataFrame:
    """The ``n`` best candidates; ties go by URL."""
    return candidates.orderBy(F.col("score").desc(), "url").limit(n)


def wanted(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Fits one of the patterns to include, where there are any, and none of those to exclude."""
    inside = F.lit(True) if not include else url.rlike("|".join(f"(?:{p})" for p in include))
    return inside if not exclude else inside & ~url.rlike("|".join(f"(?:{p})" for p in exclude))


def crawl_waves(start: DataFrame, edges: DataFrame, max_depth: int, max_pages: int | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(url, depth) reached breadth-first within the depth; ``max_pages`` stops the crawl, nearer and better pages
    first. Only URLs that have a page are followed further, all are counted. Each wave writes its own URLs only."""
    waves = [materialize(start.select("url", "depth"))]
    visited, count = waves[0], waves[0].count() if max_pages else 0
    for _ in range(max_depth):
        found = link_candidates(waves[-1], edges).filter(wanted(F.col("url"), include, exclude))
        wave = materialize(unseen(found, visited).select("url", "depth"))
        if wave.isEmpty():
            break
        waves.append(wave)
        visited = visited.unionByName(wave)
        if max_pages:
            count += wave.count()
            if count >= max_pages:
                return visited.orderBy("depth", "url").limit(max_pages)
    return visited


def within_limits(candidates: DataFrame, max_pages: int, max_depth: int) -> DataFrame:
    """(task, url, depth, hint, place): what a task still fetches. Pages count against ``max_pages`` in the order of
    ``place`` and may lie ``max_depth`` deep, 0 for any; attached files, which have a hint, are exempt from both."""
    page = F.coalesce(F.col("hint"), F.lit("")) == ""
    deep = page & (F.lit(max_depth) > 0) & (F.col("depth") > max_depth)
    number = F.sum((page & ~deep).cast("int")).over(Window.partitionBy("task").orderBy("place", "url"))
    return candidates.withColumn("_n", number).filter(~page | (~deep & (F.col("_n") <= max_pages))).drop("_n")


def crawl_stats(events: DataFrame, task: str, status: str, max_pages: int | None = None) -> DataFrame:
    """Counts for each task, whether it is done, how it ended and why. A task without a scraped page fails; one
    that has reached ``max_pages`` and has nothing in flight is done with pages still queued."""
    n = lambda s: F.count(F.when(F.col(status) == s, 1)).alias(s)
    out = events.groupBy(task).agg(*[n(s) for s in ("queued", "rendering", "parsed", "batched", "failed")])
    full = F.lit(False) if max_pages is None else F.col("batched") + F.col("parsed") >= max_pages
    done = ((F.col("queued") + F.col("rendering") + F.col("parsed")) == 0) | (full & (F.col("rendering") == 0))
    end = F.when(~done, "RUNNING").when(F.col("batched") + F.col("parsed") == 0, "FAILED").otherwise("COMPLETED")
    why = F.when(end == "FAILED", "INTERNAL_ERROR").when(end == "COMPLETED", F.when(full, "MAX_PAGES_REACHED").otherwise("FRONTIER_EMPTY"))
    return out.withColumn("done", done).withColumn("state", end).withColumn("reason", why)


def crawled_page(parsed: DataFrame, source_page_url: Column) -> DataFrame:
    """The parser's page as the crawler passes it on: the same fields in the crawler's order, nested rows with theirs
    only, and the page it was found on; an empty origin is none."""
    cut = lambda c, fs: F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in fs])).alias(c)
    origin = F.when(source_page_url != "", source_page_url).alias("source_page_url")
    return parsed.select(
        "url", "title", "description", "preview_url", "icon_url", "language", "last_modified", origin,
        cut("blocks", ["html_id", "type", "heading_level", "text"]),
        cut("links", ["href", "type", "anchor_text", "context_block_id", "position", "snippet"]),
        cut("documents", ["url", "mime_type", "size_bytes", "extracted_text", "description", "description_source"]),
    )
