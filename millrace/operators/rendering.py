"""Fetch results: error classes, retries and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def error_code(message: Column, is_timeout: Column) -> Column:
    """The first rule that fits; the network is the rest."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *xs: m.rlike("|".join(xs))
    return (
        F.when(F.coalesce(is_timeout, F.lit(False)) | has("timeout"), "TIMEOUT")
        .when(has("name_not_resolved", "connection_refused", "connection refused"), "NETWORK_ERROR")
        .when(has("aborted") & has("404"), "PAGE_NOT_FOUND")
        .when(has("403", "401"), "ACCESS_DENIED")
        .when(has("invalid url"), "INVALID_URL")
        .otherwise("NETWORK_ERROR")
    )


def http_code(status: Column) -> Column:
    """The class of an HTTP status; null for success."""
    return F.when(status == 404, "PAGE_NOT_FOUND").when(status.isin(401, 403), "ACCESS_DENIED").when(status >= 400, "NETWORK_ERROR")


def final_attempts(attempts: DataFrame, most: int = 4) -> DataFrame:
    """Each URL's deciding attempt: the first one that succeeds or fails for good, at most the fourth."""
    order = Window.partitionBy("url").orderBy("attempt")
    stop = F.col("code").isNull() | ~F.col("code").isin("TIMEOUT", "NETWORK_ERROR") | (F.col("attempt") >= most)
    before = F.max(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lead("attempt").over(order).isNull()
    return attempts.withColumn("_b", F.coalesce(before, F.lit(0))).withColumn("_s", stop | last).filter("_b = 0 and _s").drop("_b", "_s")


def document_kind(hint: Column) -> Column:
    """Which renderer a hint names; null for an unsupported one."""
    h = F.lower(hint)
    return F.when(h == "pdf", "pdf").when(h.isin("doc", "docx"), "docx").when(h.isin("xls", "xlsx"), "xlsx")


def parser_for(hint: Column) -> Column:
    """Attached files have their own parser."""
    return F.when((F.coalesce(hint, F.lit("")) != "") & (F.lower(hint) != "html"), "document").otherwise("html")


def scrape_responses(renders: DataFrame) -> DataFrame:
    """(task_id, url, success, html, code, metadata): failures pass on their code, a success without HTML is a parse
    error, metadata goes through as it is."""
    failed, empty = ~F.coalesce("success", F.lit(False)), F.trim(F.coalesce("html", F.lit(""))) == ""
    code = F.when(failed, F.coalesce("code", F.lit("NETWORK_ERROR"))).when(empty, "PARSE_ERROR")
    return renders.select("task_id", "url", code.isNull().alias("success"), F.when(code.isNull(), F.col("html")).alias("html"), code.alias("code"), "metadata")
