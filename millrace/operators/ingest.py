"""Ingestion: chunks, delta sync, events, upserts and index maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import normalize_for_store

LEAST, MOST = 100, 1000


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\s\x0B\x{85}\p{Z}]"), F.lit(False))


def _cut(text: str, most: int) -> list[str]:
    """Pieces that end after the last ". " in reach, or hard at ``most``; a piece may be one longer."""
    out, start = [], 0
    while start < len(text):
        hard = min(start + most, len(text))
        end = hard
        if hard < len(text):
            stop = text.rfind(". ", 0, hard + 1)
            if stop > start:
                end = stop + 2
        out.append(text[start:end])
        start = end
    return out


def split_chunks(blocks: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(page_id, idx, part, type, html_id, heading_level, text). A page of one block, or with all blocks in range,
    stays as it is; elsewhere blocks over ``most`` are cut, and only the first piece keeps the html id."""
    page = Window.partitionBy("page_id")
    bad = not_blank(F.col("text")) & ~F.length("text").between(least, most)
    touch = (F.count("*").over(page) > 1) & (F.max(bad.cast("int")).over(page) == 1)
    marked = blocks.select("page_id", "idx", "type", "html_id", "heading_level", "text", touch.alias("touch"))
    fields = ["page_id", "idx", "part", "type", "html_id", "heading_level", "text", "touch"]
    whole = marked.filter((~F.col("touch")) | (F.length("text") <= most)).withColumn("part", F.lit(0)).select(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(text=[_cut(t, most) for t in b["text"]])
            b["part"] = [list(range(len(t))) for t in b["text"]]
            b = b.explode(["text", "part"], ignore_index=True)
            b["part"] = b["part"].astype("int32")
            b.loc[b["part"] > 0, "html_id"] = None
            yield b[fields]

    kinds = dict(marked.dtypes) | {"part": "int"}
    cut = marked.filter(F.col("touch") & (F.length("text") > most)).mapInPandas(run, ", ".join(f"{f} {kinds[f]}" for f in fields))
    return whole.unionByName(cut)


def merge_short_chunks(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """In pages that were cut, a later piece under ``least`` goes to the piece before, after a space."""
    order = Window.partitionBy("page_id").orderBy("idx", "part")
    first = F.row_number().over(order) == 1
    starts = first | ~F.col("touch") | (F.length("text") >= least)
    out = chunks.withColumn("_g", F.sum(starts.cast("int")).over(order))
    out = out.groupBy("page_id", "_g").agg(F.array_sort(F.collect_list(F.struct("idx", "part", "type", "html_id", "heading_level", "text"))).alias("b"))
    head = F.element_at("b", 1)
    return out.select(
        "page_id",
        (F.col("_g") - 1).cast("int").alias("idx"),
        head["type"].alias("type"),
        head["html_id"].alias("html_id"),
        head["heading_level"].alias("heading_level"),
        F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"),
    )


def content_hash(*columns: str) -> Column:
    """One hash over all columns; nulls and empty texts differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changed_pages(scanned: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """The scanned pages (url, hash, ...) that are new, changed, or forced."""
    known = stored.select("url", F.col("hash").alias("_old"))
    out = scanned.join(known, "url", "left")
    return (out if force else out.filter(F.col("_old").isNull() | (F.col("_old") != F.col("hash")))).drop("_old")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key; incoming rows win ties."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc()))
    return both.withColumn("_n", last).filter("_n = 1").drop("_n", "_new")


def update_fields(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A stored row takes ``fields`` from the incoming row of its key and keeps all else; new keys are added, with nulls
    for what they don't bring. Both sides have one row for each key."""
    given = incoming.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_in_{f}") for f in fields], F.lit(True).alias("_given"))
    both = stored.join(given, stored[key] == F.col("_key"), "full_outer")
    new = F.coalesce("_given", F.lit(False))
    columns = [F.when(new, F.col(f"_in_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.coalesce(F.col(c), F.col("_key")).alias(c) if c == key else F.col(c) for c in stored.columns]
    return both.select(*columns)


def upsert_sources(stored: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """Adds or updates sources by id where one is given, which must be stored, else by the raw URL as stored; URLs are
    normalized on writing. Gives (id, source_url, fields..., action): update, insert, or unknown for an id nobody has."""
    kept = stored.select(F.col("id").alias("_id"), F.col("source_url").alias("_url"))
    by_id = incoming.filter("id is not null").join(kept.select("_id"), F.col("id") == F.col("_id"), "left")
    by_id = by_id.select("*", F.when(F.col("_id").isNull(), "unknown").otherwise("update").alias("action"))
    by_url = incoming.filter("id is null").join(kept, F.col("source_url") == F.col("_url"), "left")
    by_url = by_url.select("*", F.when(F.col("_id").isNull(), "insert").otherwise("update").alias("action")).withColumn("id", F.col("_id"))
    columns = ["id", normalize_for_store(F.col("source_url")).alias("source_url"), *fields, "action"]
    return by_id.select(*columns).unionByName(by_url.select(*columns))


def drop_bad_urls(rows: DataFrame, url: str) -> DataFrame:
    """Pages, links or files with their URL normalized; those whose URL can't be are left out."""
    return rows.withColumn(url, normalize_for_store(F.col(url))).filter(F.col(url).isNotNull())


def dispatch_events(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """The events (task_id, type, ...) of running tasks with what is done about them: store their pages, and complete
    or fail the task; unknown types are ignored. ``tasks`` (task_id, status) may be static beside a stream of events."""
    running = tasks.filter("status = 'RUNNING'").select("task_id").distinct()
    kind = F.col("type")
    action = F.when(kind == "TASK_COMPLETED", "COMPLETED").when(kind == "TASK_FAILED", "FAILED").when(kind == "PAGE_BATCH", "RUNNING").otherwise("IGNORED")
    return events.join(running, "task_id").select("*", kind.isin("TASK_COMPLETED", "PAGE_BATCH").alias("stores_pages"), action.alias("leads_to"))


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, status, finished_at) by the events (task_id, type, ts): a task runs until its first completion or failure
    and then stays as it is."""
    end = F.col("type").isin("TASK_COMPLETED", "TASK_FAILED")
    first = F.min(F.when(end, F.struct("ts", "type"))).alias("end")
    out = events.groupBy("task_id").agg(first)
    status = F.when(F.col("end").isNull(), "RUNNING").when(F.col("end.type") == "TASK_COMPLETED", "COMPLETED").otherwise("FAILED")
    return out.select("task_id", status.alias("status"), F.col("end.ts").alias("finished_at"))


def index_vectors(texts: DataFrame, embed) -> DataFrame:
    """(key, values): each text's vector under the text's own key, so nothing is matched by position."""
    return embed(texts)


def child_diff(existing: DataFrame, candidates: DataFrame, parent: str, content: list[str]) -> DataFrame:
    """(parent, content..., action): equal rows of both sides are matched copy by copy; unmatched existing rows are
    deleted, unmatched candidates inserted. Numbering the copies makes the multiset a join key. Where existing rows have an
    ``id``, it is given for kept and deleted rows, and the least ids are kept."""
    own = ["id"] if "id" in existing.columns and "id" not in (parent, *content) else []
    by = Window.partitionBy(parent, *content)
    keys = [parent, *content, "_copy"]
    left = existing.select(parent, *content, *own).withColumn("_copy", F.row_number().over(by.orderBy(*(own or [F.lit(1)]))))
    right = candidates.select(parent, *content).withColumn("_copy", F.row_number().over(by.orderBy(F.lit(1))))
    left, right = left.withColumn("_l", F.lit(1)).alias("l"), right.withColumn("_r", F.lit(1)).alias("r")
    met = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full_outer")
    action = F.when(F.col("_l").isNull(), "insert").when(F.col("_r").isNull(), "delete").otherwise("keep")
    values = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in [parent, *content]]
    return met.select(*values, *[F.col(f"l.{c}") for c in own], action.alias("action"))


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Enabled sources never synced, or synced longer ago than their interval."""
    late = F.col("last_synced_at") + F.make_dt_interval(mins="interval_minutes") < now
    return sources.filter(F.col("enabled") & (F.col("last_synced_at").isNull() | late))


def index_texts(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, text) of all blocks and of the attached files that have text."""
    own = blocks.select(F.concat(F.lit("block:"), "id").alias("key"), "text")
    files = documents.filter(not_blank(F.col("extracted_text")))
    return own.unionByName(files.select(F.concat(F.lit("document:"), "id").alias("key"), F.col("extracted_text").alias("text")))


def valid_keys(pages: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Keys of children whose page exists."""
    ids = pages.select(F.col("id").alias("page_id")).distinct()
    keyed = [d.join(ids, "page_id", "left_semi").select(F.concat(F.lit(p), "id").alias("key")) for p, d in (("block:", blocks), ("document:", documents))]
    return keyed[0].unionByName(keyed[1]).distinct()


def stale_rows(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Index rows to delete."""
    return index.join(keys.select("key"), "key", "left_anti")


def live_rows(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Index rows to keep."""
    return index.join(keys.select("key"), "key", "left_semi")


def cascade_delete(gone: DataFrame, pages: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """Pages and their children without the sources in ``gone`` (source_id)."""
    left = pages.join(gone.select("source_id"), "source_id", "left_anti")
    ids = left.select(F.col("id").alias("page_id")).distinct()
    return left, *[c.join(ids, "page_id", "left_semi") for c in children]
