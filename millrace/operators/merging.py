"""Merge rules over a page's blocks.

Input: blocks (page_id, idx, type, text, html_id, heading_level, group_idx). The capped rules are sequential by
nature, so sorted Arrow batches are folded; headings and questions are islands and need only windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.text import word_count

SHORT, MOST, QUESTION = 30, 300, 40
FIELDS = ["type", "text", "html_id", "heading_level", "group_idx"]


def in_order() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("idx")


def _fold(blocks: DataFrame, joins: Callable[[dict, dict], bool], between: str, kind: Callable[[str, str], str] = lambda a, b: a) -> DataFrame:
    """Fold each page's blocks in order: a block joins the last one of the result, or follows it. The blocks of a page are
    neighbours in Arrow batches and one open block is held, so the work is linear and no page is gathered."""
    rows = blocks.select("page_id", "idx", *FIELDS, word_count(F.col("text")).alias("words"))
    types = dict(rows.dtypes)
    names = ["page_id", "idx", *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, place = None, [], 0
        for b in batches:
            out = []

            def close() -> None:
                if last is not None:
                    out.append((last["page_id"], place, last["type"], between.join(parts), *(last[f] for f in FIELDS[2:])))

            for x in b.to_pylist():
                if last is not None and x["page_id"] == last["page_id"] and joins(last, x):
                    last["type"] = kind(last["type"], x["type"])
                    last["words"] += x["words"]
                    parts.append(x["text"] or "")
                else:
                    close()
                    place = place + 1 if last is not None and x["page_id"] == last["page_id"] else 0
                    last, parts = x, [x["text"] or ""]
            if out:
                yield table(out)
        if last is not None:
            yield table([(last["page_id"], place, last["type"], between.join(parts), *(last[f] for f in FIELDS[2:]))])

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[types[f]] if f != "idx" else pa.int32()) for c, f in zip(zip(*out), names)], names=names)

    ordered = rows.repartition("page_id").sortWithinPartitions("page_id", "idx")
    return ordered.mapInArrow(run, ", ".join(f"{f} {'int' if f == 'idx' else types[f]}" for f in names))


def join_lists(blocks: DataFrame) -> DataFrame:
    """Neighbouring list items become one while they have at most 300 words."""
    return _fold(blocks, lambda a, b: a["type"] == b["type"] == "listItem" and a["words"] + b["words"] <= MOST, "\n")


def join_siblings(blocks: DataFrame, share: float = 0.4) -> DataFrame:
    """Neighbours of one group that holds at most 40 % of the page's blocks; headings stay."""
    page = Window.partitionBy("page_id")
    small = F.count("*").over(Window.partitionBy("page_id", "group_idx")) <= share * F.count("*").over(page)
    known = blocks.withColumn("group_idx", F.when((F.col("group_idx") >= 0) & small, F.col("group_idx")))

    def joins(a: dict, b: dict) -> bool:
        same = a["group_idx"] is not None and a["group_idx"] == b["group_idx"]
        return same and a["type"] != "heading" and b["type"] != "heading" and a["words"] + b["words"] <= MOST

    return _fold(known, joins, "\n").withColumn("group_idx", F.coalesce("group_idx", F.lit(-1)))


def absorb_headings(blocks: DataFrame) -> DataFrame:
    """Headings go before the next content block's text, one to a line; headings at the end are dropped."""
    content = (F.col("type") != "heading").cast("int")
    group = F.coalesce(F.sum(content).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = blocks.withColumn("_g", group).groupBy("page_id", "_g").agg(
        F.array_sort(F.collect_list(F.struct("idx", *FIELDS))).alias("b")
    )
    last = F.element_at("b", -1)
    level = F.element_at("b", 1)["heading_level"]
    out = grouped.filter(last["type"] != "heading").select(
        "page_id",
        F.col("_g").cast("int").alias("idx"),
        last["type"].alias("type"),
        F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"),
        last["html_id"].alias("html_id"),
        F.when(F.size("b") > 1, level).otherwise(last["heading_level"]).alias("heading_level"),
        last["group_idx"].alias("group_idx"),
    )
    return out


def pair_questions(blocks: DataFrame) -> DataFrame:
    """A short block that ends with a question mark takes the next block, unless that is a question too."""
    asks = (word_count(F.col("text")) <= QUESTION) & F.trim("text").rlike("[?？]$")
    out = blocks.withColumn("_q", asks)
    takes = F.col("_q") & ~F.coalesce(F.lead("_q").over(in_order()), F.lit(True))
    out = out.withColumn("_t", takes).withColumn("_next", F.lead("text").over(in_order())).withColumn("_gone", F.coalesce(F.lag("_t").over(in_order()), F.lit(False)))
    out = out.filter("not _gone")
    text = F.when(F.col("_t"), F.concat_ws("\n", "text", "_next")).otherwise(F.col("text"))
    kind = F.when(F.col("_t"), "paragraph").otherwise(F.col("type"))
    return out.withColumns({"text": text, "type": kind}).drop("_q", "_t", "_next", "_gone")


def join_short(blocks: DataFrame) -> DataFrame:
    """A block under 30 words takes the next ones, but headings, up to 300 words; a mix is a paragraph."""
    return _fold(
        blocks,
        lambda a, b: a["words"] < SHORT and b["type"] != "heading" and a["words"] + b["words"] <= MOST,
        "\n\n",
        lambda a, b: a if a == b else "paragraph",
    )


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """The rules in their order; html ids and levels over 0 survive."""
    out = join_short(pair_questions(absorb_headings(join_siblings(join_lists(blocks)))))
    level = F.when(F.col("heading_level") > 0, F.col("heading_level"))
    return out.select("page_id", "idx", "type", "text", "html_id", level.alias("heading_level"))
