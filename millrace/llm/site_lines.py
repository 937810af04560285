"""Lines repeated across one site's pages (problem 3).

Every line gets an exact key (its letters, lower-cased) and a few locality-sensitive buckets: numbers, dates
and names are masked, and the exact key, the hash of the masked line and four bands of four MinHash values over its
five-word shingles name the buckets within its site. A line shorter than five words is one shingle; a line of which names are more
than half has its exact key only. A bucket that stands on many pages is a cluster of near-duplicate lines. Lines in it that are not
repeated themselves are compared with the cluster's commonest line and go where their shingles are similar.

Pages of a bucket or key are counted in two steps, distinct pairs first, so that neither a site with a third of
all lines nor a menu on all its pages gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import textkernel as tk

SHINGLE, BANDS, ROWS = 5, 4, 4
#: Share of common shingles from which a line belongs to its cluster's commonest one.
SIMILAR = 0.8

_hashes = tk.MaskedHashes()


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with letters: their number, exact key, and the keys of their buckets."""
    find = tk.letter_runs().findall
    for b in batches:
        rows, numbers, words, exact, starts = [], [], [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            if text:
                for n, line in enumerate(text.split("\n")):
                    own = find(line)
                    if own:
                        rows.append(i)
                        numbers.append(n)
                        words.append(own)
                        starts.append(tk.hash64(own[0].lower()))
                        exact.append(tk.hash64("".join(own).lower()))
        every, begins = tk.flat(words)
        hashes = np.fromiter(map(_hashes.__getitem__, every), np.uint64, len(every))
        hashes[begins[:-1]] = np.array(starts, np.uint64)  # a line's first word is capitalised anyway
        values, at = tk.shingles(hashes, begins, SHINGLE)
        least = tk.minhash(values, at, BANDS * ROWS)
        keys = np.empty((len(rows), BANDS + 2), np.uint64)
        keys[:, 0] = np.array(exact, np.uint64)
        keys[:, 1] = tk.mix(np.add.reduceat(tk.mix(values), at[:-1])) if rows else 0
        for band in range(BANDS):
            h = np.full(len(rows), band + 1, np.uint64)
            for r in range(ROWS):
                h = tk.mix(h ^ least[:, band * ROWS + r]) + np.uint64(r)
            keys[:, band + 2] = h
        if rows:
            named = np.add.reduceat((hashes == tk.NAME).astype(np.int64), begins[:-1]) * 2 > np.diff(begins)
            keys[named, 1:] = keys[named, :1]
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                b.column("block_id").take(take),
                b.column("page_id").take(take),
                pa.array(numbers, pa.int32()),
                pa.array(tk.signed(keys[:, 0].copy())),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (BANDS + 2)), pa.array(tk.signed(keys.reshape(-1)))
                ),
            ],
            names=["block_id", "page_id", "line_no", "letters", "keys"],
        )


def site_lines(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(block_id, line_no, source_id, page, line_key, buckets): every line that has letters, with its page's site.

    A line's site is its page's ``source_id``; lines of pages that are missing or have no site are left out.
    """
    site = pages.select(F.col("id").alias("page_id"), "source_id").filter("source_id is not null").dropDuplicates(["page_id"])
    lines = blocks.select(F.col("id").alias("block_id"), "page_id", "text")
    lines = lines.mapInArrow(_line_features, "block_id string, page_id string, line_no int, letters long, keys array<long>")
    return lines.join(site, "page_id").select(
        "block_id",
        "line_no",
        "source_id",
        F.xxhash64("page_id").alias("page"),
        F.xxhash64("source_id", "letters").alias("line_key"),
        F.transform("keys", lambda x: F.xxhash64("source_id", x)).alias("buckets"),
    )


def repeated_lines(blocks: DataFrame, pages: DataFrame, min_pages: int = 8) -> DataFrame:
    """(block_id, line_no, source_id, page, pages, cluster, cluster_pages): lines of clusters on ``min_pages`` pages or more.

    ``pages`` counts the pages of the site with the same line (equal letters), ``cluster_pages`` those of its
    largest bucket. Null and empty texts and lines without letters give no row; blocks delivered twice count once.
    """
    lines = materialize(site_lines(blocks, pages))
    exact = lines.select("line_key", "page").distinct().groupBy("line_key").agg(F.count("*").alias("pages"))
    wide = lines.select(F.explode("buckets").alias("bucket"), "page").distinct()
    wide = wide.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    found = lines.select("line_key", F.explode("buckets").alias("bucket")).distinct().join(wide, "bucket")
    found = found.groupBy("line_key").agg(F.max(F.struct("n", "bucket")).alias("best"))
    found = found.join(exact, "line_key").select("line_key", "pages", F.col("best.bucket").alias("cluster"), F.col("best.n").alias("cluster_pages"))
    # a line on all pages of a site makes a skewed partition on the lines' side only, which adaptive execution splits by size
    out = lines.select("block_id", "line_no", "source_id", "page", "line_key").join(found, "line_key").dropDuplicates(["block_id", "line_no"])
    return out.select("block_id", "line_no", "source_id", "page", "pages", "cluster", "cluster_pages")


def _line_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block_id, line_no, shingles): the distinct shingles of the masked words of lines (block_id, line_no, text)."""
    find = tk.letter_runs().findall
    for b in batches:
        words = [find(t) if t else [] for t in b.column("text").to_pylist()]
        every, begins = tk.flat(words)
        hashes = np.fromiter(map(_hashes.__getitem__, every), np.uint64, len(every))
        some = np.flatnonzero(np.diff(begins))
        hashes[begins[some]] = np.array([tk.hash64(words[i][0].lower()) for i in some], np.uint64)
        values, at = tk.shingles(hashes, begins, SHINGLE)
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tk.signed(values)))
        yield pa.RecordBatch.from_arrays([b.column("block_id"), b.column("line_no"), lists], names=["block_id", "line_no", "shingles"])


def similar_lines(blocks: DataFrame, repeated: DataFrame, min_pages: int = 8) -> DataFrame:
    """The rows of ``repeated_lines`` that belong to their clusters: lines on ``min_pages`` pages themselves, and others that share
    ``SIMILAR`` of their shingles with the cluster's commonest line, if such a cluster still stands on ``min_pages`` pages."""
    repeated = materialize(repeated)
    weak = repeated.filter(F.col("pages") < min_pages)
    places = repeated.join(weak.select("cluster").distinct(), "cluster", "left_semi")
    first = places.groupBy("cluster").agg(F.max(F.struct("pages", "block_id", "line_no")).alias("r"))
    first = materialize(first.select("cluster", F.col("r.block_id").alias("block_id"), F.col("r.line_no").alias("line_no")))
    need = weak.select("block_id", "line_no").union(first.select("block_id", "line_no")).distinct()
    text = blocks.select(F.col("id").alias("block_id"), "text").dropDuplicates(["block_id"])
    line = F.get(F.split("text", "\n", -1), F.col("line_no")).alias("text")
    shingles = need.join(text, "block_id").select("block_id", "line_no", line).mapInArrow(_line_shingles, "block_id string, line_no int, shingles array<long>")
    shingles = materialize(shingles)
    heads = first.join(shingles, ["block_id", "line_no"]).select("cluster", F.col("shingles").alias("head"))
    met = weak.join(shingles, ["block_id", "line_no"]).join(heads, "cluster")
    both, union = F.size(F.array_intersect("shingles", "head")), F.size(F.array_union("shingles", "head"))
    close = met.filter(both >= SIMILAR * union).select(repeated.columns)
    kept = materialize(repeated.filter(F.col("pages") >= min_pages).unionByName(close))
    wide = kept.select("cluster", "page").distinct().groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return kept.join(wide.select("cluster"), "cluster", "left_semi").unionByName(
        kept.filter(F.col("pages") >= min_pages).join(wide.select("cluster"), "cluster", "left_anti")
    )


def same_lines(repeated: DataFrame, min_pages: int = 8) -> DataFrame:
    """(block_id, line_no int): of the clusters' lines, those whose own letters stand on ``min_pages`` pages."""
    return repeated.filter(F.col("pages") >= min_pages).select("block_id", F.col("line_no").cast("int").alias("line_no"))


def remove_lines(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """The blocks with the repeated lines taken out of ``text`` and their number in ``removed_lines``.

    A block that loses all its lines keeps the empty text; a null text stays null.
    """
    gone = repeated.groupBy("block_id").agg(F.collect_set("line_no").alias("_gone"))
    out = blocks.join(gone.withColumnRenamed("block_id", "_block"), F.col("id") == F.col("_block"), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.withColumns({"text": text, "removed_lines": F.coalesce(F.size("_gone"), F.lit(0))}).drop("_block", "_gone")
