"""Splitting oversized texts at natural boundaries with overlap (problem 2).

Pointer doubling: every boundary of a text is joined to its farthest legal successor, the overlap included.
Squaring the successor table then marks all cuts of the greedy split in log2(boundaries) rounds instead of one
after another. The tables of all texts of an Arrow batch are squared together as flat arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A natural end: a line break, or white space right after a sentence's end.
NATURAL = re.compile(r"\n|\r(?!\n)|[\v\f\x1c-\x1e\x85  ]|(?<=[.!?…])\s")
SPACE = re.compile(r"\s")
#: A batch of texts is squared together up to so many characters.
BATCH_CHARS = 4_000_000


def _overlap_start(text: str, end: int, overlap: int) -> int:
    """The start of the piece after a cut at ``end``: a word's start near ``end - overlap``."""
    at = end - overlap
    if at <= 0 or text[at - 1].isspace():
        return max(at, 0)
    m = SPACE.search(text, at, at + overlap // 5)
    return m.end() if m else at


def _boundaries(text: str, limit: int, overlap: int) -> tuple[list[int], list[int], list[int], int]:
    """Natural ends, spaces and last-resort cuts of a text, the latter two only in long stretches; forced."""
    natural = [m.end() for m in NATURAL.finditer(text)]
    if not natural or natural[-1] != len(text):
        natural.append(len(text))
    room, forced, spaces, hard, last = limit - 2 * overlap, 0, [], [], 0
    for end in natural:
        if end - last > room:
            forced |= len(text[last:end].strip()) > limit
            inner, word = [m.end() for m in SPACE.finditer(text, last, end)], last
            spaces += inner
            for w in [*inner, end]:
                if w - word > room:
                    hard += range(word + limit // 20, w, limit // 20)
                word = w
        last = end
    return natural, spaces, hard, int(forced)


def cut_texts(texts: list[str], limit: int, overlap: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """The (begin, end) of every piece of every text, and whether a cut had to be forced in it."""
    natural, spaces, hard, nodes, starts, first, forced = [], [], [], [], [], [], []
    base, stops = 0, []
    for t in texts:
        n, s, h, f = _boundaries(t, limit, overlap)
        natural += [base + x for x in n]
        spaces += [base + x for x in s]
        hard += [base + x for x in h]
        own = [0, *sorted({*n, *s, *h})]
        first.append(len(nodes))
        nodes += [base + x for x in own]
        starts += [base + _overlap_start(t, x, overlap) for x in own]
        stops.append(base + len(t))
        forced.append(f)
        base += len(t) + limit + 1  # no successor crosses into the next text
    node, start, first = np.array(nodes), np.array(starts), np.array(first)
    until = np.repeat(np.array(stops), np.diff(np.append(first, len(nodes))))
    reach = np.minimum(start + limit, until)
    best = node.copy()
    for ends in (hard, spaces, natural):  # a better kind of boundary overrides
        if ends:
            ends = np.array(ends)
            far = ends[np.maximum(np.searchsorted(ends, reach, "right") - 1, 0)]
            best = np.where((far > node) & (far <= reach), far, best)
    best = np.where(reach == until, until, best)
    jump = np.searchsorted(node, best)
    after = jump.copy()
    marked = np.zeros(len(node), bool)
    marked[first] = True
    for _ in range(max(1, int(np.ceil(np.log2(len(node) + 1))))):
        marked[jump[marked]] = True
        jump = jump[jump]
    pieces: list[list[tuple[int, int]]] = [[] for _ in texts]
    own = np.searchsorted(first, np.flatnonzero(marked), "right") - 1
    for i, t in zip(np.flatnonzero(marked).tolist(), own.tolist()):
        if after[i] != i:
            at = int(node[first[t]])
            pieces[t].append((int(start[i]) - at, int(node[after[i]]) - at))
    return pieces, forced


def split_oversized(items: DataFrame, key: str = "item_key", text: str = "text", limit: int = 1000, overlap: int = 100) -> DataFrame:
    """(key string, piece_no int, begin int, end int, piece string, forced int) of every text over ``limit``.

    Sizes are code points after white space is trimmed at both ends; begin and end count in the trimmed text.
    ``forced`` is 1 on all pieces of a text in which a stretch between natural ends is over the limit.
    Null, empty, blank and short texts give no row. A key counts once. Other columns are not looked at.
    """
    if not 0 <= overlap <= limit // 4:
        raise ValueError("overlap must be between 0 and a quarter of limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(keys: list[str], texts: list[str]) -> pd.DataFrame:
            pieces, forced = cut_texts(texts, limit, overlap)
            rows = [
                (k, n, b, e, t[b:e], f)
                for k, t, ps, f in zip(keys, texts, pieces, forced)
                for n, (b, e) in enumerate(ps)
            ]
            return pd.DataFrame(rows, columns=["key", "piece_no", "begin", "end", "piece", "forced"])

        keys, texts, size = [], [], 0
        for b in batches:
            for k, t in zip(b["k"], b["t"]):
                t = t.strip()
                if len(t) > limit:
                    keys.append(k)
                    texts.append(t)
                    size += len(t)
                if size > BATCH_CHARS:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield done(keys, texts)

    wide = items.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    wide = wide.filter((F.length("t") > limit) & F.col("k").isNotNull()).dropDuplicates(["k"])
    schema = "key string, piece_no int, begin int, end int, piece string, forced int"
    return wide.mapInPandas(run, schema).withColumnRenamed("key", key)


def oversized_items(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_key, text) of the texts of page blocks and attached files."""

    def keyed(prefix: str, key: Column, text: Column) -> list[Column]:
        return [F.concat(F.lit(prefix), key).alias("item_key"), text.alias("text")]

    return blocks.select(*keyed("block:", F.col("id"), F.col("text"))).unionByName(
        documents.select(*keyed("document:", F.col("id"), F.col("extracted_text")))
    )
