"""The main body of pages, by wrappers inferred from the token streams of each host's pages (problem 5).

Union-free regular-expression inference: a page is a stream of tokens, its lines cut at separators into segments, in which names
and numbers are masked. The pages of a host are dealt to chunks. A chunk's pages are aligned with its wrapper one
after the other: the longest run of tokens in the wrapper's order is matched; what only one side has becomes optional; a token
that follows itself becomes a repeated group; lines that differ in their text but share a constant beginning, a
form of title, or all but their first word resolve into a text slot. Wrappers of chunks are merged by host, and those of hosts
once more, so that what a host shows on few pages is known from other hosts.

An expression belongs to a wrapper when it recurs on enough of a host's pages, fewer where the alignment finds it in its place,
or in the wrappers of enough hosts; headings and
slots that also open sentences inside paragraphs are content. At last, lines are compared with known furniture word by word without
letter case, as names can't be told in a line in capitals: with all that fits wrappers of many hosts, and their own host's.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize
from . import textkernel as tk

#: An expression is furniture on this share of all sites and at least on so many, or on so many pages of one site.
SITE_SHARE, LEAST_SITES = 0.01, 4
LEAST_PAGES = 12
#: Pages of one site from which an expression that keeps its place in the order of the wrapper is furniture.
LEAST_ALIGNED = 8
#: Pages of one host that are aligned with each other in one chunk.
CHUNK = 64
#: Share of a form's lines that are headings from which it is a heading's form; below, it isn't.
HEADING = 0.6
#: Share of a prefix's occurrences inside paragraphs from which it is a sentence's beginning.
INNER = 0.05

_separator = re.compile(r"\s[|/>»›•·]\s|\s[—–]\s")
_prefix = re.compile(r"[^\w\n]*((?:[^\W_]+[\s'’-]+){0,3}[^\W_]+)\s?([:.!])\s+(?=\S+\s+\S)")
_inner = re.compile(r"[.!?…]\s+((?:[^\W_]+[\s'’-]+){0,3}[^\W_]+)\s?:\s")
_before_colon = re.compile(r"(?<![\w'’-])([^\W_][\w'’-]*(?:\s+[^\W_][\w'’-]*){1,4})\s?:(?=\s)")
_cut_off = re.compile(r"(?:\[(?:\.\.\.|…)\]|…|\.\.\.|→|»|›|>>)\s*$")
_words = tk.MaskedHashes()
_NUMBER = 0x2545F4914F6CDD1D
_NONE = (None, None, None, None)
_SCHEMA = "page_key string, block_no int, host string, heading boolean, t1 long, t2 long, p long, m array<long>, h long, a long, line_no int, seg int, plain boolean"


class _Tokens(tk.MaskedHashes):
    def make(self, word: str) -> int:
        return _NUMBER if word[0].isdigit() else super().make(word)


_tokens = _Tokens()


def _title_form(line: str) -> str | None:
    """The word that opens a title of the form word, names, colon, wherever it stands in the line."""
    for m in _before_colon.finditer(line):
        words = m.group(1).split()
        if line.isupper():
            return words[-3].lower() if len(words) >= 3 else None
        n = len(words)
        while n and words[n - 1][:1].isupper():
            n -= 1
        if len(words) - n >= 2:
            return words[n].lower()
    return None


def _key(text: str, kind: str) -> int:
    return tk.hash64(f"{kind}\x00{text}") >> 1


def _line_keys(line: str) -> tuple[int | None, list[int] | None, int | None]:
    """The line's prefix, the sentence beginnings inside it, and its title form."""
    p = m = h = None
    if ": " in line or ":\xa0" in line or line.endswith(":"):
        form = _title_form(line)
        h = _key(form, "h") if form else None
        m = [_key(_named(x), "p") for x in _inner.findall(line)] or None
    found = _prefix.match(line)
    if found and h is None and (found.group(2) != "." or len(found.group(1).split()) <= 3):
        p = _key(_named(found.group(1)), "p")
    return p, m, h


def _named(words: str) -> str:
    """A prefix in lower case with its names, after the first word, masked."""
    first, *rest = words.split()
    return " ".join([first.lower(), *("~" if w[:1].isupper() and w[1:].islower() else w.lower() for w in rest)])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment of each line, with the keys of its expressions and of its line's."""
    find = tk.word_runs().findall
    for b in batches:
        rows, numbers, segs, words, keys, ends, second = [], [], [], [], [], [], []
        blank = []
        for i, text in enumerate(b.column("text").to_pylist()):
            before, n = None, len(rows)
            for line_no, line in enumerate((text or "").split("\n")):
                line = line.strip()
                if not any(map(str.isalpha, line)):
                    continue
                p, m, h = _line_keys(line)
                if before is not None and h is None and _cut_off.search(line):
                    h = before  # the cut-off text of the teaser above
                else:
                    before = h
                parts = _separator.split(line) if any(c in line for c in "|/>»›•·—–") else [line]
                own = [w for w in map(find, parts) if w]
                for ws in own:
                    while len(ws) > 1 and ws[-1].isdigit():
                        ws.pop()
                    rows.append(i)
                    numbers.append(line_no)
                    segs.append(len(rows) - n)
                    words.append(ws)
                    keys.append((p, m, h, _key(" ".join("0" if w[0].isdigit() else w.lower() for w in ws), "a")))
                    ends.append(tk.hash64(ws[0].lower()) if not ws[0].isdigit() else _NUMBER)
                    second.append(len(ws) > 1 and ws[0][:1].isupper() and ws[1][:1].isupper() and ws[1][1:].islower())
            if len(rows) == n:
                blank.append(i)
        every, begins = tk.flat(words)
        h = np.fromiter(map(_tokens.__getitem__, every), np.uint64, len(every))
        first = begins[:-1]
        t = []
        for masked in (False, True):
            x = h.copy()
            x[first] = tk.NAME if masked else np.array(ends, np.uint64)  # the first word may be a name
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != tk.NAME) | (x[:-1] != tk.NAME)
            keep[first] = True
            place = np.cumsum(keep)
            place = (place - np.repeat(place[first] if len(first) else place[:0], np.diff(begins))).astype(np.uint64)
            value = np.where(keep, tk.mix(x + place * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
            t.append(tk.mix(np.add.reduceat(value, first)) >> np.uint64(1) if len(first) else value)
            if masked:
                told = np.add.reduceat(((x != tk.NAME) & (x != np.uint64(_NUMBER))).astype(np.int64), first) if len(first) else x
        use = np.array(second, bool) & (told >= 2) if len(first) else np.zeros(0, bool)
        at = pa.array(rows + blank, pa.int64())
        pad = [_NONE] * len(blank)
        p, m, hh, a = zip(*(keys + pad)) if rows or blank else ([], [], [], [])
        none = pa.nulls(len(blank), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(c).take(at) for c in ("page_key", "block_no", "host", "heading")]
            + [
                pa.concat_arrays([pa.array(tk.signed(t[0])), none]),
                pa.concat_arrays([pa.array(tk.signed(t[1]), mask=~use), none]),
                pa.array(p, pa.int64()),
                pa.array(m, pa.list_(pa.int64())),
                pa.array(hh, pa.int64()),
                pa.array(a, pa.int64()),
                pa.array(numbers + [None] * len(blank), pa.int32()),
                pa.array(segs + [0] * len(blank), pa.int32()),
                pa.array([False] * len(rows) + [True] * len(blank), pa.bool_()),
            ],
            names=["page_key", "block_no", "host", "heading", "t1", "t2", "p", "m", "h", "a", "line_no", "seg", "plain"],
        )


def page_streams(blocks: DataFrame, scrapes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_key, block_no, host, heading, text): the blocks of pages and of scrapes.

    With ``pages``, a block without a site gets its page's.
    """

    def heading(kind: Column) -> Column:
        return F.coalesce(F.lower(kind) == "heading", F.lit(False)).alias("heading")

    own = blocks.filter("page_id is not null and ord is not null").select(
        F.concat(F.lit("page:"), "page_id").alias("page_key"), F.col("ord").alias("block_no"), F.col("source_id").alias("host"), heading(F.col("type")), "text"
    )
    if pages is not None:
        site = pages.filter("source_id is not null").select(F.concat(F.lit("page:"), "id").alias("page_key"), F.col("source_id").alias("host")).dropDuplicates(["page_key"])
        bare = own.filter("host is null").drop("host").join(site, "page_key", "left").select(own.columns)
        own = own.filter("host is not null").unionByName(bare)
    raw = scrapes.filter("scrape_id is not null").select("scrape_id", "source_id", F.posexplode("blocks").alias("no", "b"))
    raw = raw.select(
        F.concat(F.lit("scrape:"), "scrape_id").alias("page_key"), F.col("no").alias("block_no"), F.col("source_id").alias("host"), heading(F.col("b.type")), F.col("b.text").alias("text")
    )
    return own.unionByName(raw)


_ITEM = "host string, kind string, key long, place double, pages int, aligned int, lines long, headings long, inner long, least long, most long, optional boolean, repeated boolean"


class _Wrapper:
    """One chunk's wrapper: its constants in their order, and the slots found in mismatches."""

    def __init__(self):
        self.places: dict[int, float] = {}
        self.order: list[float] = []
        #: (kind, key) -> pages, lines, headings, inner, least and most filler
        self.counts: dict[tuple[str, int], list] = {}
        self.matched: dict[int, int] = {}
        self.repeated: set[int] = set()
        self.pages = 0

    def count(self, kind: str, key: int, lines: int, heading: int, inner: int, filler: int) -> None:
        c = self.counts.get((kind, key))
        if c is None:
            c = self.counts[kind, key] = [0, 0, 0, 0, filler, filler, -1]
        c[0] += c[6] != self.pages
        c[6] = self.pages
        c[1] += lines
        c[2] += heading
        c[3] += inner
        c[4] = min(c[4], filler)
        c[5] = max(c[5], filler)

    def align(self, page: list[tuple]) -> None:
        """Align a page (heading, t1, t2, p, m, h of each token in order) with what is known, and take it in."""
        places, line, before = self.places, [], None
        for token in page:
            heading, t1, t2, p, m, h = token
            self.count("t", t1, 1, heading, 0, t1)
            for kind, key in (("t", t2), ("p", p), ("h", h)):
                if key is not None:
                    self.count(kind, key, 1, heading, 0, t1)
            for key in m or ():
                self.count("p", key, 1, heading, 1, t1)
            if t1 == before:
                self.repeated.add(t1)
            else:
                line.append(t1)
            before = t1
        # the longest run of known tokens in the wrapper's order
        tails: list[float] = []
        ends: list[int] = []
        back: dict[int, int | None] = {}
        for i, t in enumerate(line):
            at = places.get(t)
            if at is not None:
                j = bisect_left(tails, at)
                back[i] = ends[j - 1] if j else None
                tails[j : j + 1] = [at]
                ends[j : j + 1] = [i]
        i, kept = ends[-1] if ends else None, set()
        while i is not None:
            kept.add(i)
            i = back[i]
        # tokens between two matched ones that are new to the wrapper go between these two
        low, gap = 0.0, []
        for i, t in enumerate([*line, None]):
            if t is None or i in kept:
                high = places[t] if t is not None else low + 2.0
                nxt = bisect_right(self.order, low)
                if nxt < len(self.order):
                    high = min(high, self.order[nxt])
                for k, g in enumerate(gap, 1):
                    places[g] = low + (high - low) * k / (len(gap) + 1)
                    insort(self.order, places[g])
                gap = []
                if t is not None:
                    low = places[t]
                    self.matched[t] = self.matched.get(t, 0) + 1
            elif t not in places and t not in gap:
                gap.append(t)
        self.pages += 1

    def items(self, host: str) -> list[tuple]:
        out = []
        for (kind, key), (pages, lines, headings, inner, least, most, _) in self.counts.items():
            at = self.places.get(key)
            place = None if at is None or kind != "t" else bisect_left(self.order, at) / len(self.order)
            aligned = 0 if place is None else self.matched.get(key, 0) + 1  # with the page that brought it in
            out.append((host, kind, key, place, pages, aligned, lines, headings, inner, least, most, self.matched.get(key, 0) + 1 < self.pages, key in self.repeated))
        return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens sorted by chunk, page and place, to the items of each chunk's wrapper."""
    fields = [x.split() for x in _ITEM.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}

    def rows(wrapper: _Wrapper, host: str) -> pa.RecordBatch:
        columns = list(zip(*wrapper.items(host)))
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])

    now, page, wrapper, tokens, last = None, None, _Wrapper(), [], None
    for b in batches:
        for host, chunk, key, block, seg, *token in zip(*(c.to_pylist() for c in b.columns)):
            if (host, chunk) != now or key != page:
                if tokens:
                    wrapper.align(tokens)
                tokens, page, last = [], key, None
                if (host, chunk) != now:
                    if now is not None:
                        yield rows(wrapper, now[0])
                    now, wrapper = (host, chunk), _Wrapper()
            if (block, seg) != last:  # a block delivered twice counts once
                tokens.append(tuple(token))
            last = (block, seg)
    if now is not None:
        if tokens:
            wrapper.align(tokens)
        yield rows(wrapper, now[0])


def host_wrappers(segments: DataFrame) -> DataFrame:
    """(kind, key, host, place, pages, aligned, lines, headings, inner, least, most, optional, repeated): each host's wrapper, an item for
    each constant (t) and text slot (p by its beginning, h by its title's form, t also all but the first word).

    ``place`` is the mean place of a constant in its wrapper, from 0 to 1; ``aligned`` counts the pages that have it there. ``least`` and ``most`` are fillers: they differ
    where a mismatch was resolved into the slot. A large host is many chunks, so no task sees all of it.
    """
    own = segments.filter("not plain and host is not null")
    size = own.groupBy("host").agg(F.ceil(F.approx_count_distinct("page_key") / CHUNK).alias("chunks"))
    own = own.join(broadcast_if_small(materialize(size)), "host")
    chunk = F.pmod(F.xxhash64("page_key"), F.greatest("chunks", F.lit(1))).cast("int").alias("chunk")
    order = ["host", "chunk", "page", "block_no", "seg"]
    tokens = own.select("host", chunk, F.xxhash64("page_key").alias("page"), "block_no", "seg", F.col("heading").cast("int").alias("heading"), "t1", "t2", "p", "m", "h")
    items = tokens.repartition("host", "chunk").sortWithinPartitions(*order).mapInArrow(_folded, _ITEM)
    sums = [F.sum(c).alias(c) for c in ("pages", "aligned", "lines", "headings", "inner")]
    return items.groupBy("kind", "key", "host").agg(
        F.avg("place").alias("place"), *sums, F.min("least").alias("least"), F.max("most").alias("most"), F.max("optional").alias("optional"), F.max("repeated").alias("repeated")
    )


def site_wrappers(segments: DataFrame) -> DataFrame:
    """(kind, key, host): the wrappers' expressions that are furniture, with host null for those of many hosts.

    Kinds: t - a segment's constants and slots, p - a prefix with a text slot, h - a title's form.
    """
    counts = materialize(host_wrappers(segments))
    sites = segments.filter("host is not null").select("host").distinct().count()
    least = max(LEAST_SITES, round(SITE_SHARE * sites))
    total = counts.groupBy("kind", "key").agg(
        F.count("*").alias("sites"), *[F.sum(c).alias(c) for c in ("lines", "headings", "inner")], F.min("least").alias("least"), F.max("most").alias("most")
    )
    total = total.filter("kind = 't' or least < most")
    kept = (
        F.when(F.col("kind") == "h", F.col("headings") >= HEADING * F.col("lines"))
        .when(F.col("kind") == "p", (F.col("headings") < HEADING * F.col("lines")) & (F.col("inner") <= INNER * F.col("lines")))
        .otherwise(F.col("headings") < HEADING * F.col("lines"))
    )
    everywhere = total.filter((F.col("sites") >= least) & kept).select("kind", "key", F.lit(None).cast("string").alias("host"))
    own = counts.filter((F.col("kind") == "t") & ((F.col("pages") >= LEAST_PAGES) | (F.col("aligned") >= LEAST_ALIGNED)) & (F.col("headings") < HEADING * F.col("lines")))
    own = own.select("kind", "key", "host")
    return materialize(everywhere.unionByName(own))


def _fitted(streams: DataFrame) -> DataFrame:
    """(page_key, block_no, line_no, fits): whether each segment fits the wrappers; a text without letters does, as no line."""
    segments = materialize(streams.mapInArrow(_segments, _SCHEMA))
    wrappers = site_wrappers(segments)

    def known(kind: str, name: str) -> DataFrame:
        return broadcast_if_small(wrappers.filter((F.col("kind") == kind) & F.col("host").isNull()).select(F.col("key").alias(name), F.lit(True).alias(f"is_{name}")))

    # a missing key gets a value of its own, which no wrapper has, so that a join that shuffles spreads these rows
    none = -1 - F.pmod(F.xxhash64("page_key", "block_no", "seg"), F.lit(1 << 62))
    out = segments.withColumns({c: F.coalesce(F.col(c), none) for c in ("t1", "t2", "p", "h")}).withColumn("host", F.coalesce("host", F.lit("")))
    for kind, name in (("t", "t1"), ("t", "t2"), ("p", "p"), ("h", "h")):
        out = out.join(known(kind, name), name, "left")
    own = wrappers.filter("host is not null").select("host", F.col("key").alias("t1"), F.lit(True).alias("is_own"))
    out = out.join(broadcast_if_small(own), ["host", "t1"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    free = ~F.col("heading")
    fits = yes(F.col("is_t1")) | yes(F.col("is_t2")) | yes(F.col("is_own")) | (free & (yes(F.col("is_p")) | yes(F.col("is_h")))) | F.col("plain")
    # a heading in a heading's form is content, however often it stands
    fits = fits & ~(F.col("heading") & yes(F.col("is_h")))
    wide = yes(F.col("is_t1")) | yes(F.col("is_t2")) | (free & (yes(F.col("is_p")) | yes(F.col("is_h"))))
    scope = lambda c: F.xxhash64(c, F.col("a"))
    out = out.select(
        "page_key", "block_no", "line_no", (F.col("heading") | F.col("a").isNull()).alias("bare"), fits.alias("fits"),
        scope(F.lit("")).alias("of_all"), scope(F.col("host")).alias("of_host"), wide.alias("wide"),
    )
    out = materialize(out)
    told = out.filter("fits and not bare").select(F.when(F.col("wide"), F.col("of_all")).otherwise(F.col("of_host")).alias("key")).distinct()
    told = materialize(told)
    other = out.filter("not fits and not bare")
    for name in ("of_all", "of_host"):
        other = other.join(broadcast_if_small(told.select(F.col("key").alias(name), F.lit(True).alias(f"is_{name}"))), name, "left")
    keep = ["page_key", "block_no", "line_no"]
    same = yes(F.col("is_of_all")) | yes(F.col("is_of_host"))
    return out.filter("fits or bare").select(*keep, "fits").unionByName(other.select(*keep, same.alias("fits")))


def furniture_blocks(streams: DataFrame) -> DataFrame:
    """(page_key, block_no): the blocks without any text of the main body.

    A block is dropped when all its segments fit the wrappers; a block with no letters has no main body and is
    dropped too. Blocks delivered twice count once; a missing site only means no site's own wrapper.
    """
    whole = _fitted(streams).groupBy("page_key", "block_no").agg(F.min("fits").alias("drop"))
    return whole.filter("drop").select("page_key", "block_no")


def main_body(streams: DataFrame) -> DataFrame:
    """(page_key, block_no, text, removed_lines): the main body of pages, block by block.

    Blocks that ``furniture_blocks`` gives are left out; of the others go the lines of which all segments fit the
    wrappers. Lines without letters stay. Blocks delivered twice count once.
    """
    kept = F.collect_set(F.when(~F.col("fits"), F.col("line_no")))
    lines = _fitted(streams).groupBy("page_key", "block_no").agg(F.array_except(F.collect_set("line_no"), kept).alias("_gone"), F.min("fits").alias("_drop"))
    out = streams.dropDuplicates(["page_key", "block_no"]).join(lines.filter("not _drop"), ["page_key", "block_no"])
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.size("_gone") > 0, F.array_join(left, "\n")).otherwise(F.col("text"))
    return out.select("page_key", "block_no", text.alias("text"), F.size("_gone").alias("removed_lines"))
