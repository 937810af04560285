"""Near-duplicate pages with small edits (problem 4).

A page is the set of its distinct runs of three words. Two pages belong together when the runs in both sets are at
least ``tenths`` / 10 of those in either, that is, of the union. The join is an exact prefix filter: under one fixed order
of all runs, rare ones first, two such pages must share ``k`` of the first ``n - ceil(tenths * n / 10) + k`` runs of each.
Only these meet in the shuffle; the pairs that share enough are then compared in full, so nothing is lost.

The order is by exact page counts of all runs, whatever their number. Chunks of pages send their distinct runs to hash
ranges, as packed differences; a range counts each run and sends one byte a run back. A run of one page alone can't be
shared: it counts in the prefix but isn't sent on, so a page with text of its own drops out before the join.

Vantage-point trees over fingerprints were tried first and give this result only by comparing all pairs; the
README has the figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, release
from . import textkernel as tk

RUN = 3
#: Runs that two prefixes must share. Prefixes are longer by as many, so that similar sets always do.
SHARED = 4
#: Runs in a chunk of pages that is counted together, and in a hash range of the count.
CHUNK, RANGE = 1 << 21, 1 << 22
#: Bits of a run that the count goes by; runs that agree in them only share a place in the order.
BITS = 48
#: Pairs compared in one cell, and pages of a class in one block of its pairs.
CELL, BLOCK = 4096, 1024

_PAGES = "chunk long, page_id string, sig long, n int, words array<int>"
_hashes = tk.Hashes()


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's words as 32-bit hashes: what has to travel of its text."""
    find = tk.word_runs().findall
    for b in batches:
        every, begins = tk.flat([find(t) if t else [] for t in b.column("text").to_pylist()])
        h = np.fromiter(map(_hashes.__getitem__, every), np.uint64, len(every))
        words = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("page_id", "ord", "id")] + [words], names=["page_id", "ord", "id", "words"])


def _runs(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit runs of each text, sorted, and where each text's begin, with the end."""
    values, at = tk.shingles(words.view(np.uint32).astype(np.uint64), begins, RUN)
    own = np.repeat(np.arange(len(begins) - 1), np.diff(at))
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    keep = np.repeat(np.diff(begins) >= RUN, np.diff(at))[order]
    keep[1:] &= (own[1:] != own[:-1]) | (values[1:] != values[:-1])
    own, values = own[keep], values[keep]
    return values, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(begins) - 1))])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values in a row, and where each list begins, with the end."""
    begins = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[begins[0] : begins[-1]], begins - begins[0]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by page and order, to one row a page with its words and a signature of its set."""
    from pyspark import TaskContext

    chunk, filled = TaskContext.get().partitionId() << 32, 0

    def rows(pages: list[str], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        nonlocal chunk, filled
        joined = [np.concatenate([np.zeros(0, np.int32), *p]) for p in parts]
        begins = np.concatenate([[0], np.cumsum([len(p) for p in joined])]).astype(np.int64)
        words = np.concatenate([np.zeros(0, np.int32), *joined])
        runs, at = _runs(words, begins)
        sizes = np.diff(at)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(runs), dtype=np.uint64)])
        sig = tk.mix((sums[at[1:]] - sums[at[:-1]]) ^ sizes.astype(np.uint64))
        if filled and filled + len(runs) > CHUNK:
            chunk, filled = chunk + 1, 0
        filled += len(runs)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(pages), chunk)), pa.array(pages, pa.string()), pa.array(tk.signed(sig)), pa.array(sizes.astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(words))],
            names=["chunk", "page_id", "sig", "n", "words"],
        )

    open_page, own, last = None, [], None
    for b in batches:
        pages, parts = [], []
        values, cuts = _lists(b.column("words"))
        for i, (page, block) in enumerate(zip(b.column("page_id").to_pylist(), b.column("id").to_pylist())):
            if page != open_page:
                if open_page is not None:
                    pages.append(open_page)
                    parts.append(own)
                open_page, own, last = page, [], None
            if block != last or block is None:
                own.append(values[cuts[i] : cuts[i + 1]])
            last = block
        if pages:
            yield rows(pages, parts)
    if open_page is not None:
        yield rows([open_page], [own])


def page_sets(blocks: DataFrame) -> DataFrame:
    """(chunk, page_id, sig, n, words): each page's words in order, as hashes, and the size ``n`` of its set of runs of three.

    Equal sets have equal ``sig``; a chunk is a bounded number of pages that are counted together. The words' 32 bits make
    two different words equal with a chance of 2^-32; the runs are kept in 64.
    """
    words = blocks.select("page_id", "ord", "id", "text").filter("page_id is not null")
    ordered = words.mapInArrow(_block_words, "page_id string, ord int, id string, words array<int>")
    ordered = ordered.repartition("page_id").sortWithinPartitions("page_id", "ord", "id")
    return ordered.mapInArrow(_sets, _PAGES).filter("n > 0")


def _short(runs: np.ndarray) -> np.ndarray:
    return runs >> np.uint64(64 - BITS)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The batches of pages of each chunk; rows of a chunk are neighbours."""
    now, own = None, []
    for b in batches:
        chunks = b.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if chunks[x] != now:
                if own:
                    yield now, own
                now, own = int(chunks[x]), []
            own.append(b.slice(x, y - x))
    if own:
        yield now, own


def _told(ranges: int):
    """Pages to (chunk, range, runs): the distinct runs of each chunk's different sets with the number of these, packed."""
    width = (1 << BITS) // ranges + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, own in _chunk_rows(batches):
            seen: dict[int, None] = {}
            parts = []
            for b in own:
                fresh = [i for i, s in enumerate(b.column("sig").to_pylist()) if s not in seen and seen.setdefault(s) is None]
                words, begins = _lists(b.column("words").take(pa.array(fresh, pa.int64())))
                parts.append(_short(_runs(words, begins)[0]))
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            cuts = np.searchsorted(values, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), chunk)), pa.array(some.astype(np.int32)),
                 pa.array([tk.packed(np.diff(values[cuts[i] : cuts[i + 1]], prepend=np.uint64(0))) for i in some], pa.binary()),
                 pa.array([np.minimum(counts[cuts[i] : cuts[i + 1]], 65535).astype(np.uint16).tobytes() for i in some], pa.binary())],
                names=["chunk", "range", "runs", "counts"],
            )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range are neighbours: to (chunk, range, codes), for each run sent twice the binary logarithm of its count."""

    def answer(now: int, chunks: list[int], runs: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        parts = [np.cumsum(tk.unpacked(r), dtype=np.uint64) for r in runs]
        every = np.concatenate(parts)
        values, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(counts), np.uint16))
        codes = np.round(2 * np.log2(total[at])).astype(np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int64()), pa.array([now] * len(chunks), pa.int32()), pa.array([codes[e - len(p) : e].tobytes() for e, p in zip(ends, parts)], pa.binary())],
            names=["chunk", "range", "codes"],
        )

    now, own = None, ([], [], [])
    for b in batches:
        for chunk, range_, runs, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "range", "runs", "counts"))):
            if range_ != now:
                if own[0]:
                    yield answer(now, *own)
                now, own = range_, ([], [], [])
            for to, x in zip(own, (chunk, runs, counts)):
                to.append(x)
    if own[0]:
        yield answer(now, *own)


def _prefixes(tenths: int):
    """A chunk's codes in the order of ranges, then its pages, to (sig, n, place, run): each set's prefix without the runs
    that no other set has. A set whose prefix has none left is similar to no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _chunk_rows(batches):
            codes = np.frombuffer(b"".join(c for b in own for c in b.column("codes").to_pylist() if c is not None), np.uint8)
            pages = pa.Table.from_batches([b.filter(b.column("sig").is_valid()) for b in own]).combine_chunks().to_batches()
            if not pages:
                continue
            b = pages[0]
            seen: dict[int, None] = {}
            fresh = [i for i, s in enumerate(b.column("sig").to_pylist()) if s not in seen and seen.setdefault(s) is None]
            b = b.take(pa.array(fresh, pa.int64()))
            words, begins = _lists(b.column("words"))
            runs, at = _runs(words, begins)
            n = np.diff(at)
            own_code = codes[np.searchsorted(np.unique(_short(runs)), _short(runs))]
            page = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((runs, own_code, page))
            place = np.arange(len(runs)) - np.repeat(at[:-1], n)
            need = (tenths * n + 9) // 10
            keep = (place < np.repeat(n - need + np.minimum(SHARED, need), n)) & (own_code[order] > 0)
            alive = np.bincount(page[keep & (place <= np.repeat(n - need, n))], minlength=len(n)) > 0
            keep &= alive[page]
            sig = b.column("sig").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[page[keep]]), pa.array(n[page[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(tk.signed(runs[order][keep]))],
                names=["sig", "n", "place", "run"],
            )

    return run


def _prefix_rows(sets: DataFrame, tenths: int) -> DataFrame:
    total = sets.agg(F.sum("n")).first()[0] or 0
    told = sets.select("chunk", "sig", "words").mapInArrow(_told(max(1, -(-total // RANGE))), "chunk long, range int, runs binary, counts binary")
    codes = told.repartition("range").sortWithinPartitions("range").mapInArrow(_counted, "chunk long, range int, codes binary")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = codes.select("chunk", "range", "codes", none("long", "sig"), none("array<int>", "words"))
    both = both.unionByName(sets.select("chunk", none("int", "range"), none("binary", "codes"), "sig", "words"))
    both = both.repartition("chunk").sortWithinPartitions("chunk", F.col("range").asc_nulls_last())
    return both.mapInArrow(_prefixes(tenths), "sig long, n int, place int, run long").dropDuplicates(["sig", "run"])


def _similar(tenths: int):
    """A cell's sets, then its pairs, to the pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            found: list[tuple[int, int]] = []
            words, cuts = _lists(b.column("words").fill_null([]))
            for i, (cell, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "sig_a", "sig_b")))):
                if cell != now:
                    now, held = cell, {}
                if y is None:
                    held[x] = _runs(words[cuts[i] : cuts[i + 1]], np.array([0, cuts[i + 1] - cuts[i]]))[0]
                else:
                    p, q = held[x], held[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both * 10 >= tenths * (len(p) + len(q) - both):
                        found.append((x, y))
            x, y = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["sig_a", "sig_b"])

    return run


def _compared(met: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The candidate pairs that are similar. Pairs of one neighbourhood are compared together, so that a set travels once for
    all of them; a large neighbourhood is cut into a grid of cells."""
    ends = met.select(F.col("sig_a").alias("sig"), "sig_b").union(met.select("sig_b", "sig_a"))
    home = ends.groupBy("sig").agg(F.least("sig", F.min("sig_b")).alias("home"))
    homes = met.join(home.toDF("sig_a", "home"), "sig_a")
    size = homes.groupBy("home").agg(F.ceil(F.sqrt(F.count("*") / CELL)).alias("grid"))
    side = lambda c: F.pmod(F.xxhash64(c), F.col("grid"))
    pairs = materialize(homes.join(size, "home").select(F.xxhash64("home", side("sig_a"), side("sig_b")).alias("cell"), "sig_a", "sig_b"))
    need = pairs.select("cell", F.col("sig_a").alias("sig")).union(pairs.select("cell", "sig_b")).distinct()
    whole = sets.select("sig", "words").join(need.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"])
    have = need.join(whole, "sig").select("cell", F.col("sig").alias("sig_a"), F.lit(None).cast("long").alias("sig_b"), "words")
    both = have.unionByName(pairs.withColumn("words", F.lit(None).cast("array<int>")))
    both = both.repartition("cell").sortWithinPartitions("cell", F.col("sig_b").isNotNull())
    return both.mapInArrow(_similar(tenths), "sig_a long, sig_b long")


def similar_classes(sets: DataFrame, tenths: int = 7) -> DataFrame:
    """(sig_a, sig_b): pairs of different sets that share at least ``tenths`` / 10 of their union."""
    short = materialize(_prefix_rows(sets, tenths))
    a, b = (short.select("run", *[F.col(c).alias(f"{c}_{x}") for c in ("sig", "n", "place")]) for x in "ab")
    # of n_a and n_b runs, at least tenths / (10 + tenths) of their sum are in both
    need = F.ceil((F.col("n_a") + F.col("n_b")) * F.lit(tenths) / F.lit(10 + tenths))
    met = a.join(b, "run").filter((F.col("sig_a") < F.col("sig_b")) & (F.least("n_a", "n_b") * 10 >= F.greatest("n_a", "n_b") * tenths))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + SHARED - 1
    met = met.filter(left >= need).groupBy("sig_a", "sig_b", F.least(F.lit(SHARED), need).alias("least")).agg(F.count("*").alias("shared"))
    return _compared(materialize(met.filter("shared >= least").select("sig_a", "sig_b")), sets, tenths)


def near_page_pairs(blocks: DataFrame, tenths: int = 7) -> DataFrame:
    """(page_id_a, page_id_b), a < b: all pairs of pages whose sets of runs overlap enough.

    Pages with fewer than three words are in no pair; null texts count as empty; a block delivered twice counts
    once. Pages with equal sets are joined as classes and only expanded at the end, large ones in blocks.
    """
    sets = materialize(page_sets(blocks))
    pairs = materialize(similar_classes(sets, tenths))
    size = sets.groupBy("sig").agg(F.count("*").alias("c")).withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int"))
    size = materialize(size.select("sig", "c", "parts"))
    members = sets.select("page_id", "sig").join(size.filter("parts > 1").select("sig", "parts"), "sig", "left")
    members = members.select("page_id", "sig", F.coalesce(F.pmod(F.xxhash64("page_id"), "parts").cast("int"), F.lit(0)).alias("part"))
    same = size.filter("c > 1").select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"))
    every = pairs.unionByName(same)
    for x in "ab":
        parts = size.select(F.col("sig").alias(f"sig_{x}"), F.sequence(F.lit(0), F.col("parts") - 1).alias("_p"))
        every = every.join(parts, f"sig_{x}").withColumn(f"part_{x}", F.explode("_p")).drop("_p")
    every = every.filter("sig_a <> sig_b or part_a <= part_b")
    x, y = (members.select(F.col("page_id").alias(p), F.col("sig").alias(f"sig_{s}"), F.col("part").alias(f"part_{s}")) for p, s in (("x", "a"), ("y", "b")))
    first = every.join(x, ["sig_a", "part_a"]).alias("l")
    same_key = (F.col("l.sig_b") == F.col("r.sig_b")) & (F.col("l.part_b") == F.col("r.part_b"))
    ordered = (F.col("sig_a") != F.col("l.sig_b")) | (F.col("part_a") < F.col("l.part_b")) | (F.col("x") < F.col("y"))
    out = first.join(y.alias("r"), same_key & ordered)
    return out.select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b"))


def page_classes(blocks: DataFrame, tenths: int = 7, rounds: int = 30) -> DataFrame:
    """(page_id, class_id, links): each page with its group, the least page of its connected component.

    Links count the other sets that the page's own set is similar to. Labels spread by taking the least label of
    all neighbours and then that label's own label, so that long chains take few rounds; tables are written
    between rounds.
    """
    sets = materialize(page_sets(blocks))
    members = sets.groupBy("sig").agg(F.min("page_id").alias("least"))
    pairs = similar_classes(sets, tenths)
    edges = materialize(pairs.union(pairs.select("sig_b", "sig_a")).toDF("sig", "other"))
    labels = materialize(members.select("sig", F.col("least").alias("label")))
    for _ in range(rounds):
        near = edges.join(labels.toDF("other", "heard"), "other").groupBy("sig").agg(F.min("heard").alias("heard"))
        new = labels.join(near, "sig", "left").select("sig", F.least("label", F.coalesce("heard", "label")).alias("label"))
        root = labels.join(members, "sig").select(F.col("least").alias("label"), F.col("label").alias("up"))
        new = new.join(root.groupBy("label").agg(F.min("up").alias("up")), "label", "left")
        new = materialize(new.select("sig", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = new.join(labels.toDF("sig", "old"), "sig").filter("label <> old").limit(1).count()
        release(labels)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError("labels still change; give more rounds")
    links = edges.groupBy("sig").agg(F.count("*").alias("links"))
    out = sets.select("page_id", "sig").join(labels, "sig").join(links, "sig", "left")
    return out.select("page_id", F.col("label").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
