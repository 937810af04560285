"""Packed postings and their exact BM25 ranking, in Arrow batches.

Texts are numbered within parts of some thousand. A row of postings is all of a part for one term, or, with a null term, the part's
keys and lengths; so a posting travels as two small numbers, and no pair of query and text leaves its task unless it is among the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Most texts of a part, and words from which a part ends with its batch.
PART_TEXTS, PART_WORDS = 65_536, 4_000_000
#: Scores this close may be equal once rounded.
NEAR = 2e-6


def schema(key_type: str) -> str:
    return f"part long, term string, n int, total long, nos array<int>, tfs array<int>, keys array<{key_type}>, dls array<int>"


def _lists(offsets: np.ndarray, values: pa.Array | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def _part(part: int, keys: pa.Array, words: pa.ListArray, names: list[str]) -> Iterator[pa.RecordBatch]:
    n = len(keys)
    dls = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    del words
    terms = coded.dictionary
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    del coded
    at *= n
    at += np.repeat(np.arange(n, dtype=np.int32), dls)
    at.sort()
    first = np.flatnonzero(np.diff(at, prepend=-1))
    tfs = np.diff(np.append(first, len(at)))
    at = at[first]
    begins = np.searchsorted(at, np.arange(len(terms) + 1, dtype=np.int64) * n)
    none = lambda kind, k: pa.nulls(k, kind)
    ints, of_keys = pa.list_(pa.int32()), pa.list_(keys.type)
    yield pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), none(pa.string(), 1), pa.array([n], pa.int32()), pa.array([int(dls.sum())], pa.int64()), none(ints, 1), none(ints, 1), _lists(np.array([0, n]), keys), _lists(np.array([0, n]), dls)], names
    )
    k = len(terms)
    if k:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, part), pa.int64()), terms.cast(pa.string()), pa.array(np.diff(begins), pa.int32()), none(pa.int64(), k), _lists(begins, at % n), _lists(begins, tfs), none(of_keys, k), none(ints, k)], names
        )


def packed(words: DataFrame) -> DataFrame:
    """Texts (key, w) with their words to rows of ``schema``: n is the texts of a term in its part or all texts of the part, total
    the part's words."""
    kind = dict(words.dtypes)["key"]
    names = [x.split()[0] for x in schema(kind).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, texts, many = TaskContext.get().partitionId() << 24, [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            of = [pa.concat_arrays(t.column(c).chunks) for c in ("key", "w")]
            del t
            yield from _part(part, of.pop(0), of.pop(), names)
            pa.default_memory_pool().release_unused()  # the worker waits beside its executor for the next task

        for b in batches:
            if held and (texts + b.num_rows > PART_TEXTS or many >= PART_WORDS):
                yield from out()
                part, texts, many = part + 1, 0, 0
            if b.num_rows:
                held.append(b)
                texts, many = texts + b.num_rows, many + (pc.sum(pc.list_value_length(b.column("w"))).as_py() or 0)
        if held:
            yield from out()

    return words.select("key", "w").mapInArrow(run, schema(kind))


class _Group:
    """The postings of some parts, by term, with each posting's share of a score and each term's largest."""

    def __init__(self, rows: pa.Table, mean: float):
        whole = rows.filter(pc.is_null(rows["term"])).sort_by("part")
        self.keys = pa.concat_arrays([c.flatten() for c in whole["keys"].chunks])
        dl = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in whole["dls"].chunks]).astype(float)
        base = np.concatenate([[0], np.cumsum(whole["n"].to_numpy())])[:-1]
        rank = pc.sort_indices(self.keys, null_placement="at_start").to_numpy()
        self.place = np.empty(len(rank), np.int64)
        self.place[rank] = np.arange(len(rank))
        order = pc.sort_indices(pa.table({"term": rows["term"], "part": rows["part"]}), [("term", "ascending"), ("part", "ascending")])
        order = order.slice(0, len(order) - rows["term"].null_count)  # nulls come last
        own = rows.select(["term", "part", "n", "nos", "tfs"]).take(order)
        coded = own["term"].combine_chunks().dictionary_encode()
        self.terms = coded.dictionary
        n = own["n"].to_numpy().astype(np.int64)
        self.texts = _flat(own["nos"])
        self.texts += np.repeat(base[np.searchsorted(whole["part"].to_numpy(), own["part"].to_numpy())].astype(np.int32), n)
        tf = _flat(own["tfs"])
        del own
        self.share = (K1 * (1 - B + B * dl / mean))[self.texts]
        self.share += tf
        np.divide(tf, self.share, out=self.share)
        first = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1))
        ends = np.concatenate([[0], np.cumsum(n)])
        self.begins = np.concatenate([ends[first], ends[-1:]])
        self.most = np.maximum.reduceat(self.share, self.begins[:-1]) if len(first) else np.empty(0)
        self.sum = np.zeros(len(self.keys))

    def best(self, terms: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``n`` texts and their scores. Terms are added by what they can bring at most; once the terms that are left
        can't lift a new text among the best, only texts seen so far are scored further, and only while they can stay among them."""
        most = weights * self.most[terms]
        order = np.argsort(-most, kind="stable")
        left = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
        seen, i, total = [], 0, self.sum
        while i < len(order):
            a, b = self.begins[terms[order[i]]], self.begins[terms[order[i]] + 1]
            texts = self.texts[a:b]
            seen.append(texts[total[texts] == 0])
            total[texts] += weights[order[i]] * self.share[a:b]
            i += 1
            if i < len(order) and sum(map(len, seen)) >= n:
                found = np.concatenate(seen)
                seen, scores = [found], total[found]
                if left[i] < np.partition(scores, -n)[-n] - NEAR:
                    break
        found = np.concatenate(seen)
        scores = total[found]
        total[found] = 0.0
        while True:
            if len(found) > n:
                keep = scores + left[i] >= np.partition(scores, -n)[-n] - NEAR
                found, scores = found[keep], scores[keep]
            if i == len(order):
                break
            a, b = self.begins[terms[order[i]]], self.begins[terms[order[i]] + 1]
            texts = self.texts[a:b]
            at = np.minimum(np.searchsorted(texts, found), b - a - 1)
            scores = scores + np.where(texts[at] == found, weights[order[i]] * self.share[a:b][at], 0.0)
            i += 1
        first = np.lexsort((self.place[found], -np.round(scores, 6)))[:n]
        return found[first], scores[first]


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks] or [np.empty(0)]).astype(np.int32, copy=False)


def ranking(n: int, query_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For ``applyInArrow``: postings of a group of parts and queries (query_id, term, weight, mean) to the group's best ``n`` texts of each query."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, keys, scores = [], [], []
        if rows.num_rows and asked.num_rows:
            group = _Group(rows, asked["mean"][0].as_py())
            asked = asked.append_column("at", pc.index_in(asked["term"], group.terms))
            asked = asked.filter(pc.is_valid(asked["at"])).sort_by([("query_id", "ascending"), ("at", "ascending")])
            at, weights = asked["at"].to_numpy().astype(np.int64), asked["weight"].to_numpy()
            query = asked["query_id"].combine_chunks().dictionary_encode()
            begins = np.append(np.flatnonzero(np.diff(query.indices.to_numpy(), prepend=-1)), len(at))
            known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            for a, b in zip(begins[:-1], begins[1:]):
                same = at[a:b].tobytes() + weights[a:b].tobytes()
                if same not in known:
                    known[same] = group.best(at[a:b], weights[a:b], n)
                found, score = known[same]
                ids.append(np.full(len(found), a))
                keys.append(found)
                scores.append(score)
            texts = group.keys
            del group
            pa.default_memory_pool().release_unused()
        if not ids:
            kind = rows.schema.field("keys").type.value_type
            return pa.table({"query_id": pa.nulls(0, query_type), "key": pa.nulls(0, kind), "score": pa.nulls(0, pa.float64())})
        return pa.table({"query_id": asked["query_id"].take(np.concatenate(ids)), "key": texts.take(pa.array(np.concatenate(keys))), "score": np.concatenate(scores)})

    return run
