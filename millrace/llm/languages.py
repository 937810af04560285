"""Languages of documents and of passages in them (problem 1).

Multilingual mixture inference. Every word has a likelihood under each language: a mixture of the language's
word frequencies, its character trigrams, and a model of invented or foreign names which all languages share, so
that names say nothing. Expectation-maximisation estimates each text's language proportions from these
likelihoods; a second language is accepted only where it raises the text's likelihood by more than a penalty.
Texts of several languages are then cut into passages by a Viterbi pass over the accepted languages, in which a
change of language costs less at a sentence's or quotation's end than inside one.

All texts of an Arrow batch are estimated together as flat arrays; counts of letters and the passages leave the workers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import textkernel as tk

ROUNDS = 8
#: Most labelled sentences that the model is fitted on, in the order of a hash.
MOST_SAMPLES = 100_000
#: Log-likelihood that each further language must add to a text's model.
PENALTY = 9.0
#: Cost of a change of language inside a sentence, and at the end of a sentence, line or quotation.
INSIDE, AT_END = 11.0, 3.0
#: Words that the Viterbi pass holds side by side, so that one very long text goes alone.
SIDE_BY_SIDE = 60_000
#: Words, over all texts, that a worker keeps likelihoods of.
CACHE = 300_000
_ENDS = '.!?…\n«»"“”„:;()[]'


class NgramModel:
    """Likelihoods of words under languages, fitted on labelled clean sentences."""

    def __init__(self, samples: list[tuple[str, str]]):
        find = tk.letter_runs().findall
        self.langs = sorted({lang for lang, _ in samples})
        k = len(self.langs)
        words: list[Counter] = [Counter() for _ in range(k + 1)]
        for own, lang in enumerate(self.langs):
            texts = [find(s) for x, t in samples if x == lang for s in re.split(r"(?<=[.!?])\s+", t)]
            inner = [w[0].isupper() for ws in texts for w in ws[1:]]
            nouns = sum(inner) > 0.25 * len(inner)  # where all nouns are capitalised, a capital doesn't make a name
            for ws in texts:
                for i, w in enumerate(ws):
                    words[k if i and w[0].isupper() and not nouns else own][w.lower()] += 1
        grams = [[Counter(), Counter(), Counter()] for _ in words]
        for own, counts in zip(grams, words):
            for w, n in counts.items():
                p = f"\x02\x02{w}\x03"
                for i in range(2, len(p)):
                    for j in range(3):
                        own[j][p[i - j : i + 1]] += n if counts is not words[k] else 1
        self.keys, self.rows = [], []
        for j in range(3):
            seen = sorted({g for own in grams for g in own[j]}, key=self._pack)
            self.keys.append(np.array([self._pack(g) for g in seen], np.int64))
            self.rows.append(np.array([[self._prob(own, g, j) for own in grams] for g in seen], np.float64).reshape(-1, k + 1))
        total = [max(1, sum(c.values())) for c in words]
        self.lexicon = {w: np.array([c[w] / t for c, t in zip(words[:k], total)]) for w in {w for c in words[:k] for w in c}}

    @staticmethod
    def _pack(gram: str) -> int:
        n = 0
        for c in gram:
            n = n << 21 | ord(c)
        return n

    @staticmethod
    def _prob(own: list[Counter], gram: str, j: int) -> float:
        """Interpolated probability of the gram's last character after those before it."""
        p = (own[0][gram[-1]] + 0.05) / (sum(own[0].values()) + 10)
        for m in range(1, j + 1):
            g = gram[-m - 1 :]
            p = (own[m][g] + 3.0 * p) / (own[m - 1][g[:-1]] + 3.0)
        return p

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, languages) log-likelihoods of lower-case words."""
        k = len(self.langs)
        padded = "".join(f"\x02\x02{w}\x03" for w in words)
        codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
        ends = np.cumsum(sizes)
        inner = np.ones(len(codes), bool)
        inner[ends - sizes] = inner[ends - sizes + 1] = False
        at = np.flatnonzero(inner)
        logs = np.full((len(at), k + 1), np.log(1e-4))
        open_ = np.ones(len(at), bool)
        for j in (2, 1, 0):
            key = np.zeros(len(at), np.int64)
            for m in range(j, -1, -1):
                key = key << 21 | codes[at - m]
            i = np.minimum(np.searchsorted(self.keys[j], key), len(self.keys[j]) - 1)
            hit = open_ & (self.keys[j][i] == key)
            logs[hit] = np.log(self.rows[j][i[hit]])
            open_ &= ~hit
            logs[open_] -= 0.7  # backing off
        first = np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])
        sums = np.add.reduceat(logs, first, axis=0)
        p = np.exp(np.maximum(sums, -200))
        own, name = p[:, :k], p[:, k:]
        known = np.zeros((len(words), k))
        for i, w in enumerate(words):
            if w in self.lexicon:
                known[i] = self.lexicon[w]
        return np.log(0.5 * known + 0.4 * own + 0.1 * name + 1e-60)


class _Vocabulary(dict):
    """word -> row of the likelihood table, which grows a batch at a time."""

    def __init__(self, model: NgramModel):
        self.model, self.new = model, []
        self.table = np.zeros((0, len(model.langs)))

    def __missing__(self, word: str) -> int:
        n = len(self.table) + len(self.new)
        self[word] = n
        self.new.append(word)
        return n

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
            self.table = self.table[:0]
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.table = np.concatenate([self.table, self.model.emissions([w.lower() for w in self.new])])
            self.new = []
        return codes


def _mixture(e: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for all texts together: proportions, and the log-likelihoods of the best single language and the mixture."""
    at, own = begins[:-1], np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    top = e.max(1, keepdims=True)
    p = np.exp(e - top)
    n = np.diff(begins)[:, None]
    single = np.add.reduceat(np.maximum(e - top, -25), at, axis=0)
    share = np.full((len(at), e.shape[1]), 1 / e.shape[1])
    for _ in range(ROUNDS):
        r = p * share[own]
        r /= r.sum(1, keepdims=True)
        share = np.add.reduceat(r, at, axis=0) / n
    mixed = np.add.reduceat(np.log((p * share[own]).sum(1) + 1e-300), at)
    return share, single, mixed


def _chosen(e: np.ndarray, begins: np.ndarray, best: np.ndarray) -> np.ndarray:
    """(texts, languages): each text's set, which starts with the best language and takes, one at a time, the language that
    raises the likelihood most, as long as that is by more than the penalty."""
    n, k = len(best), e.shape[1]
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), best] = True
    p, sets = np.exp(e), best[:, None]
    score = np.add.reduceat(e[np.arange(len(e)), np.repeat(best, np.diff(begins))], begins[:-1])
    live = np.arange(n)
    for _ in range(k - 1):
        if not len(live):
            break
        sizes = np.diff(begins)[live]
        at = np.concatenate([[0], np.cumsum(sizes)])
        words = np.repeat(begins[:-1][live] - at[:-1], sizes) + np.arange(at[-1])
        own = np.repeat(np.arange(len(live)), sizes)
        held = np.take_along_axis(p[words], sets[own], 1)
        gains = np.full((len(live), k), -np.inf)
        for x in range(k):
            both = np.column_stack([held, p[words, x]])
            share = np.full((len(live), both.shape[1]), 1 / both.shape[1])
            for _ in range(ROUNDS):
                part = both * share[own]
                part /= part.sum(1, keepdims=True)
                share = np.add.reduceat(part, at[:-1], axis=0) / sizes[:, None]
            gains[:, x] = np.add.reduceat(np.log((both * share[own]).sum(1) + 1e-300), at[:-1]) - score[live]
        gains[chosen[live]] = -np.inf
        new = gains.argmax(1)
        more = gains[np.arange(len(live)), new] > PENALTY
        score[live[more]] += gains[more, new[more]]
        chosen[live[more], new[more]] = True
        sets, live = np.column_stack([sets[more], new[more]]), live[more]
    return chosen


def _passages(e: np.ndarray, ends: np.ndarray, begins: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The language of every word: Viterbi over each text's accepted languages, many texts side by side."""
    out = np.zeros(len(e), np.int8)
    sizes = np.diff(begins)
    order, done = np.argsort(-sizes, kind="stable"), 0
    while done < len(order):
        group = order[done : done + max(1, SIDE_BY_SIDE // int(sizes[order[done]]))]
        done += len(group)
        t_max, b, k = int(sizes[group].max()), len(group), e.shape[1]
        bar = np.where(allowed[group], 0.0, -1e9)
        score = np.zeros((b, k)) + bar
        back = np.zeros((t_max, b, k), np.int8)
        for t in range(t_max):
            live = t < sizes[group]
            at = np.minimum(begins[:-1][group] + t, len(e) - 1)
            if t:
                best = score.argmax(1)
                change = score[np.arange(b), best] - np.where(ends[at], AT_END, INSIDE)
                stay = score >= change[:, None]
                new = np.where(stay, score, change[:, None])
                back[t] = np.where(stay, np.arange(k), best[:, None])
            else:
                new = score
            score = np.where(live[:, None], new + e[at] + bar, score)
        state = score.argmax(1)
        for t in range(t_max - 1, -1, -1):
            live = t < sizes[group]
            out[begins[:-1][group][live] + t] = state[live]
            state = np.where(live, back[t][np.arange(b), state], state)
    return out


def _infer(model, least: int):
    """A batch of (id, page_id, text) to letters by language, and the unbroken passages of ``least`` letters or more."""
    hold: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "v" not in hold:
            hold["v"] = _Vocabulary(model.value)
        vocabulary, k = hold["v"], len(model.value.langs)
        find = tk.letter_runs().findall
        tokens = re.compile(tk.letter_runs().pattern + "|[" + re.escape(_ENDS) + "]").findall
        for b in batches:
            texts = b.column(2).to_pylist()
            every, begins = tk.flat([find(t) if t else [] for t in texts])
            total = np.zeros((len(texts), k), np.int64)
            found: list[list[tuple]] = [[] for _ in texts]
            full = np.flatnonzero(np.diff(begins))
            if len(full):
                codes = vocabulary.rows(every)
                e = vocabulary.table[codes]
                lens = np.fromiter(map(len, every), np.int64, len(every))
                cuts = np.append(begins[:-1][full], len(every))
                share, single, mixed = _mixture(e, cuts)
                best = single.argmax(1)
                letters = np.add.reduceat(lens, cuts[:-1])
                spread = np.sort(single, axis=1)
                told = spread[:, -1] - spread[:, -2] > 1.0
                several = mixed - spread[:, -1] > PENALTY
                one = ~several & told
                total[full[one], best[one]] = letters[one]
                sure = 1 / (1 + np.exp(spread[:, -2] - spread[:, -1]))
                bits = 1 << np.arange(k)
                near = ((spread[:, -1:] - single < PENALTY) * bits).sum(1)
                for j in np.flatnonzero(one & (letters >= least)).tolist():
                    t = texts[full[j]]
                    begin, end = 0, len(t)
                    while not t[begin].isalpha():
                        begin += 1
                    while not t[end - 1].isalpha():
                        end -= 1
                    found[full[j]].append((begin, end, int(best[j]), int(letters[j]), float(sure[j]), int(near[j])))
                many = np.flatnonzero(several)
                if len(many):
                    sizes = np.diff(cuts)[many]
                    pick = np.repeat(cuts[:-1][many] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                    ends = []
                    for i in full[many].tolist():
                        after = False
                        for w in tokens(texts[i]):
                            if w[0].isalpha():
                                ends.append(after)
                                after = False
                            else:
                                after = True
                    own_begins = np.concatenate([[0], np.cumsum(sizes)])
                    em, lm = np.maximum(e[pick] - e[pick].max(1, keepdims=True), -25), lens[pick]
                    allowed = _chosen(em, own_begins, best[many])
                    state = _passages(em, np.array(ends, bool), own_begins, allowed)
                    own = np.repeat(np.arange(len(many)), sizes)
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (state[1:] != state[:-1])
                    run_at = np.flatnonzero(new)
                    run_letters = np.add.reduceat(lm, run_at)
                    where = (full[many][own[run_at]], state[run_at])
                    np.add.at(total, where, run_letters)
                    q = np.exp(em - np.log(np.exp(em).sum(1, keepdims=True)))
                    ends_at = np.append(run_at[1:], len(own)) - 1
                    sums = np.add.reduceat(em, run_at, axis=0)
                    close = ((sums[np.arange(len(run_at)), state[run_at]][:, None] - sums < PENALTY) * bits).sum(1)
                    runs = np.add.reduceat(q[np.arange(len(own)), state], run_at) / (ends_at - run_at + 1)
                    spans: tuple = (None, [])
                    for j in np.flatnonzero(run_letters >= least).tolist():
                        i = int(own[run_at[j]])
                        if spans[0] != i:
                            spans = (i, [m.span() for m in tk.letter_runs().finditer(texts[full[many[i]]])])
                        x, y = run_at[j] - own_begins[i], ends_at[j] - own_begins[i]
                        found[full[many[i]]].append((spans[1][x][0], spans[1][y][1], int(state[run_at[j]]), int(run_letters[j]), float(runs[j]), int(close[j])))
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k)
            lists = pa.ListArray.from_arrays(offsets, pa.array(total.reshape(-1).astype(np.int32)))
            rows, begins_of = tk.flat(found)
            columns = list(zip(*rows)) or [()] * 6
            kinds = dict(begin=pa.int32(), end=pa.int32(), lang=pa.int32(), letters=pa.int32(), sure=pa.float32(), near=pa.int32())
            inner = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))
            passages = pa.ListArray.from_arrays(pa.array(begins_of.astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, passages], names=["block_id", "page_id", "letters", "passages"])

    return run


def fit(samples: DataFrame) -> NgramModel:
    """The model of a table of labelled clean sentences (lang, text), of at most ``MOST_SAMPLES`` of them."""
    rows = samples.filter("lang is not null and text is not null").select("lang", "text")
    rows = rows.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(MOST_SAMPLES).collect()
    return NgramModel(sorted((r["lang"], r["text"]) for r in rows))


def block_languages(blocks: DataFrame, model: NgramModel, least: int = 40) -> DataFrame:
    """(block_id, page_id, letters, passages): letters of a block's text by language, in the model's order, and its passages.

    ``passages`` holds the unbroken ones of ``least`` letters or more: begin and end in the text, the language's number, the
    letters, the mean share of the language in a word's likelihood, and a bit for each language that comes within the penalty. A null, empty or letterless text, or
    one of names alone, counts for no language. A block delivered twice counts once.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    own = blocks.select(F.col("id").alias("block_id"), "page_id", "text").filter("text is not null")
    schema = "block_id string, page_id string, letters array<int>, passages array<struct<begin:int,end:int,lang:int,letters:int,sure:float,near:int>>"
    return own.mapInArrow(_infer(shared, least), schema)


def main_language(code: Column) -> Column:
    """A label's language: what stands before the first - or _, trimmed and lower-cased."""
    return F.lower(F.trim(F.substring_index(F.substring_index(code, "-", 1), "_", 1)))


def page_languages(own: DataFrame, model: NgramModel) -> DataFrame:
    """(page_id, lang, confidence): each page's language with the most letters, and its share of them."""
    sums = [F.sum(F.col("letters")[i]).alias(f"n{i}") for i in range(len(model.langs))]
    pages = own.groupBy("page_id").agg(*sums)
    best = F.array_max(F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(-i), F.lit(x).alias("lang")) for i, x in enumerate(model.langs)]))
    every = sum((F.col(f"n{i}") for i in range(1, len(model.langs))), F.col("n0"))
    pages = pages.select("page_id", best.alias("best"), every.alias("every")).filter("best.n > 0")
    return pages.select("page_id", F.col("best.lang").alias("lang"), (F.col("best.n") / F.col("every")).alias("confidence"))


def infer_languages(blocks: DataFrame, model: NgramModel, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """Two tables: pages (page_id, lang, confidence), and every passage in another language than its page's
    (block_id, page_id, begin, end, lang, letters, confidence), text[begin:end] in code points from 0.

    A passage's language is a further one of its page, so it must add more than the penalty to what the page's own
    language gives the passage; names with few words between tell too little."""
    own = materialize(block_languages(blocks, model, least).dropDuplicates(["block_id"]))
    pages = materialize(page_languages(own, model))
    found = own.filter(F.size("passages") > 0).join(pages.select("page_id", F.col("lang").alias("main")), "page_id")
    names = F.array(*[F.lit(x) for x in model.langs])
    found = found.select("block_id", "page_id", "main", F.explode("passages").alias("o"))
    found = found.select("block_id", "page_id", "main", "o.begin", "o.end", F.get(names, F.col("o.lang")).alias("lang"), "o.letters", F.col("o.sure").alias("confidence"), F.col("o.near").alias("_near"))
    apart = F.expr("shiftright(_near, _main) & 1 = 0")
    found = found.withColumn("_main", (F.array_position(names, F.col("main")) - 1).cast("int")).filter((F.col("lang") != F.col("main")) & apart)
    return pages, found.drop("main", "_main", "_near")


def block_cases(passages: DataFrame) -> DataFrame:
    """(block_id, lang): for each block with such passages the language with the most letters in them."""
    sums = passages.groupBy("block_id", "lang").agg(F.sum("letters").alias("n"))
    return sums.groupBy("block_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("lang"))


def label_cases(pages: DataFrame, blocks: DataFrame, model: NgramModel) -> DataFrame:
    """(kind, item_id, lang): pages whose label is missing or false, and blocks with a passage in another language."""
    found, passages = infer_languages(blocks, model)
    labels = pages.select(F.col("id").alias("page_id"), "language").dropDuplicates(["page_id"])
    wrong = labels.join(found, "page_id").filter(F.col("language").isNull() | (main_language(F.col("language")) != F.col("lang")))
    return wrong.select(F.lit("page").alias("kind"), F.col("page_id").alias("item_id"), "lang").unionByName(
        block_cases(passages).select(F.lit("block").alias("kind"), F.col("block_id").alias("item_id"), "lang")
    )
