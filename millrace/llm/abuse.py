"""Scores for abusive, hateful or sexually explicit text (problem 9).

Gradient-boosted trees over dense features of a document's worst passages: densities of general lexicons, of words that
reviewers' verdicts speak for or against, nearness to a second person, capitals, punctuation and rates of disguised
spelling. The trees start from a fixed margin for lexicon hits; an isotonic fit calibrates what they give.

The classifier is fitted on at most ``MOST_LABELS`` labelled documents, taken in the order of a hash; every document is
scored. Texts stay with the workers: word counts and features are worked out there, and the driver gets the counts of at most
``MOST_TERMS`` words and one row of numbers for each labelled document. Words are folded first: look-alike letters of another
script, digits and signs for letters, letters set apart or drawn out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import textkernel as tk

#: Most labelled documents that the classifier is fitted on, and most words, the commonest in them, that it learns weights of.
MOST_LABELS, MOST_TERMS = 20_000, 100_000
FOLDS = 3
#: Positive verdicts that the uncalibrated score weighs as much as.
PRIOR = 10.0

# Stems by kind. A stem matches the beginning of a folded word, one that ends in $ the whole word.
INSULTS = """идиот дебил придур урод мраз мудак мудил ублюд сволоч скотин твар сука суч гнид подонк кретин тупиц козел козл говн дерьм
долбо пидор пидар ебан ебал еблан хуй хуе хуи пизд бляд блят гандон чмо шлюх жоп залуп выродок недоумк ничтожеств заткни
idiot moron bastard asshole bitch dickhead shit fuck cunt retard scum wanker prick imbecile loser dumbass whore slut faggot
arschloch vollpfosten hurensohn wichser fotze missgeburt schlampe depp trottel verpiss scheiß scheiss drecksack abschaum
connard connasse ordure abruti salaud salope enculé encule pute foutre batard gueule crétin
gilipollas cabron cabrón imbécil imbecil hijoputa puta mierda pendejo idiota maricon zorra
debil szmat skurwysyn skurwiel kurw spierdal pierdol chuj dupek kretyn gówn gown
покидьо потвор мерзот тварюк сволот недолюд виродо дурень пельк""".split()
SEXUAL = """порн секс$ секса$ эрот голая голые голыми голых сиськ оргазм трахал трахн минет интим кончил разврат анал$ орал$ стонал
porn sex$ sexy nude nudes naked tits orgasm blowjob hardcore erotic escort anal$ oral$ horny cum$ xxx uncensored moan
nackt porno geil orgasmus nues$ nue$ sexe$ baise desnud sexo$ tetas naga nagie nagimi seks$ гола голі голими оголен""".split()
THREATS = """сдохн сдыхай сгнил убью убить прибью зареж закопа повес расстрел сгин тараканы паразит нелюд клетк выслать выгнать
kill cage hurt hang$ rot$ rape stab burn vermin filth subhuman deport
verreck krepier umbringen aufhäng ungeziefer dreck raus crève creve vermine dehors tuer
muérete muerete matar alimañas fuera zdechni robactwo zabij здохн здихай вбити геть""".split()
GROUPS = """мигрант приезж чурк хач иноверц инвалид баб геи гей женщин евре мусульман мігрант жінк біженц
immigrant migrant foreigner cripple women gays jews muslims refugee ausländer frauen flüchtling
étrangers femmes immigrés extranjeros mujeres inmigrantes obcy imigranci kobiety""".split()
# Words of texts that name such words without using them, by what the definition exempts: rules and reports, medicine, technology
# and animals.
RULES = """слов термин цитат назва критик запре правил оскорблен устав кодекс словар сообща цитир роман глав книг автор значен
word term quot call critic forbid prohibit rule insult dictionary meaning novel chapter book example report polic
wort wört begriff zitat verbiet verbot regel beleidig roman kapitel buch beispiel mot$ mots$ terme citation interdi règle insulte roman chapitre livre exemple
palabra término cita prohíb prohib regla insult novela capítulo libro ejemplo słow cytat zabrani zasad obraź obelg powieś rozdział książ przykład
термін заборон образ$ образи розділ приклад""".split()
MEDICAL = """клиник поликлиник врач медицин здоров осмотр лечен пациент анатом биолог педагог половое половому
clinic doctor medical health screening patient treatment anatom biolog education klinik arzt ärzt medizin gesund vorsorge patient
clinique médecin médic santé dépistage clínica médico salud paciente lekarz zdrow badani pacjent клінік лікар медич""".split()
TECHNICAL = """процесс сервер команд узел узла терминал очеред программ собак щенк порода породы питомник зоолог звезд астроном
process server command node terminal queue thread software dog puppy breed kennel animal zoolog star astronom
prozess befehl hund züchter tier stern processus commande chien chiot étoile proceso comando perro cachorro estrella
proces poleceni pies hodowl gwiazd процес собак зірк""".split()
SECOND = """ты тебя тебе тобой твой твоя твою твои твоё вы вас вам ваш ваша ти тебе твій you your yours du dich dir dein deine tu te toi ton ta
espèce tú ti tus ty ciebie ci twój twoja cię""".split()

# Latin letters and signs that look like Cyrillic ones.
_LIKE = str.maketrans("aceopxyktmhb3046@$", "асеорхуктмнвзоабас")
_BACK = str.maketrans("асеорхуктмнвіїз", "aceopxyktmhbiiz")
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "6": "б"})
_CYR_SIGNS = str.maketrans({"0": "о", "3": "з", "4": "ч", "6": "б", "@": "а", "$": "с", "1": "и", "8": "в", "b": "ь", "u": "и", "n": "п", "r": "г", "7": "т"})
_token = re.compile(r"[^\W_](?:[^\W_]|[@$#*!_.\-​‌‍·]+(?=[^\W_]))*")
_quotes = frozenset("«»\"“”„‹›")
_apart = re.compile(r"[_.\-·​‌‍*]")
_drawn = re.compile(r"(\w)\1{2,}")
_passage = re.compile(r"[.!?…]+(?:\s+|$)|\n+|[\U0001F300-\U0001FAFF]+")
_cyrillic = re.compile(r"[Ѐ-ӿ]")
_latin = re.compile(r"[A-Za-z]")


@cache
def _mixed_scripts() -> re.Pattern:
    return re.compile(r"[бвгджзийлмнптфцчшщъыьэюя]")


def _fold(word: str) -> tuple[str, bool]:
    """The word as it is meant, and whether it was disguised."""
    low = word.lower()
    if low.isalpha() and not (_cyrillic.search(low) and _latin.search(low)):
        out = _drawn.sub(r"\1", low)
        return out, out != low
    if low.isdigit():
        return "#", False
    parts = _apart.split(low)
    if len(parts) > 2 and max(map(len, parts)) <= 2:
        low = "".join(parts)
    elif len(parts) > 1:
        low = max(parts, key=len) if min(map(len, parts)) > 2 else "".join(parts)
    body = sum(c.isalpha() for c in low)
    if not body:
        return "#", False
    cyr, lat = len(_cyrillic.findall(low)), len(_latin.findall(low))
    if cyr and (cyr >= lat or _mixed_scripts().search(low)):
        out = low.translate(_CYR_SIGNS).translate(_LIKE)
    else:
        out = low.translate(_SIGNS)
        if cyr:
            out = out.translate(_BACK)
    out = _drawn.sub(r"\1", out)
    return out, out != word.lower()


class _Words(dict):
    """word -> (folded, disguised, insult, sexual, threat, group, second person, rules, medical, technical)."""

    def __init__(self):
        super().__init__()
        self.stems = [re.compile("|".join(kind)) for kind in (INSULTS, SEXUAL, THREATS, GROUPS, RULES, MEDICAL, TECHNICAL)]
        self.second = frozenset(SECOND)

    def __missing__(self, word: str):
        f, disguised = _fold(word)
        kinds = [bool(p.match(f)) for p in self.stems]
        value = (f, disguised, *kinds[:4], f in self.second, *kinds[4:])
        if len(self) < tk.CACHE_WORDS:
            self[word] = value
        return value


_words = _Words()


def learned_weights(pos: np.ndarray, docs: np.ndarray, p: float, n: float, terms: list[str]) -> dict[str, float]:
    """Log-odds of words by the verdicts on the documents they stand in, of all ``n`` documents with the verdicts ``p``,
    smoothed; rare and neutral words are left out."""
    v = np.log((pos + 0.1) / (p + 0.2)) - np.log((docs - pos + 0.1) / (n - p + 0.2))
    return {terms[i]: float(v[i]) for i in np.flatnonzero((docs >= 2) & (np.abs(v) > 1.5))}


NAMES = [
    "insults", "sexual", "threats", "groups", "second", "near_second", "disguised", "disguised_hits", "capitals", "marks", "words",
    "odds_top", "odds_sum", "odds_share", "odds_against", "rules", "medical", "technical", "quoted", "passages_hit", "emoji", "hits_share",
]


class _Chunks(dict):
    """What stands between spaces -> (its words, what is known of each, the folded words that are no names, any kind, a hit in quotes)."""

    def __missing__(self, chunk: str):
        words = tuple(_token.findall(chunk))
        known = tuple(_words[w] for w in words)
        plain = tuple(k[0] for w, k in zip(words, known) if k[0] != "#" and not (w[:1].isupper() and w[1:].islower()))
        quoted = not _quotes.isdisjoint(chunk) and any(k[2] or k[3] or k[4] for k in known)
        value = (words, known, plain, any(any(k[1:7]) for k in known), quoted)
        if len(self) < tk.CACHE_WORDS:
            self[chunk] = value
        return value


_chunks = _Chunks()


def parse(text: str) -> list[list[tuple]]:
    """The passages of a text, as their chunks; passages without words are left out."""
    parts = ([_chunks[x] for x in part.split()] for part in _passage.split(text))
    return [own for p in parts if (own := [c for c in p if c[0]])]


def _told(passage: list[tuple]) -> list[str]:
    """A passage's folded words without names and numbers; the first word is capitalised anyway."""
    first = passage[0][1][0][0]
    out = [] if first == "#" or first in passage[0][2] else [first]
    for c in passage:
        out += c[2]
    return out


def terms(passages: list) -> set[str]:
    return {w for p in passages for w in _told(p)}


def features(text: str, passages: list, odds: dict[str, float]) -> list[float]:
    """The features of the passage that looks worst, and of the document around it."""
    best, worst, hit = None, -1e9, 0
    for p in passages:
        told = _told(p)
        if not any(c[3] for c in p) and odds.keys().isdisjoint(told):
            if best is None:
                best = [0.0] * 5 + [20] + [0.0] * 4 + [sum(len(c[0]) for c in p)] + [0.0] * 8
            continue
        words = [w for c in p for w in c[0]]
        known = [k for c in p for k in c[1]]
        n = len(words)
        dis, ins, sex, thr, grp, sec, rul, med, tec = (sum(col) for col in list(zip(*known))[1:])
        own = [odds[x] for x in told if x in odds]
        up = sorted((v for v in own if v > 0), reverse=True)
        down = sum(v for v in own if v < 0)
        score = 2.0 * (ins + sex + thr) + grp + 0.5 * sec + sum(up[:4]) + 0.3 * down
        hit += ins + sex + thr > 0
        if score > worst:
            at = [i for i, k in enumerate(known) if k[2] or k[4]]
            you = [i for i, k in enumerate(known) if k[6]]
            near = min((abs(i - j) for i in at for j in you), default=20)
            worst = score
            best = [
                ins, sex, thr, grp, sec, near, dis, sum(k[1] and (k[2] or k[3] or k[4]) for k in known),
                sum(w.isupper() and len(w) > 2 for w in words) / n, 0.0, n, up[0] if up else 0.0, sum(up[:6]), len(up) / n, down, rul, med, tec, sum(c[4] for c in p),
            ]
    if best is None:
        return [0.0] * len(NAMES)
    best[9] = sum(text.count(c) for c in "!?") / max(1, len(text)) * 100
    return [float(x) for x in best] + [float(hit), float(not text.isascii() and max(text) > "\U0001f300"), hit / len(passages)]


def prior(x: np.ndarray) -> np.ndarray:
    """The margin that a passage's lexicon hits give before anything is learned."""
    at = NAMES.index
    hits = np.minimum(x[:, at("insults")] + x[:, at("threats")], 2) + np.minimum(x[:, at("sexual")], 2)
    return -4.0 + 2.0 * hits + (x[:, at("near_second")] <= 3) * np.minimum(hits, 1) + 0.5 * (x[:, at("groups")] > 0) * np.minimum(hits, 1)


@dataclass
class Trees:
    """Boosted trees of depth three on binned features, with logistic loss, from the prior margin on."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        out = prior(x)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - 7]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.2, smooth: float = 2.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)
    width = 33
    margin, trees = prior(x), []
    slot = binned + np.arange(x.shape[1]) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        feature, cut, node = np.zeros(7, np.int64), np.full(7, width), np.zeros(len(y), np.int64)
        for k in range(7):
            own = np.flatnonzero(node == k)
            if len(own) >= 8:
                at = slot[own].reshape(-1)
                gs, hs = (np.bincount(at, np.repeat(v[own], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1) for v in (g, h))
                gt, ht = g[own].sum(), h[own].sum()
                gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                j, c = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, c] > 1e-3:
                    feature[k], cut[k] = j, c
            node[own] = 2 * k + 1 + (binned[own, feature[k]] > cut[k])
        leaf = np.array([g[node == k].sum() / (h[node == k].sum() + smooth) * rate for k in range(7, 15)])
        margin += leaf[node - 7]
        trees.append((feature, cut, leaf))
    return Trees(edges, trees)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the calibrated scores at them."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order]):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    at = np.array([m for b in blocks for m in (b[2], b[3])])
    score = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return at, score


@dataclass
class Classifier:
    odds: dict[str, float]
    trees: Trees
    at: np.ndarray
    score: np.ndarray
    positive: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, parse(t), self.odds) if t else [0.0] * len(NAMES) for t in texts], float).reshape(-1, len(NAMES))
        if not len(x):
            return np.zeros(0)
        margin = self.trees.margin(x)
        plain = 1 / (1 + np.exp(-margin))
        told = x[:, NAMES.index("words")] > 0
        return told * (self.positive * np.interp(margin, self.at, self.score) + PRIOR * plain) / (self.positive + PRIOR)


def fit_features(x: np.ndarray, y: np.ndarray, fold: np.ndarray, odds: dict[str, float]) -> Classifier:
    """Trees on features whose word weights come from the other folds; the margins that the scores are calibrated on do too."""
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            margin[fold == k] = fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Classifier(odds, fit_trees(x, y), *isotonic(margin, y), float(y.sum()))


def _label_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text's fold, by the text, so that copies share one, and its distinct words."""
    for b in batches:
        texts = b.column("text").to_pylist()
        fold = [tk.hash64(t) % FOLDS for t in texts]
        words = [sorted(terms(parse(t))) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), b.column("y"), pa.array(words, pa.list_(pa.string()))], names=["fold", "y", "terms"])


def _label_features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            fold = [tk.hash64(t) % FOLDS for t in texts]
            x = [features(t, parse(t), by_fold[k]) for t, k in zip(texts, fold)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(fold, pa.int32()), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "fold", "y", "x"]
            )

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """The classifier, or none without verdicts. A document judged several times counts with the mean verdict."""
    spark = docs.sparkSession
    y = labels.filter("abusive in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("abusive").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    judged = texts.join(y, "doc_id").select("doc_id", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
    judged = F.broadcast(materialize(judged))  # MOST_LABELS rows of two numbers
    own = materialize(texts.join(judged, "doc_id").dropDuplicates(["doc_id"]))
    told = own.mapInArrow(_label_terms, "fold int, y double, terms array<string>")
    word = told.select(F.explode("terms").alias("term"), "fold", "y")
    sums = [f(F.when(F.col("fold") == k, F.col("y"))).alias(f"{n}{k}") for k in range(FOLDS) for n, f in (("p", F.sum), ("n", F.count))]
    counts = word.groupBy("term").agg(*sums, F.count("*").alias("n")).filter("n > 1").orderBy(F.col("n").desc(), "term").limit(MOST_TERMS).toPandas()
    totals = told.groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).toPandas().set_index("fold")
    if not len(totals):
        return None
    names = counts["term"].tolist()

    def odds(folds: list[int]) -> dict[str, float]:
        pos, n = (counts[[f"{c}{k}" for k in folds]].fillna(0.0).to_numpy(float).sum(1) for c in "pn")
        some = totals.loc[[k for k in folds if k in totals.index]]
        return learned_weights(pos, n, float(some["p"].sum()), float(some["n"].sum()), names)

    shared = spark.sparkContext.broadcast([odds([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)])
    rows = own.mapInArrow(_label_features(shared), "doc_id long, fold int, y double, x array<double>").toPandas().sort_values("doc_id")
    return fit_features(np.array(rows["x"].tolist(), float), rows["y"].to_numpy(float), rows["fold"].to_numpy(), odds(list(range(FOLDS))))


def score_documents(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, score): a calibrated score in [0, 1] for each row; 0 for null, empty and blank texts and without
    verdicts to learn from. Repeated rows are each scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            s = shared.value.scores(texts) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def source_rates(docs: DataFrame, scores: DataFrame, least: float = 0.5) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) for each source."""
    both = docs.select("doc_id", "source").dropDuplicates(["doc_id"]).join(scores.dropDuplicates(["doc_id"]), "doc_id")
    over = (F.col("score") >= least).cast("int")
    return both.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(over).alias("flagged"), F.avg(over).alias("rate"), F.avg("score").alias("mean_score")
    )
