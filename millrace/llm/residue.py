"""Template residue, filler and error-page text standing for content (problem 6).

Texts are cut into units: each line whole and each of its sentences, of a title the parts beside the site's name
too; a sentence further on in a line about templates is left out. In a unit, numbers, codes and names are masked.
Units that are near-duplicates of trusted residue messages carry their label on: two similar units share a word of
their prefixes and are joined on it, the similarity of the masked words decides, and labels spread through the
connected components until no unit is new. Unfilled placeholders and filler words are labelled by their form,
unless the sentence writes about templates.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize
from . import textkernel as tk

# Trusted messages that stand for content, by kind and language.
TRUSTED = """
Page not found
404 Not Found
Oops! We can't find the page you are looking for
Sorry, something went wrong on our side (error 500)
502 Bad Gateway nginx
502 Bad Gateway
Internal server error
The service is temporarily unavailable, try again later
Error establishing a database connection
Request timed out after 30 s
Too many requests
Access denied
Checking your browser before you continue
Please enable JavaScript to view this page
You need to allow scripts to run this app
This site requires JavaScript
Your browser does not support scripts or they are disabled
Your text goes here
Replace this paragraph with a description of your company
Sample text, click to edit and add your own content
This is a demo paragraph of the theme; delete it before publishing
Insert heading here
[short intro to be written]
asdf asdf test test 123 test page please ignore
Страница не найдена
К сожалению, такой страницы у нас нет
Ошибка 404
Внутренняя ошибка сервера, повторите попытку позже
Сервис временно недоступен, ведутся технические работы
Не удалось подключиться к базе данных
Превышено время ожидания ответа (30 с)
Слишком много запросов
Доступ запрещён
Проверяем ваш браузер, это займёт 5 секунд
Для работы сайта включите JavaScript
В вашем браузере отключены скрипты, содержимое не может быть показано
Чтобы увидеть страницу, разрешите выполнение сценариев
Здесь будет ваш текст
Замените этот абзац описанием компании
Пример текста, нажмите, чтобы изменить
Текст-рыба для проверки макета, удалите перед публикацией
Вставьте заголовок
[добавить краткое описание]
тест тест тестовая страница проверка 123
Сторінку не знайдено
Помилка 500: внутрішня помилка сервера
Доступ заборонено, код 123
Увімкніть JavaScript, щоб переглянути сторінку
Seite nicht gefunden (404)
Interner Serverfehler, bitte später erneut versuchen
Zugriff verweigert, Kennung 123
Bitte aktivieren Sie JavaScript, um diese Seite zu sehen
Page introuvable (erreur 404)
Erreur interne du serveur, réessayez plus tard
Accès refusé, référence 123
Veuillez activer JavaScript pour afficher cette page
Página no encontrada
Error interno del servidor (500), inténtelo más tarde
Acceso denegado, código 123
Active JavaScript para ver esta página
Nie znaleziono strony (404)
Wewnętrzny błąd serwera, spróbuj później
Odmowa dostępu, kod 123
Włącz JavaScript, aby zobaczyć tę stronę
"""

# The filler words of printers' dummy text.
FILLER = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore
magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis
aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur""".split()

# Forms of placeholders in template languages.
PLACEHOLDERS = r"""
\{\{\{?\s*[\w.$]+\s*\}?\}\}
\$\{\s*[\w.]+\s*\}
\#\{\s*[\w.]+\s*\}
<%=?\s*[\w.$]+\s*%>
<\?=\s*\$?[\w.]+\s*\?>
%[A-Z][A-Z_.]{2,}%
\[%\s*[\w.]+\s*%\]
\{%\s*[\w.]+\s*%\}
\[\[[A-Z][A-Z_.]+\]\]
@@[A-Z][A-Z_.]+@@
__[A-Z][A-Z_.]+__
(?<![\w{$\#%])\{[A-Za-z_][\w.]*\}(?!\})
\[object[ ]Object\]
^(?:undefined|NaN|null)$
"""

# Stems of words that only a sentence about templates uses.
ABOUT = """шаблон выражен переменн подстановк плейсхолдер синтаксис вираз змінн template expression placeholder variable syntax
vorlage platzhalter ausdruck plantilla expresión marcador modèle gabarit szablon wyrażeni zmienn""".split()

#: Share of common words, as SIMILAR / DENOMINATOR, from which two units are near-duplicates.
SIMILAR, DENOMINATOR = 4, 5
ROUNDS = 20

_placeholder = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS.split("\n") if p))
_about = re.compile("|".join(ABOUT), re.I)
_filler = frozenset(FILLER)
_stop = re.compile(r"(?<=[.!?…])\s+")
_beside = re.compile(r"\s[|—–-]\s")
_code = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", re.I)
_word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_hashes = tk.Hashes()
_NUMBER = (1 << 64) - 1
_told = frozenset(w.lower() for w in _word.findall(TRUSTED))


def _masked(unit: str) -> list[int]:
    """Hashes of a unit's words; numbers and codes share one; names, unless the messages use them, are left out."""
    words = _word.findall(_code.sub("0", unit))
    caps = unit.isupper()
    out = []
    for i, w in enumerate(words):
        if w[0].isdigit():
            out.append(_NUMBER)
        elif caps or i == 0 or not (w[0].isupper() and w[1:].islower()) or w.lower() in _told:
            out.append(_hashes[w])
    return out


def _unit_words(text: str, title: bool) -> Iterator[list[int]]:
    """The words of every line as a whole and of each of its sentences, of a title also of the parts beside the site's name.

    A sentence after the first is left out where the rest of its line writes about templates.
    """
    lines = text.split("\n")
    if title:
        lines += [p for x in lines if len(parts := _beside.split(x)) > 1 for p in parts]
    for p in lines:
        own = _stop.split(p.strip())
        words = [_masked(x) for x in own]
        yield words[0]
        if len(own) > 1:
            yield [w for ws in words for w in ws]
            about = [bool(_about.search(x)) for x in own]
            of = sum(about)
            yield from (ws for ws, at in zip(words[1:], about[1:]) if of == at)


def _form(text: str) -> bool:
    """Whether a text holds an unfilled placeholder in a sentence not about templates, or a unit of filler."""
    if any(c in text for c in "{%[@_$<") or len(text) < 12:
        for m in _placeholder.finditer(text.strip()):
            begin = max(text.rfind(c, 0, m.start()) for c in ".!?…\n")
            end = min([e for e in (text.find(c, m.end()) for c in ".!?…\n") if e > 0] or [len(text)])
            if not _about.search(_placeholder.sub(" ", text[begin + 1 : end])):
                return True
    for line in text.split("\n"):
        words = line.lower().replace(".", " ").replace(",", " ").split()
        if len(words) > 1 and sum(w in _filler for w in words) >= 0.8 * len(words) and len(set(words)) > 1:
            return True
    return False


def _sets(units: list[list[int]]) -> tuple[pa.Array, pa.Array]:
    """Each unit's id and its distinct words in the order of their hashes, the number that all numbers share last."""
    own = [sorted(set(u)) for u in units]
    ids = [xxhash.xxh3_64_intdigest(array("Q", u).tobytes()) for u in own]
    every, begins = tk.flat(own)
    words = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(tk.signed(np.array(every, np.uint64))))
    return pa.array(tk.signed(np.array(ids, np.uint64))), words


def _head() -> Column:
    """The first words of a unit, of which two units that are similar share one."""
    return F.explode(F.expr(f"slice(words, 1, size(words) * {DENOMINATOR - SIMILAR} div {DENOMINATOR} + 1)")).alias("w")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, units, forms = [], [], []
        for i, (no, text) in enumerate(zip(b.column("block_no").to_pylist(), b.column("text").to_pylist())):
            if not text:
                continue
            form = _form(text)
            own = [m for m in _unit_words(text, no < 0) if m]
            for m in own or ([[]] if form else []):
                rows.append(i)
                units.append(m)
                forms.append(form)
        at = pa.array(rows, pa.int64())
        u, w = _sets(units)
        yield pa.RecordBatch.from_arrays(
            [b.column("page_key").take(at), b.column("block_no").take(at), pa.array(forms, pa.bool_()), u, w],
            names=["page_key", "block_no", "form", "unit", "words"],
        )


def searched_texts(pages: DataFrame, scrapes: DataFrame) -> DataFrame:
    """(page_key, block_no, text): titles of pages and scrapes as block -1, and the blocks of scrapes."""

    def keyed(prefix: str, key: str, no: Column, text: Column) -> list[Column]:
        return [F.concat(F.lit(prefix), F.col(key)).alias("page_key"), no.cast("int").alias("block_no"), text.alias("text")]

    blocks = scrapes.select("scrape_id", F.posexplode("blocks").alias("no", "b"))
    return (
        pages.select(*keyed("page:", "id", F.lit(-1), F.col("title")))
        .unionByName(scrapes.select(*keyed("scrape:", "scrape_id", F.lit(-1), F.col("title"))))
        .unionByName(blocks.select(*keyed("scrape:", "scrape_id", F.col("no"), F.col("b.text"))))
    )


def find_residue(texts: DataFrame, trusted: list[str] | None = None) -> DataFrame:
    """(page_key, block_no): the texts that hold residue. Null, empty and blank texts are no cases.

    ``texts`` has page_key, block_no (-1: a title) and text; equal keys count once.
    """
    spark = texts.sparkSession
    messages = [m.strip() for m in (trusted or TRUSTED.strip().split("\n")) if m.strip()]
    u, w = _sets([[w for x in _stop.split(m) for w in _masked(x)] for m in messages])
    seeds = materialize(spark.createDataFrame([*zip(u.to_pylist(), w.to_pylist())], "unit long, words array<long>").coalesce(1))

    units = texts.select("page_key", "block_no", "text").mapInArrow(
        _features, "page_key string, block_no int, form boolean, unit long, words array<long>"
    )
    units = materialize(units)
    known = materialize(units.filter(F.size("words") > 0).select("unit", "words").dropDuplicates(["unit"]))
    found, fresh = seeds.select("unit"), seeds
    for _ in range(ROUNDS):
        near = fresh.select(F.col("words").alias("words_b"), _head())
        met = known.select("*", _head()).join(broadcast_if_small(near), "w")
        both = F.size(F.array_intersect("words", "words_b"))
        union = F.size(F.array_union("words", "words_b"))
        new = met.filter(both * DENOMINATOR >= union * SIMILAR).select("unit", "words").dropDuplicates(["unit"])
        fresh = materialize(new.join(broadcast_if_small(found.select("unit").distinct()), "unit", "left_anti"))
        if fresh.isEmpty():
            break
        found = found.union(fresh.select("unit"))
    else:
        raise RuntimeError("labels still spread; give more rounds")
    exact = units.join(broadcast_if_small(found.distinct()), "unit", "left_semi").select("page_key", "block_no")
    return exact.union(units.filter("form").select("page_key", "block_no")).distinct()
