"""Vectorised text features for Arrow batches: words, hashes, shingles and MinHash values as flat arrays.

Splitting into words is one C-level ``findall`` a text and hashing one dictionary look-up a word; all that
follows is NumPy over the batch. Regular expressions on the JVM cost several times as much on these texts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import xxhash

#: Distinct words a worker remembers the hashes of; beyond, they are hashed each time.
CACHE_WORDS = 400_000
NAME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


@cache
def _other_numbers() -> str:
    """The numbers of Unicode that are neither decimal digits nor letters, as the inside of a character class."""
    runs: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in ("Nl", "No"):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@cache
def letter_runs() -> re.Pattern:
    """Longest runs of letters (Unicode L)."""
    return re.compile(rf"[^\W\d_{_other_numbers()}]+")


@cache
def word_runs() -> re.Pattern:
    """Longest runs of letters and digits (Unicode L and N)."""
    return re.compile(r"[^\W_]+")


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class Hashes(dict):
    """word -> 64-bit hash of the word lower-cased."""

    def make(self, word: str) -> int:
        return hash64(word.lower())

    def __missing__(self, word: str) -> int:
        h = self.make(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


class MaskedHashes(Hashes):
    """As Hashes, but capitalised words share one hash: they are taken for names."""

    def make(self, word: str) -> int:
        return int(NAME) if word[:1].isupper() and word[1:].islower() else hash64(word.lower())


def flat(lists: list[list]) -> tuple[list, np.ndarray]:
    """The lists' items in a row, and where each list begins, with the end."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return [x for own in lists for x in own], np.concatenate([[0], np.cumsum(sizes)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words inside each text; a shorter text that has words is one shingle."""
    sizes = np.diff(begins)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(begins[:-1] - out_begins[:-1], counts) + np.arange(out_begins[-1])
    left = np.repeat(begins[1:], counts) - at
    h = np.zeros(len(at), np.uint64)
    padded = np.append(words, np.zeros(n, np.uint64))
    for j in range(n):
        h = np.where(j < left, mix(h * np.uint64(0x9E3779B97F4A7C15) + padded[at + j] + np.uint64(j + 1)), h)
    return h, out_begins


def minhash(values: np.ndarray, begins: np.ndarray, functions: int) -> np.ndarray:
    """(texts, functions) least values under seeded scramblings; the largest number for a text without values."""
    full = np.diff(begins) > 0
    out = np.full((len(full), functions), np.iinfo(np.uint64).max, np.uint64)
    if len(values):
        at = begins[:-1][full]
        for f in range(functions):
            seed = np.uint64((f + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            out[full, f] = np.minimum.reduceat(mix(values ^ seed), at)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0, seven bits to a byte."""
    d = numbers.astype(np.uint64)
    width = np.maximum(1, (np.frexp(d.astype(np.float64))[1] + 6) // 7)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(width.max(initial=0))):
        has = width > j
        more = (width[has] > j + 1).astype(np.uint8) << 7
        out[ends[has] - width[has] + j] = ((d[has] >> np.uint64(7 * j)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)), first)
