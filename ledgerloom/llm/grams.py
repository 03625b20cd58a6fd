"""Hashes of words, k-grams and characters in arrays, and the winnowing of them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A word is a maximal run of letters or digits.
WORD = re.compile(r"[^\W_]+")
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A batch from Spark is worked on in slices of about so many characters, so that long texts don't add up.
SLICE_CHARS = 2_000_000
#: Entries of a worker's memo; it starts anew when full, which changes time only.
MEMO = 400_000


class WordHashes(dict):
    """word -> 64-bit hash of the lower-cased word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def word_kgrams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive ids; empty if there are fewer than k."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[j : j + n]
    return mixed(h)


def slide(a: np.ndarray, w: int, least: np.ufunc) -> np.ndarray:
    """The ufunc (minimum or maximum) over every w consecutive values, in log(w) passes."""
    span = 1
    n = len(a) - w + 1
    while span * 2 <= w:
        a = least(a[:-span], a[span:])
        span *= 2
    return least(a[:n], a[w - span : w - span + n]) if span < w else a


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some w consecutive ones, all of equal ones.

    Fewer than w hashes form one window.
    """
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    low = slide(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate([edge, low, edge]), w, np.maximum) == h)


def slices(texts: list[str | None]) -> Iterator[range]:
    """Index ranges of about SLICE_CHARS characters each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield range(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield range(begin, len(texts))


def batches(fields: list[tuple[str, pa.DataType]], columns: Iterable) -> pa.RecordBatch:
    """A record batch of the given columns, lists or arrays."""
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
