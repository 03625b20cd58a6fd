"""Encoding a corpus with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last one of the prefix's own encoding (one token ends it and
stays apart from the last token of what precedes it). So prefixes are gone through from the shortest: the tokens that
end a prefix are found with a suffix automaton of the vocabulary (a trie read backwards from the prefix's end), each
is tested against the stored last token before it, and the one that fits is stored. Back-pointers from the whole
piece give its ids, the same that merging pairs by rank would give.

Whether two tokens stay apart is decided from the vocabulary alone: going back in time from both, no merge across
the seam may come before the merges that formed them.

The vocabulary's file is read on the driver and sent to the executors as an array of fixed size (50,256 tokens).
Texts are cut into pieces by the vocabulary's own pattern; within a task pieces seen before are looked up.

A null or an empty text gives an empty list. Texts are taken as they are. Repeated rows give one row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.grams import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of a worker's memo; it starts anew when full, which changes time only.
MEMO = 300_000


def vocabulary_file(path: str | None = None) -> tuple[str, str]:
    """(path, pattern) of a rank file; without a path that of the installed public vocabularies."""
    import public_tokenizers

    return path or str(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """The tokens in the order of their ids."""
    with open(path, "rb") as f:
        ranked = [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip())]
    return [t for _, t in sorted(ranked)]


class Encoder:
    """Exact ids of byte strings and texts."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.id_of = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.left = [-1] * len(tokens)
        self.right = [-1] * len(tokens)
        self.apart: dict[int, bool] = {}
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for i, t in enumerate(tokens):
            if len(t) > 1:
                self._split(i, t)
            node = 0
            for b in reversed(t):
                node = self._next(node, b)
            self.ends[node] = i
        self.memo: dict[bytes, bytes] = {}
        self.head = _Pieces(self, "")
        self.tail = _Pieces(self, " ")

    def _next(self, node: int, b: int) -> int:
        at = node << 8 | b
        if at not in self.step:
            self.step[at] = len(self.ends)
            self.ends.append(-1)
        return self.step[at]

    def _split(self, i: int, t: bytes) -> None:
        """The two tokens that merge into token i: the cut whose halves are tokens that stay apart until then."""
        for k in range(1, len(t)):
            a, b = self.id_of.get(t[:k], -1), self.id_of.get(t[k:], -1)
            if 0 <= a < i and 0 <= b < i and self._stay_apart(a, b, i):
                self.left[i], self.right[i] = a, b
                return

    def _stay_apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the seam of a and b comes before the given time and before they were formed."""
        until_a = until_b = before
        while True:
            joined = self.id_of.get(self.tokens[a] + self.tokens[b], -1)
            if 0 <= joined < until_a and joined <= until_b and joined < before:
                return False
            if a > b:
                until_a, a = a, self.right[a]
            else:
                until_b, b = b, self.left[b]
            if a < 0 or b < 0:
                return True

    def fits(self, a: int, b: int) -> bool:
        at = a << 20 | b
        known = self.apart.get(at)
        if known is None:
            if len(self.apart) >= MEMO:
                self.apart.clear()
            known = self.apart[at] = self._stay_apart(a, b, 1 << 62)
        return known

    def piece(self, data: bytes) -> bytes:
        """The ids of one piece, as the bytes of 32-bit integers."""
        whole = self.id_of.get(data)
        if whole is not None:
            return whole.to_bytes(4, "little")
        step, ends, tokens, fits = self.step, self.ends, self.tokens, self.fits
        last = [-1] * (len(data) + 1)
        for i in range(1, len(data) + 1):
            node, j = 0, i
            while j:
                j -= 1
                node = step.get(node << 8 | data[j], -1)
                if node < 0:
                    break
                t = ends[node]
                if t >= 0 and (j == 0 or fits(last[j], t)):
                    last[i] = t
                    break
        ids, i = [], len(data)
        while i:
            ids.append(last[i])
            i -= len(tokens[last[i]])
        return np.array(ids[::-1], "<i4").tobytes()

    def slowly(self, text: str) -> bytes:
        """The ids of a text by the pattern and the pieces it gives."""
        out, memo = [], self.memo
        for p in self.pattern.findall(text):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = memo[p] = self.piece(p.encode("utf-8", "replace"))
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as the bytes of 32-bit integers.

        A single blank between two non-blank characters begins a piece by the pattern, so texts may be cut there first.
        """
        if not text:
            return b""
        words = _LONE_BLANK.split(text) if _odd_blanks(text) else text.split(" ")
        return self.head[words[0]] + b"".join(map(self.tail.__getitem__, words[1:]))


_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_BLANK_THEN = re.compile(r" \s")
_THEN_BLANK = re.compile(r"[^\S ] ")


def _odd_blanks(text: str) -> bool:
    """Whether some blank has no non-blank character on one of its sides."""
    return text[0] == " " or text[-1] == " " or _BLANK_THEN.search(text) is not None or _THEN_BLANK.search(text) is not None


class _Pieces(dict):
    """word -> ids of the word after a given prefix."""

    def __init__(self, encoder: Encoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = self.encoder.slowly(self.prefix + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text; no shuffle.

    vocabulary: path of a rank file on the driver.
    """
    path, pattern = vocabulary_file(vocabulary)
    tokens = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in it:
            encoder = encoder or _encoder(tokens.value, pattern)
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                ids = [encoder.encode(texts[i]) for i in part]
                ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(part)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[key, "ids"]
                )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(encode, f"{key} {kind}, ids array<int>")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokens: list[bytes], pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary; workers are used again by later tasks."""
    at = hash((len(tokens), tokens[-1], pattern))
    if at not in _ENCODERS:
        _ENCODERS[at] = Encoder(tokens, pattern)
    return _ENCODERS[at]
