"""Evaluation texts leaking into training text, found by winnowing.

Of every WINDOW consecutive word k-grams the least hash is kept. A run of MIN_WORDS = WINDOW + GRAM - 1 words that two
texts share holds a whole window of equal hashes, so both keep at least one equal fingerprint: no run of that length
is missed. Equal fingerprints are extended word by word to both sides, and runs that reach MIN_WORDS are reported.

The evaluation side is read first. If its words stay under INDEX_WORDS it is sent to every executor as arrays (that
is the checked bound); beyond it the fingerprints of both sides meet in a join, and only documents with an equal
fingerprint are extended, against the passages they met.

Nulls: documents without text, and cases without passages, give nothing. Repeated rows give one row. Empty tables give
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.grams import WordHashes, slices, winnow, word_kgrams

GRAM = 6
WINDOW = 8
MIN_WORDS = GRAM + WINDOW - 1
#: Variables of a case that hold its passages (fixed values of the data).
PASSAGES = ("section_text", "current_text", "prior_text")
#: The evaluation side is sent to the executors up to so many words (16 bytes each), joined beyond.
INDEX_WORDS = 4_000_000

FOUND = "doc_id long, case_id string, doc_word int, case_word int, n_words int"


def passages(cases: DataFrame) -> DataFrame:
    """(case_id, passage): the texts of each case."""
    return cases.select("case_id", F.explode(F.array(*[F.col("variables")[p] for p in PASSAGES])).alias("passage")).filter(
        F.col("case_id").isNotNull() & F.col("passage").isNotNull()
    ).distinct()


class Index:
    """Passages as word hashes, their k-grams sorted for look-up."""

    def __init__(self, case_ids: list[str], texts: list[str]):
        hashes = WordHashes()
        self.case_ids = case_ids
        self.words = [hashes.of(t) for t in texts]
        grams = [word_kgrams(w, GRAM) for w in self.words]
        which = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.empty(0, np.int32)
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram, self.which, self.at = flat[order], which[order], at[order]

    def runs(self, words: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[str, int, int, int]]:
        """(case_id, doc_word, case_word, n_words) of each shared run of MIN_WORDS or more that a fingerprint lies in."""
        if not len(self.gram) or not len(places):
            return
        lo = np.searchsorted(self.gram, hashes, "left")
        hi = np.searchsorted(self.gram, hashes, "right")
        seen: set[tuple[int, int, int]] = set()
        for p, a, b in zip(places[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for k in range(a, b):
                which, q = int(self.which[k]), int(self.at[k])
                other = self.words[which]
                back = _agree(words[:p][::-1], other[:q][::-1])
                start = p - back, q - back
                if (which, *start) in seen:
                    continue
                seen.add((which, *start))
                n = back + _agree(words[p:], other[q:])
                if n >= MIN_WORDS:
                    yield self.case_ids[which], start[0], start[1], n


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values are the same; looked at in growing steps, for most runs are short."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        end = min(n, done + step)
        differ = np.flatnonzero(a[done:end] != b[done:end])
        if len(differ):
            return done + int(differ[0])
        done, step = end, step * 4
    return n


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = word_kgrams(words, GRAM)
    places = winnow(grams, WINDOW)
    return places, grams[places]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=["doc_id", "case_id", "doc_word", "case_word", "n_words"]
    )


def leaks(documents: DataFrame, cases: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, case_id, doc_word, case_word, n_words): every shared run of at least MIN_WORDS words, at its longest.

    doc_word and case_word count words from 0 in the document and in the passage.
    """
    spark = documents.sparkSession
    texts = passages(cases)
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    size = texts.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    if size // 2 > index_words:  # no more than a word for two characters
        return _joined(docs, texts)
    rows = texts.collect()
    index = spark.sparkContext.broadcast(Index([r.case_id for r in rows], [r.passage for r in rows]))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = index.value, WordHashes()
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for part in slices(texts):
                for i in part:
                    words = hashes.of(texts[i])
                    places, grams = fingerprints(words)
                    rows += [(ids[i], *r) for r in own.runs(words, places, grams)]
            yield _found(rows)

    return docs.mapInArrow(scan, FOUND)


def _joined(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The same by joining fingerprints, for evaluation sets of any size."""

    def printed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            grams = [np.unique(fingerprints(hashes.of(t))[1]).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))), pa.array(np.concatenate(grams) if grams else np.empty(0, np.int64))],
                names=["id", "gram"],
            )

    def extended(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            rows = []
            for doc, text, case, passage in zip(*(c.to_pylist() for c in batch.columns)):
                words = hashes.of(text)
                rows += [(doc, *r) for r in Index([case], [passage]).runs(words, *fingerprints(words))]
            yield _found(rows)

    texts = texts.withColumn("passage_key", F.xxhash64("case_id", "passage"))
    test = texts.select("passage_key", "passage").mapInArrow(printed, "id long, gram long").withColumnRenamed("id", "passage_key")
    met = docs.mapInArrow(printed, "id long, gram long").withColumnRenamed("id", "doc_id").join(test, "gram").select("doc_id", "passage_key").distinct()
    return met.join(docs, "doc_id").join(texts, "passage_key").select("doc_id", "text", "case_id", "passage").mapInArrow(extended, FOUND)
