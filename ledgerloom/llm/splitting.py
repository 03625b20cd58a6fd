"""Splitting sections over a size limit at natural boundaries, and auditing chunks against the rule.

A text's cut positions carry a strength: paragraph, line, sentence, blank, or none where no blank lies within reach.
Over the strengths stands a sparse-table range-maximum index (level j holds the strongest of 2^j positions, the
rightmost of equals), so that the strongest cut of any permissible window is read off in two look-ups. A piece ends at
the strongest cut of the window up to the limit; the next one begins at the strongest cut of the overlap window
before it.

The audit puts itself at the places where the chunks as they are begin and end, and asks the index what the splitter
would have found there: a chunk is oversize if the strongest cut lies before its end; a place inside a word is a defect if
from the word's beginning a cut lies in the permissible window (a run longer than the limit has none, and must be cut
hard); the strongest beginning in the overlap window is the first candidate for where two chunks overlap.

Blank means Unicode white space. Null and blank texts give no pieces; a text within the limit is one piece. A run of
non-blank characters longer than the limit is cut hard. Chunks with a null text or chunk_id break no rule; those without a
section_id can only be oversize; a null ordinal has no predecessor. Repeated rows count once. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.plans.cut import written
from ledgerloom.plans.once import once

#: 512 tokens of 3.6 characters, and 64 tokens of overlap.
LIMIT = 1843
OVERLAP = 230
LEAST_OVERLAP = 40

PARAGRAPH, LINE, SENTENCE, SPACE, HARD = 4, 3, 2, 1, 0
_CUT = re.compile(r"(?P<p>\s*\n\s*\n\s*)|(?P<l>[^\S\n]*\n[^\S\n]*)|(?P<s>(?<=[.!?。！？])[^\S\n]+)|(?P<b>[^\S\n]+)")
_STRENGTH = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "b": SPACE}


class BoundaryIndex:
    """The boundaries of one text, for strongest-cut queries."""

    def __init__(self, text: str):
        self.text = text
        gaps = [(m.start(), m.end(), _STRENGTH[m.lastgroup]) for m in _CUT.finditer(text)]
        self.ends = np.array([g[0] for g in gaps], np.int64)  # a piece may end here
        self.starts = np.array([g[1] for g in gaps], np.int64)  # and the next may start here
        strength = np.array([g[2] for g in gaps], np.int64)
        self.levels = [(strength << 40) | np.arange(len(gaps))]

    def strongest(self, lo: int, hi: int) -> int | None:
        """The number of the strongest gap among lo..hi-1, rightmost of equals."""
        if lo >= hi:
            return None
        j = (hi - lo).bit_length() - 1
        while len(self.levels) <= j:  # levels are built as far as windows reach
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(low[:-step], low[step:]))
        best = max(int(self.levels[j][lo]), int(self.levels[j][hi - (1 << j)]))
        return best & ((1 << 40) - 1)

    def next_end(self, at: int, last: int, limit: int = LIMIT, least: int = 0) -> int:
        """Where a piece that begins at `at` ends: at last if that is within the limit, else at the strongest cut up to the limit
        (from `least` characters on), or hard at the limit."""
        if last - at <= limit:
            return last
        lo, hi = np.searchsorted(self.ends, (at + max(least, 1), at + limit + 1))
        k = self.strongest(int(lo), int(hi))
        return int(self.ends[k]) if k is not None else at + limit

    def next_start(self, end: int, overlap: int = OVERLAP, least: int = LEAST_OVERLAP) -> int:
        """Where the piece after one that ends at `end` begins: at the strongest cut of the overlap window before it."""
        lo, hi = np.searchsorted(self.starts, (end - overlap, end - least + 1))
        k = self.strongest(int(lo), int(hi))
        return int(self.starts[k]) if k is not None else end - overlap

    def avoidable(self, at: int, limit: int = LIMIT) -> bool:
        """Whether position at parts a word that need not be parted: no cut lies there, and from the word's beginning on there is
        one, or the text's end, within the limit."""
        size = len(self.text)
        if not 0 < at < size:
            return False
        k = int(np.searchsorted(self.ends, at, "right"))  # the gaps before k begin at or before this place
        if k and at <= self.starts[k - 1]:
            return False
        begin = int(self.starts[k - 1]) if k else 0
        reach = int(np.searchsorted(self.ends, begin + limit, "right"))
        return self.strongest(k, reach) is not None or size - begin <= limit


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST_OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of each piece of a text: at most limit characters, consecutive ones overlapping by least..overlap
    characters. Outer blanks belong to no piece."""
    if not text or not text.strip():
        return
    at, last = len(text) - len(text.lstrip()), len(text.rstrip())
    if last - at <= limit:
        yield at, last
        return
    index = BoundaryIndex(text)
    while last - at > limit:
        # half the limit at least, and far enough that stepping back by the overlap still moves on
        end = index.next_end(at, last, limit, max(limit // 2, overlap + 1))
        yield at, end
        at = index.next_start(end, overlap, least)
    yield at, last


PIECES = "section_id string, ordinal int, start int, text string, token_estimate int"


def split_sections(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(section_id, ordinal, start, text, token_estimate): the pieces of every section; no shuffle but for repeated rows."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [
                (sid, n, a, text[a:b], max(1, round((b - a) / 3.6)))
                for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for n, (a, b) in enumerate(pieces(text, limit, overlap))
            ]
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=["section_id", "ordinal", "start", "text", "token_estimate"]
            )

    return once(sections.select("section_id", "text")).mapInArrow(cut, PIECES)


def overlaps(before: str, text: str, least: int = LEAST_OVERLAP) -> bool:
    """Whether some text of at least so many characters both ends the one and begins the other."""
    if len(text) < least:
        return False
    head, n = text[:least], len(before)
    at = before.find(head, max(0, n - len(text)))
    while at >= 0:
        if text.startswith(before[at:]):
            return True
        at = before.find(head, at + 1)
    return False


def places(text: str, chunk: str) -> Iterator[int]:
    """Where a chunk stands in a text."""
    at = text.find(chunk) if chunk else -1
    while at >= 0:
        yield at
        at = text.find(chunk, at + 1)


def cuts_word(index: BoundaryIndex, chunk: str, limit: int = LIMIT) -> bool:
    """Whether the chunk, wherever it stands in the section, begins or ends inside a word that need not be parted.

    False if it stands nowhere, or is empty, or stands at least once without parting a word.
    """
    found = False
    for at in places(index.text, chunk):
        if not (index.avoidable(at, limit) or index.avoidable(at + len(chunk), limit)):
            return False
        found = True
    return found


def follows(before: str, text: str, least: int = LEAST_OVERLAP) -> bool:
    """Whether a chunk overlaps the one before it: where the splitter would have begun it, or else anywhere."""
    start = BoundaryIndex(before[-2 * OVERLAP :]).next_start(min(len(before), 2 * OVERLAP), OVERLAP, least) if len(before) >= least else 0
    start += max(0, len(before) - 2 * OVERLAP)
    return len(before) - start >= least and start >= 0 and text.startswith(before[start:]) or overlaps(before, text, least)


FOUND = "chunk_id string, defect string"
#: Chunks of one section are looked at by so many ordinals a time, and those without an ordinal in so many heaps, so that a
#: section with very many chunks doesn't gather in one task.
BLOCK, HEAPS = 4096, 64


def audit(chunks: DataFrame, sections: DataFrame, limit: int = LIMIT, least: int = LEAST_OVERLAP) -> DataFrame:
    """(chunk_id, defect): oversize, no_overlap and cut_word, each once per chunk.

    Sections and chunks are co-partitioned by section and block of ordinals in one exchange and sorted by ordinal; each
    task streams through and holds one section's text and the chunks of two ordinals. The last chunks of a block are also
    sent to the next one, to be held against. Chunks without a section key are spread by their own.
    """
    key = F.coalesce(keys.section_key(F.col("section_id")), F.concat(F.lit("!"), F.col("chunk_id")))
    own = chunks.filter(F.col("chunk_id").isNotNull()).select(key.alias("key"), F.col("ordinal").cast("int").alias("ordinal"), "chunk_id", "text")
    block = F.coalesce(F.floor(F.col("ordinal") / BLOCK).cast("int"), (-1 - F.pmod(F.xxhash64("chunk_id"), F.lit(HEAPS))).cast("int") + F.lit(-(1 << 30)))
    own = own.withColumn("block", block)
    # what lies beyond the first block, from key columns alone; nearly always nothing
    beyond = written(own.filter("block <> 0 AND key NOT LIKE '!%'").select("key", "block").distinct(), "chunk-blocks")
    held = sections.filter(F.col("text").isNotNull()).select(keys.section_key(F.col("section_id")).alias("key"), "text")
    held = held.select("key", F.lit(0).alias("block"), "text").unionByName(held.join(beyond, "key").select("key", "block", "text")) if not beyond.isEmpty() else held.withColumn("block", F.lit(0))
    own = own.filter(F.col("text").isNotNull())
    edge = F.pmod(F.col("ordinal"), F.lit(BLOCK)) == BLOCK - 1
    blocks = F.when(edge, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))
    own = own.select("key", F.posexplode(blocks).alias("again", "block"), "ordinal", "chunk_id", "text")
    none = F.lit(None)
    both = held.select("key", "block", F.lit(0).alias("kind"), none.cast("int").alias("ordinal"), none.cast("string").alias("chunk_id"), "text").unionByName(
        own.select("key", "block", F.lit(1).alias("kind"), "ordinal", F.when(F.col("again") == 0, F.col("chunk_id")).alias("chunk_id"), "text")
    )
    both = both.repartition("key", "block").sortWithinPartitions("key", "block", "kind", "ordinal", "chunk_id").select("key", "block", "kind", "ordinal", "chunk_id", "text")

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, number, here, before = None, None, None, {}, {}
        for batch in it:
            found: list[tuple[str, str]] = []
            for key, block, kind, ordinal, chunk, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, block) != now:
                    now, index, number, here, before = (key, block), None, None, {}, {}
                if kind == 0:
                    if index is None or index.text != text:
                        index = BoundaryIndex(text)
                    continue
                if ordinal != number:
                    before = here if number is not None and ordinal == number + 1 else {}
                    number, here = ordinal, {}
                if ordinal is not None:
                    here[text] = True
                if chunk is None:  # sent on to be held against
                    continue
                if len(text) > limit and BoundaryIndex(text).next_end(0, len(text), limit) < len(text):
                    found.append((chunk, "oversize"))
                if any(not follows(t, text, least) for t in before):
                    found.append((chunk, "no_overlap"))
                if index is not None and cuts_word(index, text, limit):
                    found.append((chunk, "cut_word"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in (0, 1)], names=["chunk_id", "defect"])

    return both.mapInArrow(stream, FOUND).distinct()
