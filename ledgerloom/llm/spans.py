"""Long exact spans shared between records, by repeated-phrase automata.

1. Confirming recurring passages: of every WINDOW consecutive character grams the least hash is kept, so two texts that
   share LEAST = GRAM + WINDOW - 1 characters keep an equal gram. Grams kept under two accessions are recurring; the
   one with the least hash is the one their text is taken from.
2. Compiling sharded automata: recurring passages are hashed, by record, into shards of about SHARD_PASSAGES passages, each
   an Aho-Corasick automaton. Every record that keeps one of a shard's grams is sent to it (no other can hold one of its
   spans); a shard through which many characters pass is cut into slices. Rows come sorted by shard and slice, passages
   first, so that a task compiles each automaton once and then streams records through it.
3. Locating every occurrence: a span of LEAST characters round a passage reaches REACH characters beyond it to the left
   or to the right, so occurrences meet by the hash of the passage with that much text on either side. Those that meet
   under one accession only are left out.
4. Up to CROWD places that meet are paired, and the common runs of each two texts are measured at the offset found.
   Where more meet, in one text or in many, nothing is paired: every window of LEAST characters round the places is named
   by a 128-bit digest, and a window that several texts hold is a shared span of each. Texts that hold the same windows
   form a set.
So all work grows with the number of occurrences, however many records share one. Sets of a crowd are the only lists of
members; they are paired last, where pairs are asked for, in cells spread over tasks.

Equal texts are one class from the start (by a 64-bit hash): grams, occurrences and windows are made once per class, and
only the pairs asked for are spread over its members.

Every character counts, blanks and line ends too. Texts under LEAST characters, null texts and null section ids share
nothing. Sections of one accession are no pair; an accession without eighteen digits is compared as its text, a null
one as its own section's. Repeated rows count once. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.llm.grams import TOP, mixed, slices, winnow
from ledgerloom.plans.cut import written
from ledgerloom.plans.pairs import pairs_within

LEAST = 300
GRAM = 150
WINDOW = LEAST - GRAM + 1
REACH = (LEAST - GRAM) // 2
STEP = 500_000
#: An automaton holds about so many passages (150 characters each).
SHARD_PASSAGES = 2000
#: So many places that meet are paired; more are counted by windows. Both ways find the same.
CROWD = 64
#: A slice of a shard has about so many characters pass through it.
SLICE_CHARS = 16_000_000

_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64, for one block."""
    if not _POWERS:
        n = STEP + LEAST + 1
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_grams(c: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of every size consecutive characters of one block."""
    if len(c) < size:
        return np.empty(0, np.uint64)
    up, down = _powers()
    v = mixed(c.astype(np.uint64) + np.uint64(1)) * up[: len(c)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    return mixed((total[size:] - total[:-size]) * down[: len(c) - size + 1])


def passages_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the kept grams of each text, each hash once per text, at its first place."""
    c = codes("".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    places, hashes = [], []
    for b in range(0, max(1, len(c)), STEP):
        h = char_grams(c[b : b + STEP + LEAST])
        if not len(h):
            continue
        for e in ends[(ends > b) & (ends < b + len(h) + GRAM)].tolist():
            h[max(0, e - GRAM + 1 - b) : max(0, e - b)] = TOP  # a gram that runs over into the next text
        at = winnow(h, WINDOW)
        at = at[h[at] != TOP]
        places.append(at + b)
        hashes.append(h[at])
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    which = np.searchsorted(ends, place, "right")
    order = np.lexsort((place, value, which))
    which, place, value = which[order], place[order], value[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (value[1:] != value[:-1])
    return which[new], (place - starts[which])[new], value[new]


def _own(sections: DataFrame) -> DataFrame:
    """(cid, acc, section_id, text): the sections that can share a span; cid (of the text) and acc are 64-bit keys."""
    acc = F.coalesce(keys.accession_key(F.col("accession")), F.concat(F.lit("!"), F.col("section_id")))
    return sections.filter(F.col("section_id").isNotNull() & (F.length("text") >= LEAST)).select(
        F.xxhash64("text").alias("cid"), F.coalesce(keys.accession_number(F.col("accession")), F.xxhash64(acc)).alias("acc"), "section_id", "text"
    )


def kept_grams(own: DataFrame) -> DataFrame:
    """(gram, acc, cid, pos): the grams of each text, each at its first place."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(2).to_pylist()
            for part in slices(texts):
                which, place, value = passages_of([texts[i] for i in part])
                rows = batch.slice(part.start, len(part)).select([0, 1]).take(pa.array(which))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), rows.column(1), rows.column(0), pa.array(place.astype(np.int32))], names=["gram", "acc", "cid", "pos"]
                )

    return own.select("cid", "acc", "text").mapInArrow(scan, "gram long, acc long, cid long, pos int")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def compiled(passages: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for p in passages:
        automaton.add_word(p, 1)
    automaton.make_automaton()
    return automaton


def occurrences_in(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, int, bool]]:
    """(hash, position, left) of each occurrence with its surroundings on the left or on the right."""
    for last, _ in automaton.iter(text):
        start, end = last + 1 - GRAM, last + 1
        if start >= REACH:
            yield _hash("<" + text[start - REACH : end]), start, True
        if end + REACH <= len(text):
            yield _hash(">" + text[start : end + REACH]), start, False


ROUTED = "shard int, slice int, cid long, text string"
OCCURRENCE = "around long, cid long, pos int, left boolean"


def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences in rows of ROUTED, sorted by shard, slice and cid: rows without cid have the passages of the shard."""
    now, passages, automaton = None, [], None
    for batch in batches:
        rows: list[tuple] = []
        for shard, slice_, cid, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (shard, slice_) != now:
                # the slices of one shard that come one after the other share the automaton
                passages, automaton = ([], None) if now is None or shard != now[0] else (None, automaton)
                now = shard, slice_
            if cid is None:
                if passages is not None:
                    passages.append(text)
                continue
            if passages is not None:
                automaton, passages = compiled(passages), None
            rows += [(h, cid, at, left) for h, at, left in occurrences_in(text, automaton)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["around", "cid", "pos", "left"])


def dealt(grams: DataFrame, shard_passages: int = SHARD_PASSAGES) -> DataFrame:
    """(shard, rep, cid, pos): where each class keeps a recurring gram, the least class that keeps it, and the passage's shard.

    Passages of one record go to one shard, those of a record with very many to several.
    """
    recurring = (
        grams.groupBy("gram").agg(F.min("cid").alias("rep"), F.max("cid").alias("d"), F.min("acc").alias("lo"), F.max("acc").alias("hi"))
        .filter("rep <> d AND lo <> hi").select("gram", "rep")
    )
    recurring = written(recurring, "span-passages")
    shards = max(1, -(-recurring.count() // shard_passages))
    per = recurring.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / shard_passages).alias("parts"))
    shard = F.pmod(F.xxhash64("rep", F.pmod("gram", "parts")), F.lit(shards)).cast("int")
    return grams.select("gram", "cid", "pos").join(recurring.join(per, "rep").select("gram", "rep", shard.alias("shard")), "gram").select("shard", "rep", "cid", "pos")


def routed(kept: DataFrame, texts: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """ROUTED rows: each shard's passages, and the texts that keep one of its grams, sorted for located()."""
    routes = kept.select("shard", "cid").distinct()
    sized = routes.join(texts.select("cid", F.length("text").alias("n")), "cid")
    slices_ = sized.groupBy("shard").agg(F.ceil(F.sum("n") / slice_chars).cast("int").alias("slices"))
    own = routes.join(slices_, "shard").select("shard", F.pmod(F.xxhash64("cid"), F.col("slices")).cast("int").alias("slice"), "cid").join(texts, "cid").select("shard", "slice", "cid", "text")
    held = kept.filter("cid = rep").select("shard", "cid", "pos").distinct().join(texts, "cid").select("shard", F.substring("text", F.col("pos") + 1, F.lit(GRAM)).alias("text"))
    # passages are sent once to each slice of their shard
    held = held.join(slices_, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("bigint").alias("cid"), "text")
    return held.unionByName(own).repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.col("cid").asc_nulls_first())


def common_runs(a: np.ndarray, b: np.ndarray, offset: int, least: int = LEAST) -> list[tuple[int, int]]:
    """(start in a, length) of the equal runs of at least so many characters between a and b shifted by offset."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi - lo < least:
        return []
    same = np.concatenate([[False], a[lo:hi] == b[lo - offset : hi - offset], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    begin, end = edge[::2], edge[1::2]
    return [(int(s) + lo, int(e - s)) for s, e in zip(begin, end) if e - s >= least]


def windows_of(text: str, firsts: list[int], lasts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, digests as pairs of 64-bit numbers) of the windows of LEAST characters that begin in one of the ranges."""
    begins = np.zeros(max(0, len(text) - LEAST + 1) + 1, np.int64)
    top = len(begins) - 1
    for a, b in zip(firsts, lasts):
        if a < top:
            begins[a] += 1
            begins[min(b + 1, top)] -= 1
    starts = np.flatnonzero(np.cumsum(begins[:-1]) > 0)
    raw = memoryview(text.encode("utf-32-le", "surrogatepass"))
    digest = xxhash.xxh3_128_digest
    named = b"".join([digest(raw[4 * s : 4 * (s + LEAST)]) for s in starts.tolist()])
    return starts, np.frombuffer(named, ">i8").reshape(-1, 2)


WINDOWS = "hi long, lo long, cid long, pos int"


def named_windows(places: DataFrame) -> DataFrame:
    """WINDOWS rows of (cid, text, firsts, lasts)."""

    def name(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for cid, text, firsts, lasts in zip(*(c.to_pylist() for c in batch.columns)):
                starts, digests = windows_of(text, firsts, lasts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[:, 0].astype(np.int64)), pa.array(digests[:, 1].astype(np.int64)), pa.array(np.full(len(starts), cid, np.int64)), pa.array(starts.astype(np.int32))],
                    names=["hi", "lo", "cid", "pos"],
                )

    return places.select("cid", "text", "firsts", "lasts").mapInArrow(name, WINDOWS)


def crowd_windows(places: DataFrame, texts: DataFrame, bounds: DataFrame) -> DataFrame:
    """(x, y, cid, pos): the windows round crowded places that several classes hold under several accessions, x and y naming
    the set of classes that hold them. Rows are as many as such windows, however many records share them."""
    first = F.col("pos") - F.when(F.col("left"), LEAST - GRAM).otherwise(REACH)
    last = F.col("pos") - F.when(F.col("left"), REACH).otherwise(0)
    ranges = places.select("cid", F.greatest(first, F.lit(0)).alias("first"), last.alias("last")).distinct()
    ranges = ranges.groupBy("cid").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))  # of one text
    windows = written(named_windows(texts.join(ranges, "cid")), "span-windows")
    sets = (
        windows.select("hi", "lo", "cid").distinct().groupBy("hi", "lo")
        .agg(F.min("cid").alias("c"), F.max("cid").alias("d"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"))
        .filter("c <> d").select("hi", "lo", "x", "y")
    )
    rows = written(windows.join(sets, ["hi", "lo"]).select("x", "y", "cid", "pos"), "span-sets")
    kept = rows.select("x", "y", "cid").distinct().join(bounds, "cid").groupBy("x", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("x", "y")
    return rows.join(kept, ["x", "y"], "left_semi")


SPANS = "cid_a long, cid_b long, start_a int, start_b int, n_chars int"


def paired_spans(places: DataFrame, texts: DataFrame, bounds: DataFrame) -> DataFrame:
    """SPANS of places that meet in small numbers: each two classes are held side by side at the offset found."""
    side = places.select("around", "cid", "pos")
    met = (
        side.toDF("around", "cid_a", "pos_a").join(side.toDF("around", "cid_b", "pos_b"), "around").filter("cid_a < cid_b")
        .select("cid_a", "cid_b", (F.col("pos_a") - F.col("pos_b")).alias("offset")).distinct()
        .join(bounds.toDF("cid_a", "lo_a", "hi_a"), "cid_a").join(bounds.toDF("cid_b", "lo_b", "hi_b"), "cid_b")
        .filter("least(lo_a, lo_b) <> greatest(hi_a, hi_b)")
    )
    sided = met.join(texts.toDF("cid_a", "text_a"), "cid_a").join(texts.toDF("cid_b", "text_b"), "cid_b")

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for a, b, offset, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(a, b, start, start - offset, n) for start, n in common_runs(codes(s), codes(t), offset)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=["cid_a", "cid_b", "start_a", "start_b", "n_chars"]
            )

    return sided.select("cid_a", "cid_b", "offset", "text_a", "text_b").mapInArrow(measure, SPANS)


def class_spans(own: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """paired_spans, crowd_windows, and (cid, lo, hi), the least and greatest accession of each class with recurring passages:
    together the spans that classes of several accessions share. Of a class's own copies nothing is said here."""
    grams = written(kept_grams(own), "span-grams")
    # few records hold recurring passages; from here on only their texts are moved
    kept = written(dealt(grams), "span-routes")
    touching = kept.select("cid").distinct()
    texts = own.join(touching, "cid", "left_semi").groupBy("cid").agg(F.min("acc").alias("lo"), F.max("acc").alias("hi"), F.first("text").alias("text"))
    texts = written(texts, "span-texts")
    bounds, texts = texts.select("cid", "lo", "hi"), texts.select("cid", "text")
    found = written(routed(kept, texts).mapInArrow(located, OCCURRENCE), "span-occurrences")
    met = (
        found.join(bounds, "cid").groupBy("around")
        .agg(F.min("cid").alias("c"), F.max("cid").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("c <> d AND lo <> hi").select("around", (F.col("n") > crowd).alias("crowded"))
    )
    places = written(found.join(met, "around"), "span-places")
    crowded = places.filter("crowded")
    windows = own.sparkSession.createDataFrame([], "x long, y long, cid long, pos int") if crowded.isEmpty() else crowd_windows(crowded, texts, bounds)
    return paired_spans(places.filter("NOT crowded"), texts, bounds), windows, bounds


def shared_pairs(sections: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(section_a, section_b), section_a < section_b: the pairs of sections of two accessions that share a span."""
    own = _own(sections)
    members = own.select("cid", "acc", "section_id").distinct()
    spans, windows, _ = class_spans(own, crowd)
    sets = windows.select("x", "y", "cid").distinct()
    linked = spans.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).unionByName(pairs_within(sets, ["x", "y"], "cid").select("a", "b")).distinct()
    wide = linked.join(members.toDF("a", "acc_a", "p"), "a").join(members.toDF("b", "acc_b", "q"), "b").filter("acc_a <> acc_b AND p <> q")
    copies = pairs_within(members, ["cid"], "section_id", ("acc",), unlike=F.expr("acc_a <> acc_b AND a <> b"))
    both = wide.select(F.least("p", "q").alias("section_a"), F.greatest("p", "q").alias("section_b")).unionByName(copies.select(F.col("a").alias("section_a"), F.col("b").alias("section_b")))
    return both.distinct()


def shared_amounts(sections: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(section_id, n_chars, n_shared): how much of each section stands in sections of other accessions.

    Overlapping spans count once; a text that stands under two accessions is shared as a whole. Every section id has one
    row; a null text has 0 characters. Several texts under one section id give the greatest values.
    """
    own = _own(sections)
    spans, windows, _ = class_spans(own, crowd)
    spans = written(spans, "span-shares")
    sides = spans.selectExpr("cid_a AS cid", "cid_b AS other", "start_a AS start", "n_chars AS n").unionAll(spans.selectExpr("cid_b", "cid_a", "start_b", "n_chars"))
    places = sides.select("cid", "start", "n").unionByName(windows.select("cid", F.col("pos").alias("start"), F.lit(LEAST).alias("n"))).distinct()
    # the covered length is the sum of what each span adds beyond the furthest end before it
    before = F.expr("max(start + n) over (partition by cid order by start, n rows between unbounded preceding and 1 preceding)")
    added = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(F.col("before"), F.lit(0))))
    shared = places.withColumn("before", before).groupBy("cid").agg(F.sum(added).alias("n"))
    members = own.select("cid", "acc", "section_id", F.length("text").alias("size")).distinct()
    copied = members.groupBy("cid").agg(F.min("acc").alias("lo"), F.max("acc").alias("hi")).filter("lo <> hi").select("cid", F.lit(True).alias("whole"))
    per = members.join(shared, "cid", "left").join(copied, "cid", "left").groupBy("section_id").agg(F.max(F.when(F.col("whole"), F.col("size")).otherwise(F.col("n"))).alias("n_shared"))
    sizes = sections.filter(F.col("section_id").isNotNull()).groupBy("section_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    return sizes.join(per, "section_id", "left").select("section_id", "n_chars", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
