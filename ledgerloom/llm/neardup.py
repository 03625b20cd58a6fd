"""Near-duplicate sections with small edits, by a multi-index Hamming join.

A text's signature has SLOTS slots; each holds BITS bits of the least hash of the text's word shingles under the
slot's own permutation, so two texts differ in a slot with a probability of 1 - J, J being the Jaccard similarity of
their shingle sets. The distance is the number of differing slots. The signature is split into CHUNKS chunks; by the
pigeonhole principle two signatures at distance 2 * CHUNKS - 1 or less have a chunk with at most one wrong slot. All
allowed errors of a chunk are enumerated on both sides by leaving out each of its slots in turn, and equal keys meet.
So every pair of signatures within GUARANTEE differing slots is a candidate, whatever the data. Beyond that distance
candidates come with a probability that falls off slowly (a pair at J = 0.6 is missed in about 0.035 % of cases, at
J = 0.65 in 0.001 %). Candidates whose sets can't be similar enough by a bound that is always true are left out; all
others are checked exactly on the shingle sets themselves.

Texts with equal shingle sets are one class from the start: only a representative gets keys, so copies meet no one.
Keys are sorted within tasks and equal neighbours paired in blocks as they stream by; a key that very many different
texts share is spread over tasks, from the start if a sample of the texts shows it.

Texts with fewer than MIN_WORDS words, and null or empty ones, have no partner. Repeated rows (one section_id) count
once. A null slug is compared as the empty slug. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.llm.grams import WordHashes, mixed, slices, word_kgrams
from ledgerloom.plans.cut import written
from ledgerloom.plans.pairs import pairs_within

SHINGLE = 3
MIN_WORDS = 100
SIMILARITY = 0.6
CHUNKS = 30
CHUNK_SLOTS = 6
SLOTS = CHUNKS * CHUNK_SLOTS
BITS = 8
GUARANTEE = 2 * CHUNKS - 1
#: A run of equal keys is paired against itself in blocks of so many.
BLOCK = 1024
#: Keys that more ids share are paired in cells, over many tasks.
CROWD = 4096
#: One class in so many is looked at to see which keys are crowded; this steers the way, not the result.
LOOK = 32
#: Bits of the bitmap by which candidates are bounded.
MAP_BITS = 2048
#: Shingles of one text are permuted in parts of so many, so that long texts need no more memory.
PART = 8192

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULT = _RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
_LEFT_OUT = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    return np.unique(word_kgrams(words, SHINGLE))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """SLOTS slots of BITS bits."""
    h = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for b in range(0, len(h), PART):
        np.minimum(least, np.min((h[None, b : b + PART] ^ _XOR[:, None]) * _MULT[:, None], axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)


def chunk_keys(signatures: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """For each signature SLOTS keys: each chunk with each of its slots left out. salt: a hash per signature (the slug)."""
    terms = mixed(signatures.astype(np.uint64) + _PLACE) * _PLACE
    whole = terms.reshape(len(signatures), CHUNKS, CHUNK_SLOTS).sum(axis=2, dtype=np.uint64)
    return mixed(np.repeat(whole, CHUNK_SLOTS, axis=1) - terms + _LEFT_OUT + salt[:, None])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _sets(texts: list[str], hashes: WordHashes) -> list[np.ndarray | None]:
    out = []
    for t in texts:
        words = hashes.of(t)
        out.append(shingles(words) if len(words) >= MIN_WORDS else None)
    return out


def bitmap(shingle_set: np.ndarray) -> np.ndarray:
    """MAP_BITS bits: the set's hashes, each as the bit its low part names; as bytes."""
    bits = np.zeros(MAP_BITS, bool)
    bits[(shingle_set & np.uint64(MAP_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def most_common(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most elements that two sets of these sizes and bitmaps (rows of bytes) can have in common: each bit of only one
    of them stands for one element at least that the other lacks."""
    only_a, only_b = (np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a)))
    return np.minimum(n_a - only_a, n_b - only_b)


SIGNED = "section_id string, slug string, lo long, hi long, n int, signature binary, map binary"


def signed_sections(sections: DataFrame) -> DataFrame:
    """SIGNED: the long enough sections; lo and hi digest the shingle set, n is its size."""

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            texts = batch.column(2).to_pylist()
            for part in slices(texts):
                sets = _sets([texts[i] for i in part], hashes)
                keep = [k for k, s in enumerate(sets) if s is not None]
                rows = batch.slice(part.start, len(part)).take(pa.array(keep, pa.int64()))
                lo = np.array([np.bitwise_xor.reduce(mixed(sets[k])) for k in keep], np.uint64)
                hi = np.array([sets[k].sum(dtype=np.uint64) for k in keep], np.uint64)
                columns = [
                    rows.column(0), rows.column(1), _signed(lo), _signed(hi), pa.array([len(sets[k]) for k in keep], pa.int32()),
                    pa.array([signature(sets[k]).tobytes() for k in keep], pa.binary()), pa.array([bitmap(sets[k]).tobytes() for k in keep], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SIGNED.split(", ")])

    own = sections.filter(F.col("section_id").isNotNull() & F.col("text").isNotNull()).select(
        "section_id", F.coalesce(keys.slug(F.col("slug")), F.lit("")).alias("slug"), "text"
    )
    return own.mapInArrow(sign, SIGNED)


def keyed(representatives: DataFrame) -> DataFrame:
    """(key, id): the keys of every representative (id is its lo)."""

    def enumerate_errors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                salt = np.array([hashes[s] for s in part.column(0).to_pylist()], np.uint64)
                ids = part.column(1).to_numpy(zero_copy_only=False)
                signatures = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), SLOTS)
                flat = chunk_keys(signatures, salt).ravel()
                yield pa.RecordBatch.from_arrays([_signed(flat), pa.array(np.repeat(ids, SLOTS))], names=["key", "id"])

    return representatives.select("slug", "lo", "signature").mapInArrow(enumerate_errors, "key long, id long")


def _pairs(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one run, in blocks."""
    for a in range(0, len(ids), BLOCK):
        left = ids[a : a + BLOCK]
        for b in range(a, len(ids), BLOCK):
            right = ids[b : b + BLOCK]
            x, y = np.meshgrid(left, right, indexing="ij")
            keep = np.triu(np.ones(x.shape, bool), 1) if a == b else np.ones(x.shape, bool)
            yield x[keep], y[keep]


def met(key_rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: the distinct pairs of ids that share a key.

    Equal keys are paired as the sorted keys stream by. Keys with more than `crowd` ids are passed on instead, and paired
    in cells: their ids are hashed into parts of about that size, and every two parts meet in a task of their own.
    """

    def neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_ids, passed = np.empty(0, np.int64), np.empty(0, np.int64), None

        def on(k: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(i), pa.array(k)], names=["a", "b", "key"])

        def of(k: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.concatenate([begin, [len(k)]]))
            twos = begin[size == 2]
            yield _couples(i[twos], i[twos + 1])
            for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
                if n > crowd:
                    yield on(k[b : b + n], i[b : b + n])
                else:
                    yield from (_couples(x, y) for x, y in _pairs(i[b : b + n]))

        for batch in it:
            k, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if len(k) and passed is not None:
                n = int(np.searchsorted(k, passed, "right")) if k[0] == passed else 0
                if n:
                    yield on(k[:n], i[:n])
                    k, i = k[n:], i[n:]
                passed = passed if not len(k) else None
            k, i = np.concatenate([held_keys, k]), np.concatenate([held_ids, i])
            last = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            if last:
                yield from of(k[:last], i[:last])
            held_keys, held_ids = k[last:], i[last:]
            if len(held_keys) > crowd:
                yield on(held_keys, held_ids)
                passed = int(held_keys[0])
                held_keys, held_ids = held_keys[:0], held_ids[:0]
        if len(held_keys):
            yield from of(held_keys, held_ids)

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            left, right = np.array(sides[0], np.int64), np.array(sides[1], np.int64)
            if now is not None and now[1] == now[2]:
                yield from (_couples(x, y) for x, y in _pairs(left))
            else:
                for b in range(0, len(left), BLOCK):
                    for c in range(0, len(right), BLOCK):
                        x, y = np.meshgrid(left[b : b + BLOCK], right[c : c + BLOCK])
                        yield _couples(x.ravel(), y.ravel())

        for batch in it:
            for key, lo, hi, own, i in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, lo, hi) != now:
                    yield from out()
                    now, sides = (key, lo, hi), ([], [])
                sides[own != lo].append(i)
        yield from out()

    schema = "a long, b long, key long"
    few = key_rows.filter(F.pmod(F.xxhash64("id"), F.lit(LOOK)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * LOOK > crowd)
    seen = written(few.select("key"), "near-duplicate-crowds")
    known = not seen.isEmpty()
    rest = key_rows.join(seen, "key", "left_anti") if known else key_rows
    runs = rest.repartition("key").sortWithinPartitions("key").mapInArrow(neighbours, schema)
    runs = written(runs, "near-duplicate-runs")
    hot = runs.filter("key is not null").selectExpr("key", "a AS id")
    hot = (hot.unionByName(key_rows.join(seen, "key", "left_semi").select("key", "id")) if known else hot).distinct()
    parts = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / crowd).alias("n"))
    hot = hot.join(parts, "key").select("key", "id", "n", F.pmod(F.xxhash64("id"), "n").alias("own"))
    hot = hot.select("key", "id", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("other"))
    hot = hot.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id")
    more = hot.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(cells, schema)
    return runs.filter("key is null").select("a", "b").unionByName(more.select("a", "b")).distinct()


def _couples(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller id first."""
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], names=["a", "b", "key"])


def possible(pairs: DataFrame, representatives: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets can have the similarity, by their sizes and bitmaps. No pair that has it is left out."""
    side = representatives.select("lo", "n", "map")
    both = pairs.join(side.toDF("a", "n_a", "map_a"), "a").join(side.toDF("b", "n_b", "map_b"), "b").filter(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b"))

    def bounded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MAP_BITS // 8) for c in (3, 5))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 4))
            common = most_common(n_a, n_b, x, y)
            yield batch.select([0, 1]).take(pa.array(np.flatnonzero(common >= similarity * (n_a + n_b - common))))

    return both.select("a", "b", "n_a", "map_a", "n_b", "map_b").mapInArrow(bounded, "a long, b long").distinct()


def similar(pairs: DataFrame, representatives: DataFrame, sections: DataFrame, similarity: float) -> DataFrame:
    """(rep_a, rep_b): the pairs of one slug whose shingle sets have at least the similarity, checked on whole texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("lo")).distinct()
    texts = (
        sections.select("section_id", "text").join(representatives.select("lo", "slug", F.col("rep").alias("section_id")).join(wanted, "lo"), "section_id")
        .groupBy("lo", "slug", "section_id").agg(F.first("text").alias("text"))
    )
    a = texts.toDF("a", "slug_a", "rep_a", "text_a")
    b = texts.toDF("b", "slug_b", "rep_b", "text_b")
    both = pairs.join(a, "a").join(b, "b").filter(F.col("slug_a") == F.col("slug_b"))

    def checked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            keep = []
            for n, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                p, q = shingles(hashes.of(x)), shingles(hashes.of(y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                if common >= similarity * (len(p) + len(q) - common):
                    keep.append(n)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return both.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(checked, "rep_a string, rep_b string")


def linked_classes(sections: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(section_id, rep) of every long enough section, and (rep_a, rep_b), the linked pairs of representatives.

    A representative stands for the sections of one slug with equal shingle sets; it is the least of their ids.
    """
    signed = written(signed_sections(sections), "near-duplicate-signatures")
    representatives = signed.groupBy("slug", "lo", "hi").agg(F.min("section_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n", "signature", "map")])
    representatives = written(representatives, "near-duplicate-classes")
    pairs = written(possible(met(keyed(representatives)), representatives, similarity), "near-duplicate-candidates")
    linked = similar(pairs, representatives, sections, similarity)
    members = signed.select("section_id", "slug", "lo", "hi").distinct().join(representatives.select("slug", "lo", "hi", "rep"), ["slug", "lo", "hi"]).select("section_id", "rep")
    return members, linked


def near_duplicates(sections: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(section_a, section_b), section_a < section_b: every pair of sections of one slug found to be near-duplicates."""
    members, linked = linked_classes(sections, similarity)
    # classes of more than one member are expanded; all others stand for themselves
    within = members.join(members.filter("section_id <> rep").select("rep").distinct(), "rep", "left_semi").select("rep", "section_id")
    same = pairs_within(within, ["rep"], "section_id").toDF("x", "y")
    wide = linked
    for side, out in (("rep_a", "x"), ("rep_b", "y")):
        wide = wide.join(within.toDF(side, out), side, "left").withColumn(out, F.coalesce(out, side))
    return (
        wide.select("x", "y").unionByName(same)
        .select(F.least("x", "y").alias("section_a"), F.greatest("x", "y").alias("section_b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the least node that it is connected with.

    Each round hangs every node's greater neighbours, then the node itself, under the least neighbour (large and small
    stars), so that the number of rounds grows with the logarithm of the longest path. Least neighbours are found by a
    combined aggregate and joined back, so a node with many neighbours gathers no list. Rounds are cut by written tables; the
    driver learns only whether something moved.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "components")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def groups(sections: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(section_id, group_id, n_links) of every long enough section.

    group_id is the least section id among those connected by near-duplicates, the section's own where it has none;
    n_links counts the representatives of other texts that the section's text is linked with.
    """
    members, linked = linked_classes(sections, similarity)
    linked = written(linked.distinct(), "near-duplicate-links")
    roots = components(linked.toDF("a", "b")).toDF("rep", "root")
    links = linked.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    rows = members.join(roots, "rep", "left").join(links, "rep", "left")
    return rows.select("section_id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
