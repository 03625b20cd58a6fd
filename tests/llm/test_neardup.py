import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import neardup
from ledgerloom.llm.grams import WORD, WordHashes, mixed, slide, winnow

VOCABULARY = [f"w{n}" for n in range(3000)]


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[k] = rng.choice(VOCABULARY)
            case 1:
                out.insert(k, rng.choice(VOCABULARY))
            case _:
                del out[k]
    return out


def corpus():
    rng = random.Random(7)
    rows = []
    for n in range(40):
        base = rng.choices(VOCABULARY, k=rng.randrange(110, 300))
        rows.append((f"s{n:03}", "alpha" if n % 2 else " Alpha ", " ".join(base)))
        rows.append((f"s{n:03}x", "ALPHA", " ".join(edited(base, rng.randrange(0, 12), rng))))
        rows.append((f"s{n:03}y", "beta", " ".join(base)))
    rows += [("copy1", "beta", rows[2][2]), ("copy2", "beta", rows[2][2]), ("copy2", "beta", rows[2][2])]
    rows += [("short", "beta", "one two three"), ("none", "beta", None), ("void", "beta", ""), (None, "beta", rows[2][2]), ("noslug", None, rows[2][2]), ("long", "beta", "word " * 50_000)]
    return rows


def brute(rows):
    sets = {}
    for key, slug, text in rows:
        words = [w.lower() for w in WORD.findall(text or "")]
        if key is not None and len(words) >= 100:
            sets[key] = ((slug or "").strip().lower(), set(zip(words, words[1:], words[2:])))
    out = set()
    for (a, (p, x)), (b, (q, y)) in itertools.combinations(sorted(sets.items()), 2):
        if p == q and len(x & y) >= 0.6 * len(x | y):
            out.add((a, b))
    return out


def test_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "section_id string, slug string, text string, key string, lo int")
    got = [tuple(r) for r in neardup.near_duplicates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "section_id string, slug string, text string")
    got = [tuple(r) for r in neardup.groups(df).collect()]
    long = {k for k, _, t in rows if k is not None and len(WORD.findall(t or "")) >= 100}
    assert {g[0]: g[1] for g in got} == union_find(long, brute(rows)) and len(got) == len(long)
    links = {g[0]: g[2] for g in got}
    assert links["copy1"] == 0 and links["s000x"] == links["s000"]


def test_components(spark):
    rng = random.Random(9)
    edges = [(f"p{n:03}", f"p{n + 1:03}") for n in range(60)] + [("hub", f"x{n}") for n in range(40)] + [tuple(sorted(rng.sample([f"r{n}" for n in range(80)], 2))) for _ in range(50)] + [("q", "q"), ("x1", "hub")]
    df = spark.createDataFrame(edges, "a string, b string")
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.root for r in neardup.components(df).collect()} == union_find(nodes, [e for e in edges if e[0] != e[1]])
    assert neardup.components(df.limit(0)).collect() == []


def test_guarantee_of_the_index():
    """Signatures with GUARANTEE differing slots or fewer share a key, wherever they differ."""
    rng = np.random.default_rng(3)
    salt = np.zeros(2, np.uint64)
    for _ in range(300):
        a = rng.integers(0, 1 << neardup.BITS, neardup.SLOTS, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(neardup.SLOTS, neardup.GUARANTEE, replace=False)
        b[at] ^= rng.integers(1, 1 << neardup.BITS, len(at), dtype=np.uint8)
        keys = neardup.chunk_keys(np.stack([a, b]), salt)
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_slots_estimate_similarity():
    rng = random.Random(1)
    base = rng.choices(VOCABULARY, k=400)
    h = WordHashes()
    a = neardup.shingles(h.of(" ".join(base)))
    b = neardup.shingles(h.of(" ".join(edited(base, 20, rng))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((neardup.signature(a) == neardup.signature(b)).mean() - true) < 0.15


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 12))
def test_winnowing_against_brute_force(values, w):
    h = np.array(values, np.uint64)
    w = min(w, len(h))
    want = sorted({i for j in range(len(h) - w + 1) for i in range(j, j + w) if h[i] == h[j : j + w].min()})
    assert winnow(h, w).tolist() == want
    assert slide(h, w, np.maximum).tolist() == [h[j : j + w].max() for j in range(len(h) - w + 1)]


def test_mixing_is_one_to_one():
    assert len(np.unique(mixed(np.arange(100_000, dtype=np.uint64)))) == 100_000


def test_crowded_keys(spark):
    rng = random.Random(12)
    rows = [(k, rng.randrange(400)) for k in range(30) for _ in range(rng.choice([1, 1, 2, 3, 30, 90]))] + [(77, n) for n in range(250)]
    want = {(a, b) for k in {k for k, _ in rows} for a, b in itertools.combinations(sorted({i for q, i in rows if q == k}), 2)}
    df = spark.createDataFrame(rows, "key long, id long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        for crowd in (4096, 20, 3):
            got = [tuple(r) for r in neardup.met(df, crowd).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_crowds_seen_beforehand_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LOOK", 2)
    rows = [(k % 7, n) for k in range(7) for n in range(0, 40 * k, 3)] + [(50 + n % 30, n) for n in range(90)]
    want = {(a, b) for k in {k for k, _ in rows} for a, b in itertools.combinations(sorted({i for q, i in rows if q == k}), 2)}
    got = [tuple(r) for r in neardup.met(spark.createDataFrame(rows, "key long, id long"), 16).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 99))
def test_the_bound_is_never_below_what_sets_share(both, left, right, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, both + left + right, dtype=np.uint64))
    a, b = h[: both + left], np.concatenate([h[:both], h[both + left :]])
    top = neardup.most_common(np.array([len(a)]), np.array([len(b)]), neardup.bitmap(a)[None], neardup.bitmap(b)[None])
    assert top[0] >= len(np.intersect1d(a, b))


def test_no_link_at_the_threshold_is_lost(spark):
    """Pairs just above 0.6: the index may miss one in some thousands, the bound none."""
    rng = random.Random(21)
    rows = []
    while len(rows) < 1200:
        base = rng.choices(VOCABULARY, k=160)
        other = edited(base, 14, rng)
        x, y = (set(zip(w, w[1:], w[2:])) for w in (base, other))
        if 0.6 <= len(x & y) / len(x | y) < 0.63:
            rows += [(f"t{len(rows):05}", "s", " ".join(base)), (f"t{len(rows):05}+", "s", " ".join(other))]
    found = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "section_id string, slug string, text string")).collect()}
    true = {(rows[k][0], rows[k + 1][0]) for k in range(0, len(rows), 2)}
    assert len(true & found) >= 0.998 * len(true)
