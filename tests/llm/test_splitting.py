import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import splitting


def prose(seed, n):
    rng = random.Random(seed)
    out = ""
    while len(out) < n:
        out += " ".join("".join(rng.choices("abcdefghé", k=rng.randrange(1, 12))) for _ in range(rng.randrange(4, 20))) + rng.choice([". ", ".\n", "! ", ".\n\n", " "])
    return out


def check(text, limit, overlap, least=40):
    cut = list(splitting.pieces(text, limit, overlap, least))
    stripped = text.strip()
    if not stripped:
        assert cut == []
        return
    assert text[cut[0][0] :].startswith(stripped[:10]) and text[: cut[-1][1]].endswith(stripped[-10:])
    index = splitting.BoundaryIndex(text)
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert a < c < b < d, "pieces move on and overlap"
        assert least <= b - c <= overlap
    for a, b in cut:
        assert 0 < b - a <= limit
        for at in (a, b):
            # a word is parted only where no blank lies within reach
            assert not index.avoidable(at, min(limit // 2 - 1, overlap - least) - 1)


def test_pieces_of_prose():
    for seed in range(20):
        check(prose(seed, 9000), splitting.LIMIT, splitting.OVERLAP)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\té。", max_size=900))
def test_pieces_of_anything(text):
    check(text, 120, 60, 20)


def test_natural_boundaries_come_first():
    text = ("word " * 250).strip() + "\n\n" + "more " * 300
    (_, end), *_ = splitting.pieces(text)
    assert text[end:].startswith("\n\n")
    assert list(splitting.pieces("x" * 5000))[0] == (0, splitting.LIMIT)
    assert list(splitting.pieces(None)) == list(splitting.pieces(" \n ")) == [] and list(splitting.pieces(" a b ")) == [(1, 4)]


def test_strongest_against_brute_force():
    text = prose(3, 4000)
    index = splitting.BoundaryIndex(text)
    flat = index.levels[0]
    rng = random.Random(1)
    for _ in range(300):
        lo, hi = sorted(rng.sample(range(len(flat) + 1), 2))
        best = max(range(lo, hi), key=lambda k: (int(flat[k]) >> 40, k))
        assert index.strongest(lo, hi) == best


def brute_overlap(before, text, least=40):
    return any(before[-n:] == text[:n] for n in range(least, min(len(before), len(text)) + 1))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=30), st.text(alphabet="ab", max_size=30))
def test_overlaps(a, b):
    assert splitting.overlaps(a, b, 3) == brute_overlap(a, b, 3)


def test_audit(spark):
    body = prose(8, 6000)
    acc = "0000000001-20-000001"
    sections = [(f"{acc}:mdna", body), (f"{acc}:mdna", body), (f"{acc}:other", "y" * 4000), ("bad", None)]
    chunks, ordinal = [], 0
    for a, b in splitting.pieces(body):
        chunks.append((f"{acc}:mdna:{ordinal}", f" {acc.replace('-', '')} : MDNA ", ordinal, body[a:b]))
        ordinal += 1
    good = list(chunks)
    word = next(i for i in range(500, 600) if body[i - 1 : i + 1].strip() == body[i - 1 : i + 1] and len(body[i - 1 : i + 1].split()) == 1)
    chunks += [
        (f"{acc}:mdna:50", f"{acc}:mdna", 50, body[word : word + 300]), (f"{acc}:mdna:51", f"{acc}:mdna", 51, "z" * 1844), (f"{acc}:other:0", f"{acc}:other", 0, "y" * 1843),
        (f"{acc}:other:1", f"{acc}:other", 1, "y" * 39), ("n1", f"{acc}:mdna", None, "no ordinal"), ("n2", None, 1, body[word : word + 99]), ("n3", f"{acc}:mdna", 3, None), ("e", f"{acc}:none", 1, ""), chunks[0],
    ]
    c = spark.createDataFrame([(*r, 1, "x") for r in chunks], "chunk_id string, section_id string, ordinal int, text string, kind int, key string")
    s = spark.createDataFrame([(*r, 1) for r in sections], "section_id string, text string, ordinal int")
    got = sorted(map(tuple, splitting.audit(c, s).collect()))
    assert got == [(f"{acc}:mdna:50", "cut_word"), (f"{acc}:mdna:51", "no_overlap"), (f"{acc}:mdna:51", "oversize"), (f"{acc}:other:1", "no_overlap")]
    assert len(good) > 3
    assert splitting.audit(c.limit(0), s).collect() == [] and len(splitting.audit(c, s.limit(0)).collect()) == 3
    out = splitting.split_sections(s)
    assert out.filter("section_id = 'bad'").count() == 0 and out.filter("section_id like '%mdna'").count() == len(good)


def test_avoidable_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choices("ab \n.", weights=(9, 9, 2, 1, 1), k=rng.randrange(1, 120)))
        index = splitting.BoundaryIndex(text)
        for limit in (3, 10, 200):
            for at in range(len(text) + 1):
                a, b = at, at
                while a > 0 and not text[a - 1].isspace():
                    a -= 1
                while b < len(text) and not text[b].isspace():
                    b += 1
                assert index.avoidable(at, limit) == (a < at < b and b - a <= limit), (text, at, limit)


def test_crowded_sections_are_read_in_blocks(spark, monkeypatch):
    """Chunks beyond the first block meet the one before them and their section, and so do those without an ordinal."""
    monkeypatch.setattr(splitting, "BLOCK", 4)
    acc, body = "0000000001-20-000001", prose(5, 30_000)
    cut = list(splitting.pieces(body))
    rows = [(f"{acc}:mdna:{n}", f"{acc}:mdna", n, body[a:b]) for n, (a, b) in enumerate(cut)]
    word = next(i for i in range(500, 700) if not body[i - 1 : i + 2].split() or len(body[i - 1 : i + 2].split()) == 1 and len(body[i - 1 : i + 2].strip()) == 3) + 1
    rows[8] = (*rows[8][:3], "w" * 300)  # neither it nor the one after it overlaps
    rows += [(f"x{n}", f"{acc}:mdna", None, body[word : word + 50]) for n in range(9)] + [(f"y{n}", None, 3, "z" * 1900) for n in range(9)]
    c = spark.createDataFrame(rows, "chunk_id string, section_id string, ordinal int, text string")
    s = spark.createDataFrame([(f"{acc}:mdna", body)], "section_id string, text string")
    got = sorted(map(tuple, splitting.audit(c, s).collect()))
    assert got == sorted([(rows[8][0], "no_overlap"), (rows[9][0], "no_overlap"), *[(f"x{n}", "cut_word") for n in range(9)], *[(f"y{n}", "oversize") for n in range(9)]])
