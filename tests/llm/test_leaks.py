import random

import pytest

from ledgerloom.llm import leaks
from ledgerloom.llm.grams import WORD


def data():
    rng = random.Random(4)
    vocabulary = [f"Wort{n}" if n % 3 else f"mot{n}é" for n in range(60)]
    passages = [" ".join(rng.choices(vocabulary, k=k)) for k in (12, 13, 14, 40, 200, 25, 13)]
    cases = [(f"case{n}", {"section_text": p, "other": "never read " * 20}) for n, p in enumerate(passages)]
    cases += [("two", {"current_text": passages[3], "prior_text": passages[4]}), ("none", {"section_text": None}), ("null", None), (None, {"section_text": passages[4]}), cases[0]]
    docs = []
    for n in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 120))
        p = rng.choice(passages).split()
        k = rng.randrange(8, 20)
        at, start = rng.randrange(len(words) + 1), rng.randrange(max(1, len(p) - k + 1))
        sep = rng.choice([" ", ", ", "\n", " – "])
        docs.append((n, sep.join(words[:at] + [w.upper() for w in p[start : start + k]] + words[at:])))
    docs += [(100, None), (101, ""), (102, passages[4]), (103, "filler " * 30_000 + passages[4]), (102, passages[4])]
    return cases, docs


def brute(cases, docs):
    grams = lambda t, n=13: {tuple(w[i : i + n]) for w in [[x.lower() for x in WORD.findall(t or "")]] for i in range(len(w) - n + 1)}
    tests = [(c, grams(v.get(k))) for c, v in cases if c is not None and v for k in leaks.PASSAGES]
    return {(d, c) for d, t in docs for own in [grams(t)] for c, g in tests if own & g}


@pytest.mark.parametrize("limit", [leaks.INDEX_WORDS, 0])
def test_both_ways(spark, limit):
    cases, docs = data()
    c = spark.createDataFrame([(*r, "x") for r in cases], "case_id string, variables map<string,string>, gram string")
    d = spark.createDataFrame([(*r, "y") for r in docs], "doc_id long, text string, case_id string")
    found = leaks.leaks(d, c, limit)
    assert {(r.doc_id, r.case_id) for r in found.collect()} == brute(cases, docs)
    assert min(r.n_words for r in found.collect()) >= 13
    assert leaks.leaks(d.limit(0), c, limit).collect() == [] == leaks.leaks(d, c.limit(0), limit).collect()


def test_longest_run():
    words = [f"w{n}" for n in range(50)]
    index = leaks.Index(["c"], [" ".join(words)])
    from ledgerloom.llm.grams import WordHashes

    ids = WordHashes().of("x y " + " ".join(words[10:40]) + " z")
    assert list(index.runs(ids, *leaks.fingerprints(ids))) == [("c", 2, 10, 30)]
