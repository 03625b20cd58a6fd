import random

import numpy as np
import pytest
import tiktoken

from ledgerloom.llm import bpe


@pytest.fixture(scope="module")
def both():
    path, pattern = bpe.vocabulary_file()
    tokens = bpe.read_ranks(path)
    return bpe.Encoder(tokens, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<i4").tolist()


ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n\n a\n", "don't we'll I'VE they'd", "aaaaaaaa" * 40, "x" * 3000, "　全角　空白　です。", "é é ́", "😀👩‍👧 flags 🇩🇪", "tab\there\x1cand\x85there",
    "1234567 12 ½ ² Ⅷ １２", "<|endoftext|> stays text", "﻿BOM​zero‍width", "\x00\x01\x02", "日本語のテキスト、これはテストです。ーンラン", "a\r\nb\r\n\r\nc", "end.   ", "한국 ไทย العر हि",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(both, text):
    own, other = both
    assert ids(own, text) == other.encode_ordinary(text)


def test_random_texts(both):
    own, other = both
    rng = random.Random(11)
    alphabets = ["ab \n\t'sx1２é日\x1c\xa0.,", "abcdefghijklmnopqrstuvwxyz ", "ザーンラ士の本をはが、。", "-=_.*# ", "0123456789,.$% ", "ÀÉîõü ßæœ "]
    for _ in range(1500):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 80)))
        assert ids(own, text) == other.encode_ordinary(text), repr(text)


def test_every_token_splits_and_encodes_to_itself(both):
    own, _ = both
    assert all(len(t) == 1 or own.left[i] >= 0 for i, t in enumerate(own.tokens))
    for i in range(0, len(own.tokens), 97):
        t = own.tokens[i]
        got = np.frombuffer(own.piece(t), "<i4").tolist()
        assert got == [i]


def test_memo_starts_anew(both, monkeypatch):
    own, other = both
    monkeypatch.setattr(bpe, "MEMO", 5)
    for text in ("one two three four five six seven eight nine ten", "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"):
        assert ids(own, text) == other.encode_ordinary(text)


def test_documents(spark, both):
    _, other = both
    rows = [(1, None), (2, ""), (3, " plain text "), (4, "long text " * 40_000), (5, "日本語"), (5, "日本語"), (None, "no key")]
    df = spark.createDataFrame([(*r, [9]) for r in rows], "doc_id long, text string, ids array<int>")
    got = [(r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()]
    assert sorted(got, key=str) == sorted(((k, other.encode_ordinary(t or "")) for k, t in rows), key=str)
    assert bpe.encode_documents(df.limit(0)).collect() == []
    assert bpe.encode_documents(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
