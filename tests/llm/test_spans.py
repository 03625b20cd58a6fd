import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import spans


def text(rng, n):
    return "".join(rng.choices("abcdefghij klmno\npqrstuvwxyz é漢", k=n))


def corpus():
    rng = random.Random(5)
    rows, shared = [], [text(rng, n) for n in (299, 300, 301, 700, 2500)]
    for n in range(30):
        body = text(rng, rng.randrange(50, 1500))
        for k, s in enumerate(shared):
            if n % (k + 4) == 0:
                at = rng.randrange(len(body))
                body = body[:at] + s + body[at:]
        rows.append((f"{n // 2:018}:{'ab'[n % 2]}", f"{n // 2:018}", body))
    rows += [("c1", "900000000000000001", rows[0][2]), ("c2", "900000000000000001", rows[0][2]), ("c3", None, rows[0][2]), rows[0]]
    rows += [("none", "1", None), ("void", "1", ""), (None, "2", rows[0][2]), ("loop1", "odd one", "ab" * 3000), ("loop2", "odd two", "ab" * 2000), ("loop3", "odd two", "ba" * 900)]
    return rows


def brute(rows):
    out, own = set(), {}
    for key, acc, body in rows:
        if key is not None and body and len(body) >= 300:
            digits = "".join(c for c in acc or "" if c.isdigit())
            own[key] = (digits if len(digits) == 18 else acc if acc is not None else "!" + key, {body[i : i + 300] for i in range(len(body) - 299)})
    for a in own:
        for b in own:
            if a < b and own[a][0] != own[b][0] and own[a][1] & own[b][1]:
                out.add((a, b))
    return out


def frame(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in corpus()], "section_id string, accession string, text string, cid int, rep string")


@pytest.mark.parametrize("crowd", [64, 3, 0])
def test_pairs(spark, crowd):
    got = [tuple(r) for r in spans.shared_pairs(frame(spark), crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(corpus())
    assert spans.shared_pairs(frame(spark).limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [64, 3, 0])
def test_shares(spark, crowd):
    rows = {k: (a, t) for k, a, t in corpus() if k is not None}
    got = {r.section_id: r for r in spans.shared_amounts(frame(spark), crowd).collect()}
    assert set(got) == set(rows)
    windows = {}
    for k, (a, t) in rows.items():
        digits = "".join(c for c in a or "" if c.isdigit())
        acc = digits if len(digits) == 18 else a if a is not None else "!" + k
        for i in range(len(t or "") - 299):
            windows.setdefault(t[i : i + 300], set()).add(acc)
    for k, (_, t) in rows.items():
        covered = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - 299):
            if len(windows[t[i : i + 300]]) > 1:
                covered[i : i + 300] = True
        assert (got[k].n_chars, got[k].n_shared) == (len(t or ""), int(covered.sum())), k


def test_block_edges(monkeypatch):
    """Grams kept don't depend on where blocks are cut."""
    rng = random.Random(2)
    texts = [text(rng, n) for n in (10, 400, 2000, 149, 150, 5000)]
    whole = [x.tolist() for x in spans.passages_of(texts)]
    monkeypatch.setattr(spans, "STEP", 700)
    monkeypatch.setattr(spans, "_POWERS", {})
    parts = spans.passages_of(texts)
    assert set(zip(*whole)) <= set(zip(*(x.tolist() for x in parts)))


def test_runs():
    a, b = spans.codes("xx" + "q" * 310 + "yy"), spans.codes("q" * 310)
    assert spans.common_runs(a, b, 2) == [(2, 310)] and spans.common_runs(a, b, 5000) == []


def rows_of(*rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["shard", "slice", "cid", "text"])


def test_one_automaton_for_each_shard(monkeypatch):
    """However many records and slices stream through it, a task compiles a shard's passages once."""
    rng, built, compiled = random.Random(6), [], spans.compiled
    monkeypatch.setattr(spans, "compiled", lambda p: built.append(len(p)) or compiled(p))
    passages = [[text(rng, spans.GRAM) for _ in range(5)] for _ in range(3)]
    rows, want = [], 0
    for shard, own in enumerate(passages):
        for part in range(2):
            rows += [(shard, part, None, p) for p in own]
            for cid in range(20):
                rows.append((shard, part, 100 * part + cid, "x" * 200 + own[cid % 5] + "y" * 200))
                want += 1
    found = [r for b in (1, 7, 999) for r in spans.located(iter([rows_of(*rows[k : k + b]) for k in range(0, len(rows), b)]))]
    assert built == [5, 5, 5] * 3 and sum(b.num_rows for b in found) == 3 * 2 * want


def test_shards_of_a_plan(spark):
    own = spans._own(frame(spark))
    grams = spans.kept_grams(own).cache()
    texts = own.dropDuplicates(["cid"]).select("cid", "text")
    kept = spans.dealt(grams, shard_passages=20).cache()
    rows = spans.routed(kept, texts, slice_chars=5000)
    n = kept.filter("cid = rep").select("rep", "pos").distinct().count()
    held = rows.filter("cid is null").groupBy("shard", "slice").count().collect()
    assert 1 < len({r["shard"] for r in held}) <= -(-n // 20) + 1 and max(r["slice"] for r in held) > 0
    assert sum(r["count"] for r in held if r["slice"] == 0) == n  # each passage once in each slice
    assert rows.filter("cid is not null").groupBy("shard", "cid").count().filter("count > 1").count() == 0


def test_windows_are_named_once():
    t = text(random.Random(3), 1000)
    starts, digests = spans.windows_of(t, [0, 100, 650, 900], [50, 130, 5000, 950])
    assert starts.tolist() == [*range(51), *range(100, 131), *range(650, 701)] and len(set(map(tuple, digests.tolist()))) == len(starts)
    again = spans.windows_of("é" + t, [101], [101])[1]
    assert again.tolist() == digests[[51]].tolist() and spans.windows_of("short", [0], [9])[0].tolist() == []


def test_a_notice_in_20000_records(spark):
    """Work and rows grow with the occurrences: no record is paired with another."""
    rng = random.Random(8)
    notice, n = text(rng, 320), 20_000
    rows = spark.range(n).selectExpr("id AS k", "concat('s', id) AS section_id", "lpad(cast(id AS string), 18, '0') AS accession")
    noise = F.concat_ws(" ", *[F.md5(F.concat("section_id", F.lit(str(i)))) for i in range(3)])
    rows = rows.withColumn("text", F.concat(noise, F.lit(notice), F.reverse(noise))).drop("k")
    out = spans.shared_amounts(rows)
    assert out.filter("n_shared BETWEEN 320 AND 340").count() == n  # a few characters beside it agree by chance
    paired, windows, _ = spans.class_spans(spans._own(rows))
    assert paired.count() < n and n * 21 <= windows.count() <= n * 41
