import random

import pytest

from ledgerloom.operators import quantiles


@pytest.mark.parametrize("n", [1, 2, 7, 3000, 60_000])
def test_against_sorting(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), round(rng.lognormvariate(3, 2), 2) if rng.random() < 0.95 else None) for _ in range(n)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = {r.k: r for r in quantiles.exact_quantiles(df, df.v, ps, ("k",)).collect()}
    assert "empty" not in got
    for k in {k for k, v in rows if v is not None}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        for name, p in ps.items():
            i = p * (len(own) - 1)
            a, b = own[int(i)], own[min(int(i) + 1, len(own) - 1)]
            assert got[k][name] == pytest.approx(a + (b - a) * (i - int(i)), abs=1e-9), (k, name)
    (whole,) = quantiles.exact_quantiles(df.filter("v is not null"), df.v, {"m": 0.5}).collect() if any(v is not None for _, v in rows) else [None]
    if whole is not None:
        own = sorted(v for _, v in rows if v is not None)
        i = 0.5 * (len(own) - 1)
        assert whole.m == pytest.approx((own[int(i)] + own[-int(-i // 1)]) / 2 if i % 1 else own[int(i)], abs=1e-9)


def test_many_equal_values(spark):
    df = spark.range(50_000).selectExpr("CAST(id % 3 AS DOUBLE) AS v")
    assert quantiles.exact_quantiles(df, df.v, {"a": 0.1, "b": 0.5, "c": 0.9}).first().asDict() == {"a": 0.0, "b": 1.0, "c": 2.0}
    assert quantiles.exact_quantiles(df.limit(0), df.v, {"a": 0.1}, ()).count() <= 1
