import itertools
import random

from ledgerloom.plans.pairs import pairs_within


def test_pairs_within_any_cell_size(spark):
    rng = random.Random(4)
    rows = [(g, f"i{n:03}", n % 3) for g in range(12) for n in rng.sample(range(60), rng.choice([1, 2, 5, 50]))] + [(None, "i1", 0), (5, None, 0)]
    df = spark.createDataFrame(rows, "g int, i string, c int")
    want = sorted((a, b, x, y) for g in range(12) for (a, x), (b, y) in itertools.combinations(sorted((i, c) for h, i, c in rows if h == g and i is not None), 2))
    for cell in (2048, 7, 1):
        assert sorted(map(tuple, pairs_within(df, ["g"], "i", ("c",), cell).collect())) == want
    unlike = sorted(map(tuple, pairs_within(df, ["g"], "i", ("c",), 7, unlike=__import__("pyspark").sql.functions.expr("c_a <> c_b")).collect()))
    assert unlike == [w for w in want if w[2] != w[3]]
    assert pairs_within(df.limit(0), ["g"], "i").collect() == []


def test_a_hot_group_is_spread(spark):
    df = spark.range(6000).selectExpr("1 AS g", "id AS i")
    plan = pairs_within(df, ["g"], "i", cell=500)
    keys = df.selectExpr("pmod(xxhash64(i), 12) AS p").groupBy("p").count().agg({"count": "max"}).first()[0]
    assert plan.count() == 6000 * 5999 // 2 and keys < 600  # 78 cells of about 500 x 500


def test_once_is_distinct(spark):
    from ledgerloom.plans.once import once

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x" * 50, "y", None]), n % 7) for n in range(60)] + [("only", "one", 1)]
    df = spark.createDataFrame(rows, "a string, b string, c int")
    assert sorted(map(repr, once(df).collect())) == sorted(map(repr, df.distinct().collect()))
    assert once(df.limit(0)).collect() == [] and once(df.filter("a = 'only'")).count() == 1
