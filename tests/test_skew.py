import random

from shelfmark.operators.skew import hot_keys, pin_small, rank_in_group, skew_join


def table(spark, n=600):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else rng.choice("abcdefgh"), rng.randint(0, 50), f"n{rng.randint(0, 99):02d}", i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, x int, s string, id int")


def ranks(rows, key):
    out, seen = {}, {}
    for r in sorted(rows, key=key):
        seen[r[0]] = seen.get(r[0], 0) + 1
        out[r[3]] = seen[r[0]]
    return out


def test_hot_keys(spark):
    _, df = table(spark)
    assert [r["k"] for r in hot_keys(df, ["k"], 100).collect()] == ["hot"]
    assert hot_keys(df, ["k"], 1000) is None


def test_rank_in_group_is_a_row_number(spark):
    rows, df = table(spark)
    order = [("x", False), ("s", True), ("id", True)]
    expected = ranks(rows, lambda r: (r[0], -r[1], r[2], r[3]))
    for hot_rows in (10, 40, 150, 10_000):
        ranked = rank_in_group(df, ["k"], order, "n", hot_rows)
        assert {r["id"]: r["n"] for r in ranked.collect()} == expected


def test_rank_of_whole_table(spark):
    rows, df = table(spark)
    expected = {r[3]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[3])), 1)}
    for hot_rows in (20, 10_000):
        ranked = rank_in_group(df, [], [("s", True), ("id", True)], "n", hot_rows)
        assert {r["id"]: r["n"] for r in ranked.collect()} == expected


def test_hot_ranking_splits_the_group(spark):
    _, df = table(spark)
    ranked = rank_in_group(df, ["k"], [("s", True), ("id", True)], "n", 20)
    assert "__slice" in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_skew_join_is_a_join(spark):
    _, df = table(spark)
    small = spark.createDataFrame([("hot", 1), ("a", 2), ("a", 3), ("zz", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, df.join(small, ["k"], how).collect()))
        for hot_rows in (50, 10_000):
            assert sorted(map(str, skew_join(df, small, ["k"], how, ["id"], hot_rows).collect())) == plain


def test_pin_small(spark):
    df = spark.range(50)
    assert pin_small(df, 49) is None
    assert pin_small(df, 50).count() == 50
