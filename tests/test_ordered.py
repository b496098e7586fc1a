"""Numbering against plain sorting, with a key that owns most rows."""

import random

from adlumen.functions.ordered import number_rows


def table(spark, seed=3, n=3000):
    dice = random.Random(seed)
    rows = [(1, dice.choice(["hot", "hot", "hot", "a", "b", f"k{dice.randrange(40)}"]),
             dice.randrange(50), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "t int, k string, v bigint, id bigint").repartition(7)


def grouped(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[2], r[3])):
        groups.setdefault(row[1], []).append(row)
    return groups


def test_numbers_are_dense_per_key(spark):
    rows, df = table(spark)
    found = {tuple(r)[3]: r["n"] for r in number_rows(df, ["t", "k"], ["v", "id"], "n").collect()}
    expected = {row[3]: i for members in grouped(rows).values() for i, row in enumerate(members, 1)}
    assert found == expected


def test_numbers_go_on_after_the_last(spark):
    rows, df = table(spark, n=300)
    last = spark.createDataFrame([(1, "hot", 100), (1, "unused", 7)], "t int, k string, last bigint")
    found = {r["id"]: r["n"] for r in number_rows(df, ["t", "k"], ["v", "id"], "n", last).collect()}
    expected = {row[3]: i + (100 if key == "hot" else 0)
                for key, members in grouped(rows).items() for i, row in enumerate(members, 1)}
    assert found == expected


def test_hot_key_is_spread_over_pieces(spark):
    from adlumen.functions.ordered import pieces

    _, df = table(spark)
    hot = pieces(df, ["t", "k"], ["v", "id"]).filter("k = 'hot'")
    assert hot.select("_piece").distinct().count() >= 2


def test_empty(spark):
    _, df = table(spark)
    assert number_rows(df.limit(0), ["t", "k"], ["v", "id"], "n").count() == 0
