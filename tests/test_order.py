import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from segue.operators.order import decode, dense_ids, describe, encode, head_n, numbered, popularity_order, with_row_index


def test_row_index_is_gapless_and_sorted(spark):
    values = [random.Random(1).randint(0, 500) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v bigint, i bigint").repartition(9)
    got = with_row_index(df, ["v", "i"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(3000))
    assert [(r["v"], r["i"]) for r in got] == sorted((v, i) for i, v in enumerate(values))


def test_row_index_does_not_depend_on_the_input_order(spark):
    df = spark.range(4000).selectExpr("id % 7 AS v", "id AS i")
    read = lambda d: sorted((r["idx"], r["v"], r["i"]) for r in with_row_index(d, ["v"]).collect())
    assert read(df.repartition(3)) == read(df.repartition(11, "i").repartition(5))


def test_numbers_by_key(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 9), (None, 4), (None, 1)], "k int, v int")
    got = sorted(numbered(df, "k", ["v"], "n").collect(), key=str)
    assert sorted((str(r["k"]), r["v"], r["n"]) for r in got) == [("1", 3, 0), ("1", 5, 1), ("2", 9, 0), ("None", 1, 0), ("None", 4, 1)]


def test_row_index_of_nothing(spark):
    assert with_row_index(spark.createDataFrame([], "v bigint"), ["v"]).count() == 0


def test_dense_ids_round_trip(spark):
    a = spark.createDataFrame([("b",), ("d",), ("b",)], "u string")
    b = spark.createDataFrame([("a",), ("d",), (None,)], "u string")
    ids = dense_ids(a, b)
    assert {r["value"]: r["id"] for r in ids.collect()} == {"a": 0, "b": 1, "d": 2}
    coded = encode(a, ids, "u", "n")
    assert sorted(r["n"] for r in coded.collect()) == [1, 1, 2]
    assert sorted(r["uri"] for r in decode(coded, ids, "n", "uri").collect()) == ["b", "b", "d"]


def test_popularity_ties_by_track(spark):
    freq = spark.createDataFrame([(5, 2), (1, 2), (9, 7)], "track bigint, freq bigint")
    assert [(r["rank"], r["track"]) for r in popularity_order(freq).orderBy("rank").collect()] == [(1, 9), (2, 1), (3, 5)]


def test_head_n(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("pid"))
    assert sorted(r["pid"] for r in head_n(df, 7, ["pid"]).collect()) == list(range(7))


def test_describe(spark):
    for n in (1, 2, 5, 101):
        values = [random.Random(n).random() for _ in range(n)]
        row = describe(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
        assert row["count"] == n
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert abs(row[name] - np.quantile(values, q)) < 1e-12
        assert (row["min"], row["max"]) == (min(values), max(values))
        row = describe(spark.createDataFrame([(v,) for v in values * 3 + values[:1] * 50], "v double"), "v").first()
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert abs(row[name] - np.quantile(values * 3 + values[:1] * 50, q)) < 1e-12
        row = describe(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
        if n > 1:
            assert abs(row["std"] - statistics.stdev(values)) < 1e-12
