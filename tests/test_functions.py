from pyspark.sql import functions as F

from segue.functions.hashing import hash_below
from segue.functions.lists import list_concat, list_split, parse_list
from segue.functions.similarity import edit_similarity
from segue.functions.titles import clean_title, title_ngrams, title_tokens, title_weight


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_clean_title_corners(spark):
    cases = {
        "SUMMERRR!!  Vibes 20\t18": "summer vibes 2018",
        "don't stop": "don't stop",
        "aaab a": "ab a",
        "!!!": None,
        "": None,
        "Cafééé  Noir": "caf noir",
        "a\n\n\nb": "ab",
    }
    for text, want in cases.items():
        assert one(spark, text, clean_title) == want, text
    assert one(spark, None, clean_title) is None


def test_tokens_and_ngrams(spark):
    assert one(spark, "don't stop", title_tokens) == ["don", "stop"]
    assert one(spark, "a b", title_tokens) == []
    assert sorted(one(spark, "hot hot days", title_ngrams)) == ["days", "hot", "hot days", "hot hot"]
    assert one(spark, "solo", title_ngrams) == ["solo"]
    assert one(spark, "a", title_ngrams) == []
    assert one(spark, None, title_ngrams) is None


def test_title_weight(spark):
    assert one(spark, "party", title_weight) == 1
    assert one(spark, "late night", title_weight) == 3


def test_list_text_round_trip(spark):
    assert one(spark, [3, 1, 2], list_concat, "array<bigint>") == "3 1 2"
    assert one(spark, "3 1 2", list_split) == [3, 1, 2]
    assert one(spark, "[3, 1, 2]", parse_list) == [3, 1, 2]


def test_name_similarity(spark):
    rows = [("Red Widget", "red days"), ("", "abc"), (None, "nan"), ("x", None), ("same", "same"), ("abcd", "bcde")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", edit_similarity("a", "b").alias("e")).collect()
    want = {("abcd", "bcde"): 0.5, ("same", "same"): 1.0, (None, "nan"): 1.0, ("", "abc"): 0.0, ("x", None): 0.0}
    found = {(r["a"], r["b"]): round(r["e"], 6) for r in got}
    assert all(found[k] == v for k, v in want.items())


def test_hash_below_is_stable_and_even(spark):
    df = spark.range(20_000).withColumnRenamed("id", "pid")
    picked = df.filter(hash_below(0.2, "pid", seed=666))
    again = df.repartition(7).filter(hash_below(0.2, "pid", seed=666))
    assert picked.exceptAll(again).isEmpty()
    assert abs(picked.count() / 20_000 - 0.2) < 0.01
    assert df.filter(hash_below(1.0, "pid")).count() == 20_000
