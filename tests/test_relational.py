from segue.operators import relational as rel, splits
from tests.lists import random_interactions


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_route_subtask(spark):
    cases = [(0, "a", "v1"), (1, None, "v2"), (5, "a", "v3"), (5, None, "v4"), (10, "a", "v5"), (10, None, "v6"),
             (25, None, "v7"), (100, "a", "v8"), (3, "a", None)]
    df = spark.createDataFrame([(n, name) for n, name, _ in cases], "num_samples int, name string")
    got = [r["c"] for r in df.select(rel.route_subtask().alias("c")).collect()]
    assert got == [c for _, _, c in cases]


def test_ordered_flag(spark):
    data = [(1, i, i + 5) for i in range(25)]  # 5..29 in order
    data += [(2, i, [0, 2, 1][i] if i < 3 else i) for i in range(25)]  # falls once
    data += [(3, i, i if i < 24 else 30) for i in range(25)]  # right length, span 30
    data += [(4, i, i) for i in range(24)]  # not 25 seeds
    df = spark.createDataFrame(data, "pid bigint, file_pos int, pos int").repartition(5)
    assert rows(rel.ordered_flag(df, 25), "pid", "ordered") == [(1, 1), (2, 0), (3, 0)]


def test_first_per_key(spark):
    df = spark.createDataFrame([(7, 3, 1, "x"), (7, 2, 9, "y"), (8, 5, 0, None)], "track int, pid int, pos int, name string")
    assert rows(rel.first_per_key(df, "track", ["pid", "pos"]), "track", "pid") == [(7, 2), (8, 5)]


def test_track_list_count_counts_lists_once_and_unseen_as_zero(spark):
    df = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (2, 0, 7)], "pid int, pos int, track int")
    items = spark.createDataFrame([(7,), (8,)], "track int")
    assert rows(rel.track_list_count(df, items), "track", "n_lists") == [(7, 2), (8, 0)]
    assert rows(rel.track_freq(df), "track", "freq") == [(7, 3)]


def test_long_lists_are_collected_in_chunks(spark):
    data = random_interactions()
    df = spark.createDataFrame(data, "pid bigint, pos bigint, track bigint")
    whole = {r["pid"]: r["tracks"] for r in rel.ordered_items(df, max_items=60).collect()}
    parts = rel.ordered_items(df, max_items=7).orderBy("pid", "chunk").collect()
    joined = {}
    for r in parts:
        assert len(r["tracks"]) <= 7
        joined.setdefault(r["pid"], []).extend(r["tracks"])
    want = {p: [t for q, _, t in data if q == p] for p in {d[0] for d in data}}
    assert whole == want and joined == want


def test_a_list_longer_than_a_chunk(spark):
    df = spark.range(2500).selectExpr("1L AS pid", "2500 - id AS pos", "id AS track")
    got = rel.ordered_items(df.repartition(7)).orderBy("chunk").collect()
    assert [len(r["tracks"]) for r in got] == [1000, 1000, 500]
    assert [t for r in got for t in r["tracks"]] == list(range(2499, -1, -1))


def test_split_prefix_keeps_every_row(spark):
    data = random_interactions() + [(0, 3, 1), (0, 3, 1)]
    df = spark.createDataFrame(data, "pid bigint, pos bigint, track bigint")
    seeds, truth = splits.split_prefix(df, 4)
    assert seeds.unionByName(truth).exceptAll(df).isEmpty() and seeds.count() + truth.count() == len(data)
    first = {p: sorted(d[1:] for d in data if d[0] == p)[:4] for p in {d[0] for d in data}}
    assert rows(seeds, "pid", "pos", "track") == sorted((p, *x) for p, xs in first.items() for x in xs)


def test_split_random_items(spark):
    data = random_interactions()
    df = spark.createDataFrame(data, "pid bigint, pos bigint, track bigint")
    seeds, truth, train = splits.split_random_items(df, 4, seed=2)
    again, _, _ = splits.split_random_items(df.repartition(11), 4, seed=2)
    assert rows(seeds, "pid", "pos") == rows(again, "pid", "pos")
    size = {p: sum(d[0] == p for d in data) for p in {d[0] for d in data}}
    assert {r["pid"]: r["count"] for r in seeds.groupBy("pid").count().collect()} == {p: 4 for p, n in size.items() if n > 4}
    chosen = {(r["pid"], r["track"]) for r in seeds.collect()}
    hidden = {(r["pid"], r["track"]) for r in truth.collect()}
    assert not chosen & hidden
    assert chosen | hidden == {(p, t) for p, _, t in data if size[p] > 4}
    assert train.count() == sum(min(n, 4) for n in size.values())


def test_split_sequential(spark):
    lists = spark.createDataFrame([(i * 3,) for i in range(10)], "pid bigint")
    got = rows(splits.split_sequential(lists, 6, 2), "pid", "part")
    assert got == [(p * 3, "train") for p in range(6)] + [(18, "test"), (21, "test")]


def test_sample_rows_of_users(spark):
    df = spark.createDataFrame([(str(i % 20), f"S{i}", 1) for i in range(2000)], "user string, song string, plays int")
    users = spark.createDataFrame([("3",), ("4",)], "user string")
    got = rel.sample_rows(df, 0.5, users, seed=1)
    assert {r["user"] for r in got.collect()} == {"3", "4"}
    assert 60 < got.count() < 140
    assert rel.fill_zero(spark.createDataFrame([(1, None)], "a int, b int"), ["b"]).first()["b"] == 0
