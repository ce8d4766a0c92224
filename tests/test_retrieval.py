import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import cooccur, listmodels, rank, retrieve, skew, title
from segue.functions.titles import clean_title
from segue.operators.order import popularity_order
from tests.lists import cf_by_hand, lists_of, random_interactions

SCHEMA = "pid bigint, pos bigint, track bigint"
SEEDS = [(100, 1), (100, 1), (100, 2), (101, 0), (101, 999), (102, 5), (102, 6), (103, 1), (104, 1)]


@pytest.fixture(params=["whole", "cut"])
def pieces(request, monkeypatch):
    """Run with the usual limits, and with limits so low that lists, seeds and titles are cut."""
    if request.param == "cut":
        monkeypatch.setattr(skew, "ROWS_PER_PIECE", 2)
        monkeypatch.setattr(skew, "MATCHES_PER_PIECE", 2)
    return request.param


@pytest.fixture
def data(spark):
    rows = random_interactions()
    seeds = spark.createDataFrame([(p, i, t) for i, (p, t) in enumerate(SEEDS)], SCHEMA)
    return rows, spark.createDataFrame(rows, SCHEMA), seeds


def test_cf_score(data, pieces):
    rows, df, seeds = data
    got = {(r["pid"], r["track"]): r["score"] for r in retrieve.cf_score(seeds, cooccur.cells_of(df)).collect()}
    want = cf_by_hand(SEEDS, rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cf_recommend(data, pieces):
    rows, df, seeds = data
    got = retrieve.cf_recommend(seeds, cooccur.cells_of(df), k=6).collect()
    want = cf_by_hand(SEEDS, rows)
    own = set(SEEDS)
    for pid in {p for p, _ in SEEDS}:
        scores = [(-np.floor(v * 1e6 + 0.5), t) for (p, t), v in want.items() if p == pid and (p, t) not in own]
        mine = sorted((r["rank"], r["track"]) for r in got if r["pid"] == pid)
        assert mine == [(i + 1, t) for i, (_, t) in enumerate(sorted(scores)[:6])]


@pytest.mark.parametrize("heavy_pairs,k", [(0, 4), (60, 1000), (200, 7), (200, 40)])
def test_cf_recommend_beside_very_long_lists(spark, monkeypatch, heavy_pairs, k):
    """Lists kept out of the pairs change no row: long ones that share tracks, tracks in them only, seeds in them only."""
    rng = random.Random(5)
    rows = random_interactions()
    rows += [(500, i, t) for i, t in enumerate(range(10, 90))] + [(501, i, t) for i, t in enumerate(range(60, 140, 2))]
    rows += [(600 + p, i, rng.randrange(20, 120)) for p in range(10) for i in range(3)]
    seeds = [(1, 0, 3), (1, 1, 12), (1, 2, 70), (1, 3, 70), (2, 0, 85), (3, 0, 138), (3, 1, 5), (4, 0, 9999), (4, 1, 20), (5, 0, 9999)]
    monkeypatch.setattr(retrieve, "HEAVY_PAIRS", heavy_pairs)
    monkeypatch.setattr(retrieve, "TAIL_BLOCK", 3)
    schema = "pid bigint, pos bigint, track bigint"
    df, asked = spark.createDataFrame(rows, schema), spark.createDataFrame(seeds, schema)
    assert not retrieve.heavy_lists(retrieve.seed_rows(asked), cooccur.cells_of(df)).isEmpty()
    got = {(r["pid"], r["rank"]): (r["track"], r["score"]) for r in retrieve.cf_recommend(asked, cooccur.cells_of(df), k).collect()}
    want = {}
    scores = cf_by_hand([(p, t) for p, _, t in seeds], rows)
    for pid in {s[0] for s in seeds}:
        own = {t for p, _, t in seeds if p == pid}
        ranked = sorted((-math.floor(v * 1e6 + 0.5) / 1e6, t) for (p, t), v in scores.items() if p == pid and t not in own)
        want |= {(pid, i + 1): (t, -v) for i, (v, t) in enumerate(ranked[:k])}
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_every_heavy_key_is_cut(spark):
    """No number of heavy keys is too many: each of them has its pieces, and each row its copies."""
    df = spark.range(6000).selectExpr("id % 2000 AS k", "id AS v")
    heavy = skew.heavy_keys(df, "k", 2)
    assert heavy.count() == 2000 and {r["pieces"] for r in heavy.collect()} == {2}
    assert skew.cut(df, "k", heavy, "v").groupBy("k").count().filter("count = 3").count() == 2000
    assert skew.copy_to_pieces(df, "k", heavy).groupBy("v").count().filter("count = 2").count() == 6000


def test_numbers_below_in_steps(spark, monkeypatch):
    monkeypatch.setattr(skew, "COPIES_AT_ONCE", 4)
    df = spark.createDataFrame([(1, 1), (2, 4), (3, 11)], "k int, n int")
    got = skew.numbers_below(df, F.col("n"), "i").collect()
    assert sorted((r["k"], r["i"]) for r in got) == [(1, 0)] + [(2, i) for i in range(4)] + [(3, i) for i in range(11)]


def test_cf_does_not_depend_on_partitions(spark, data):
    _, df, seeds = data
    answers = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(sorted(retrieve.cf_recommend(seeds, cooccur.cells_of(df.repartition(int(n))), k=10).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert answers[0] == answers[1]


def test_list_without_known_seed_gets_nothing(spark, data):
    _, df, _ = data
    seeds = spark.createDataFrame([(7, 0, 999)], SCHEMA)
    assert retrieve.cf_score(seeds, cooccur.cells_of(df)).count() == 0


def test_pair_similarity(spark, data, pieces):
    rows, df, _ = data
    lists = lists_of(rows)
    tracks = range(0, 30, 2)
    pairs = [(s, u) for s in tracks for u in tracks if s != u] + [(1, 999)]
    got = cooccur.pair_similarity(spark.createDataFrame(pairs, "s bigint, u bigint"), cooccur.cells_of(df)).collect()
    assert len(got) == len(pairs)
    for r in got:
        hs = {p for p, c in lists.items() if r["s"] in c}
        hu = {p for p, c in lists.items() if r["u"] in c}
        c = len(hs & hu)
        want = (c / (len(hs) ** 0.1 * len(hu) ** 0.9)) ** 0.5 if c else 0.0
        assert abs(r["sim"] - want) < 1e-12


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_travel_to_lists_as_marks(spark, data):
    """No row per pair and list is sent to look a partner up."""
    _, df, _ = data
    pairs = spark.createDataFrame([(s, u) for s in range(6) for u in range(6)], "s bigint, u bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(cooccur.pair_similarity(pairs, cooccur.cells_of(df)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\((pid#\d+L?, track#|track#\d+L?, pid#)", plan)


def test_pairs_with_equal_marks_are_told_apart(spark, monkeypatch):
    """Marks only choose what is looked at: with one mark for all tracks the values are the same; nulls and own pairs as before."""
    rows = [(1, 0, 5), (1, 1, 6), (2, 0, 5), (2, 1, 7), (3, 0, 6), (3, 1, 5), (None, 0, 5), (None, 1, 6), (4, 0, None)]
    cells = cooccur.cells_of(spark.createDataFrame(rows, SCHEMA))
    pairs = spark.createDataFrame([(5, 6), (6, 5), (5, 5), (5, 8), (None, 5), (5, None), (5, 6)], "s bigint, u bigint")
    before = {(r["s"], r["u"]): r["sim"] for r in cooccur.pair_similarity(pairs, cells).collect()}
    monkeypatch.setattr(cooccur, "_mark", lambda track: F.lit(1).cast("short"))
    assert before == {(r["s"], r["u"]): r["sim"] for r in cooccur.pair_similarity(pairs, cells).collect()}
    assert len(before) == 6 and before[5, 7 + 1] == before[None, 5] == before[5, None] == 0.0 and before[6, 5] > 0 and before[5, 6] > 0


def counted_matrix(rows):
    m = np.zeros((30, 40))
    for p, _, t in rows:
        m[t, p] += 1
    return m


def test_normalised_features(data, pieces):
    rows, df, seeds = data
    m = counted_matrix(rows)
    song = 0.1 + m.sum(axis=1)
    v = (m @ m.T) * song[:, None] ** -0.9 * song[None, :] ** -0.1
    got = cooccur.normalised_features(seeds, cooccur.cells_of(df, counted=True)).collect()
    known = sorted({t for _, t in SEEDS if t < 30})
    assert len(got) == sum(int((v[s] > 0).sum()) for s in known)
    assert all(abs(r["v"] - v[r["seed"], r["track"]]) < 1e-9 for r in got)


def test_weighted_features(data, pieces):
    rows, df, seeds = data
    m = counted_matrix(rows)
    song, lists = 0.1 + m.sum(axis=1), 0.1 + m.sum(axis=0)
    cells = cooccur.cells_of(df, counted=True)
    got = {(r["test"], r["seed"], r["track"]): r["v"] for r in cooccur.weighted_features(seeds, cells).collect()}
    weights = {(r["test"], r["pid"]): r["w"] for r in cooccur.list_weights(seeds, cells).collect()}
    n = 0
    for test in {p for p, _ in SEEDS}:
        own = sorted({t for p, t in SEEDS if p == test and t < 30})
        w = ((m[own] * lists ** -0.3).sum(axis=0)) ** 0.99
        for p in range(40):
            assert abs(weights.get((test, p), 0.0) - w[p]) < 1e-9
        v = ((m[own] * w) @ m.T) * song[own][:, None] ** -0.9 * song[None, :] ** -0.1
        for i, s in enumerate(own):
            for t in range(30):
                n += v[i, t] > 0
                assert abs(got.get((test, s, t), 0.0) - v[i, t]) < 1e-9
    assert n == len(got)


def test_title_recommend(spark, data, pieces):
    rows, df, _ = data
    names = {p: [None, "Party", "party mix", "Late Night", "late party!!!"][p % 5] for p in range(40)}
    lists = spark.createDataFrame(list(names.items()), "pid bigint, name string").withColumn("clean", clean_title("name"))
    asked = spark.createDataFrame([(1, "Late party"), (2, "nothing known"), (3, "PARTY"), (4, "late   PARTY")], "pid bigint, name string")
    asked = asked.withColumn("clean", clean_title("name"))
    grams = {"party": ["party"], "party mix": ["party", "mix", "party mix"], "late night": ["late", "night", "late night"],
             "late party": ["late", "party", "late party"]}
    clean = {p: n and n.lower().replace("!", "") for p, n in names.items()}
    held = [(p, t) for p, _, t in rows if clean[p]]
    table = {}
    for p, t in held:
        for g in grams[clean[p]]:
            table[g, t] = table.get((g, t), 0) + (1 if " " not in clean[p] else 3)
    m = np.zeros((30, 40))
    for p, t in held:
        m[t, p] = 1
    n = m.sum(axis=1)
    both = m @ m.T
    titled = lists.dropna(subset=["clean"])
    cells = cooccur.cells_of(df.join(titled.select("pid"), "pid", "left_semi"))
    got = title.title_recommend(asked, lists, df, cells, k=12).collect()
    for pid, words in ((1, grams["late party"]), (3, grams["party"]), (4, grams["late party"])):
        score = np.array([sum(table.get((g, t), 0) for g in words) for t in range(30)], dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            nb = np.nan_to_num(both * score[None, :] / (n[:, None] ** 0.1 * n[None, :] ** 0.9)).sum(axis=1) / 100
        mixed = np.floor((0.5 * score + 0.5 * nb) * 1e6 + 0.5) / 1e6
        want = sorted((-mixed[t], t) for t in range(30) if mixed[t] > 0)[:12]
        mine = sorted((r["rank"], r["track"]) for r in got if r["pid"] == pid)
        assert mine == [(i + 1, t) for i, (_, t) in enumerate(want)]
    assert not [r for r in got if r["pid"] == 2]
    lost = title.lists_without_known_word(asked, lists)
    assert [r["pid"] for r in lost.collect()] == [2]


def test_title_terms_do_not_travel(spark, data):
    """A weight is sent to its track with its titles; no row per title and track is sent to be summed."""
    _, df, _ = data
    lists = spark.createDataFrame([(p, ["party mix", "late party", "mix"][p % 3]) for p in range(40)], "pid bigint, clean string")
    found = title.title_scores(lists, title.ngram_weights(lists, df))
    assert not re.search(r"hashpartitioning\(clean#\d+, track#", _plan(found))
    assert found.filter("clean = 'mix'").count() == df.join(lists.filter("clean <> 'late party'"), "pid").select("track").distinct().count()


def test_least_scores_cut_nothing_of_the_best(spark):
    """Ties at the last place stay, a title with fewer rows keeps all of them, and a track without a title score is kept."""
    rows = [("a", t, 9 - t // 3) for t in range(9)] + [("b", 1, 4), ("b", 2, 1)]
    scores = spark.createDataFrame(rows, "clean string, track bigint, score bigint")
    assert {r["clean"]: r["least"] for r in title.kth_scores(scores, 4).collect()} == {"a": 8, "b": None}
    best = sorted((r["clean"], r["rank"], r["track"]) for r in title.best_title_tracks(scores, 4).collect())
    assert best == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 1, 1), ("b", 2, 2)]


def test_ties_by_track(spark):
    df = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.7)], "pid int, track int, score double")
    got = rank.topk_per_list(df, 2).orderBy("rank").collect()
    assert [(r["rank"], r["track"]) for r in got] == [(1, 4), (2, 3)]


def test_rank_emit_drops_seeds_after_the_first_cut(spark):
    df = spark.createDataFrame([(1, t, 1.0 - t / 10) for t in range(8)], "pid int, track int, prob double")
    seeds = spark.createDataFrame([(1, 0), (1, 2)], "pid int, track int")
    got = rank.rank_emit(df, seeds, top=5, k=4, score="prob").orderBy("rank").collect()
    assert [(r["rank"], r["track"]) for r in got] == [(1, 1), (2, 3), (3, 4)]


def test_popularity_backfill(spark):
    freq = spark.createDataFrame([(t, 100 - t) for t in range(20)], "track bigint, freq bigint")
    pids = spark.createDataFrame([(1,), (2,), (3,)], "pid bigint")
    ranked = spark.createDataFrame([(1, 5, 1), (1, 0, 2)] + [(2, t, t + 1) for t in range(10)], "pid bigint, track bigint, rank int")
    seeds = spark.createDataFrame([(1, 1), (3, 2)], "pid bigint, track bigint")
    got = rank.popularity_backfill(pids, ranked, seeds, popularity_order(freq), 5).orderBy("pid", "rank").collect()
    by = {p: [r["track"] for r in got if r["pid"] == p] for p in (1, 2, 3)}
    assert by == {1: [5, 0, 2, 3, 4], 2: [0, 1, 2, 3, 4], 3: [0, 1, 3, 4, 5]}
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] * 3


def test_backfill_makes_rows_of_filled_places_only(spark):
    """Lists and places never meet in a shuffle: the places are told within the row of a list.  A list that comes twice shares its places."""
    freq = spark.createDataFrame([(t, 100 - t) for t in range(20)], "track bigint, freq bigint")
    pids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "pid bigint")
    ranked = spark.createDataFrame([(1, 0, 1)], "pid bigint, track bigint, rank int")
    seeds = spark.createDataFrame([(1, 2), (2, None)], "pid bigint, track bigint")
    filled = rank.popularity_backfill(pids, ranked, seeds, popularity_order(freq), 4)
    got = sorted((r["pid"] or 0, r["rank"], r["track"]) for r in filled.collect())
    assert got == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, 3), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 3),
                   (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftAnti" not in plan


def test_random_tracks(spark):
    items = spark.createDataFrame([(t * 7,) for t in range(40)], "track bigint")
    pids = spark.createDataFrame([(p,) for p in range(6)], "pid bigint")
    got = rank.random_tracks(pids, items, 12, seed=1).collect()
    for p in range(6):
        mine = [r["track"] for r in got if r["pid"] == p]
        assert len(mine) == len(set(mine)) == 12
    assert got and len({tuple(r["track"] for r in sorted(got) if r["pid"] == p) for p in range(6)}) == 6
    assert rank.random_tracks(pids, items, 100).count() == 6 * 40


@pytest.fixture
def parts(monkeypatch):
    """Limits so low that every seed and list is cut into parts and the tasks are many."""
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 5)


def test_pairs_in_parts_and_tasks_by_their_number(spark, data, parts):
    """The tasks that sum pairs grow with the pairs; seeds and lists cut into parts give the same scores and values."""
    rows, df, seeds = data
    asked = retrieve.seed_rows(seeds)
    cells = cooccur.cells_of(df)
    reach = cooccur.seed_reach(asked, cells)
    lists = lists_of(rows)
    want = {t: sum(len(tracks) for tracks in lists.values() if t in tracks) for t in {t for _, t in SEEDS if t < 30}}
    assert {r["seed"]: r["reach"] for r in reach.collect()} == want
    assert skew.tasks_for(reach, F.col("reach")) >= sum(want.values()) / 5 > 4
    pairs = cooccur.seed_cooccurrence(asked, cells, cooccur.list_counts(cells), reach).collect()
    assert len({(r["seed"], r["track"]) for r in pairs}) == len(pairs) and max(r["part"] for r in pairs) > 0
    got = {(r["pid"], r["track"]): r["score"] for r in retrieve.cf_score(seeds, cells).collect()}
    scores = cf_by_hand(SEEDS, rows)
    assert got.keys() == scores.keys() and all(abs(got[k] - scores[k]) < 1e-9 for k in scores)


def test_list_rows_in_parts(spark, data, monkeypatch):
    """The rows of the lists' own models are the same whether seeds and lists are cut or not, null and unknown seeds included."""
    _, df, _ = data
    seeds = spark.createDataFrame([(p, i, t) for i, (p, t) in enumerate(SEEDS + [(None, 1), (105, None), (105, 3), (106, None)])], SCHEMA)
    counted = cooccur.cells_of(df, counted=True)
    found = []
    for limit in (1_000_000, 5):
        monkeypatch.setattr(skew, "PAIRS_PER_TASK", limit)
        for build in (cooccur.normalised_features, cooccur.weighted_features):
            rows = listmodels.candidate_rows(build(seeds, counted), seeds, 40).collect()
            found.append(sorted((r["test"], r["k"], -1 if r["track"] is None else r["track"], r["label"], r["times"], list(r["at"]),
                                 [round(v, 9) for v in r["v"]]) for r in rows))
    assert found[0] == found[2] and found[1] == found[3]
    own = {(t, s) for t, _, s, label, *_ in found[0] if label}
    assert own == {(p, t) for p, t in SEEDS} | {(105, 3), (105, -1), (106, -1)}
