import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import features, listmodels, models, rank, skew, windows
from segue.operators.cooccur import cells_of, normalised_features, weighted_features
from segue.session import materialize
from tests.lists import random_interactions

SCHEMA = "pid bigint, pos bigint, track bigint"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    table = {t: rng.normal(size=8).tolist() for t in range(0, 30, 2)}
    table[28] = [0.0] * 8
    return table, spark.createDataFrame(list(table.items()), "track bigint, vector array<double>")


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def test_label_and_relative_score(spark):
    cands = spark.createDataFrame([(1, 5, 1.0), (1, 6, 3.0), (2, 5, 0.0)], "pid int, track int, cf_prob double")
    hidden = spark.createDataFrame([(1, 0, 6), (1, 1, 6)], "pid int, pos int, track int")
    got = features.relative_score(features.label_candidates(cands, hidden)).orderBy("pid", "track").collect()
    assert [(r["label"], r["cf_rlt_prob"]) for r in got] == [(0, 0.5), (1, 1.5), (0, None)]


def test_unknown_item_is_an_error(spark):
    cands = spark.createDataFrame([(1, 5, 1.0), (1, 6, 3.0)], "pid int, track int, cf_prob double")
    items = spark.createDataFrame([(5, "a")], "track int, artist string")
    assert features.add_item_attrs(cands.filter("track = 5"), items).first()["artist"] == "a"
    with pytest.raises(Exception, match="no item for track 6"):
        features.add_item_attrs(cands, items).collect()


def test_explode_scored(spark):
    wide = spark.createDataFrame([(1, [5, 6], [0.5, 0.25])], "pid int, pred array<int>, scores array<double>")
    assert [tuple(r) for r in features.explode_scored(wide).collect()] == [(1, 5, 0.5), (1, 6, 0.25)]


def test_seed_similarity(spark, vectors):
    table, df = vectors
    seeds = [(1, 0, 0), (1, 1, 4), (1, 2, 3), (2, 0, 1), (1, 3, 0)]
    cands = [(p, t, 1.0) for p in (1, 2, 3) for t in range(30)]
    got = features.seed_similarity(
        spark.createDataFrame(cands, "pid bigint, track bigint, cf_prob double"), spark.createDataFrame(seeds, SCHEMA), df, "sim"
    ).collect()
    assert len(got) == 90
    for r in got:
        own = [t for p, _, t in seeds if p == r["pid"]]
        terms = [cosine(table[s], table[r["track"]]) if s in table and r["track"] in table else 0.0 for s in own]
        assert abs(r["sim"] - (sum(terms) / len(terms) if terms else 0.0)) < 1e-12


def test_seed_similarity_by_album(spark, vectors):
    table, df = vectors
    keys = spark.createDataFrame([(t, (t // 3) * 2) for t in range(30)], "track bigint, album bigint")
    seeds = spark.createDataFrame([(1, 0, 0), (1, 1, 7)], SCHEMA)
    cands = spark.createDataFrame([(1, t, 1.0) for t in range(30)], "pid bigint, track bigint, cf_prob double")
    for r in features.seed_similarity(cands, seeds, df, "sim", keys).collect():
        key = (r["track"] // 3) * 2
        want = (cosine(table[0], table[key]) + cosine(table[4], table[key])) / 2
        assert abs(r["sim"] - want) < 1e-12


@pytest.mark.parametrize("limit", [10**9, 5])
def test_similarity_in_a_grid_of_blocks(spark, vectors, monkeypatch, limit):
    """Floats, a hot list and a hot track, null keys and repeated candidates; all columns stay as they are, whatever the blocks."""
    table, df = vectors
    monkeypatch.setattr(features, "PAIRS_PER_BLOCK", limit)
    monkeypatch.setattr(features, "SIDE_BYTES", limit * 32)
    floats = df.select("track", F.col("vector").cast("array<float>").alias("vector"))
    cands = [(p, t, None if (t or 0) % 3 else t, f"c{p}") for p in (1, 2, None) for t in (*range(30), 4, None)] + [(p, 4, p, None) for p in range(3, 40)]
    seeds = [(1, 0, 0), (1, 1, 4), (2, 0, 4), (2, 1, 7), (None, 0, 4)] + [(p, 0, 6) for p in range(3, 40)]
    got = features.add_embeddings(
        spark.createDataFrame(cands, "pid bigint, track bigint, n int, kind string"), spark.createDataFrame(seeds, SCHEMA),
        {"a": (floats, None), "b": (df, None)},
    ).collect()
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, cands))
    for r in got:
        own = [t for p, _, t in seeds if p is not None and p == r["pid"]]
        terms = [cosine(table[s], table[r["track"]]) if s in table and r["track"] in table else 0.0 for s in own]
        want = sum(terms) / len(terms) if terms else 0.0
        assert abs(r["b"] - want) < 1e-12 and abs(r["a"] - want) < 1e-6


def test_similarity_where_a_track_has_two_vectors(spark):
    """Each of them gives a row, and each counts as a seed."""
    df = spark.createDataFrame([(4, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0])], "track bigint, vector array<double>")
    cands = spark.createDataFrame([(1, 4, 1.0), (1, 5, 1.0), (1, 6, 1.0)], "pid bigint, track bigint, cf_prob double")
    got = features.seed_similarity(cands, spark.createDataFrame([(1, 0, 4), (1, 1, 5), (1, 2, 6)], SCHEMA), df, "sim").collect()
    half = 0.5**0.5
    want = [(4, (1 + half) / 4), (4, (1 + half) / 4), (5, (1 + 2 * half) / 4), (6, 0.0)]
    assert sorted((r["track"], round(r["sim"], 9)) for r in got) == sorted((t, round(v, 9)) for t, v in want)


def test_vectors_are_sent_to_sides_and_not_to_candidates():
    """Ten times the candidates ask for about root ten times the copies of a vector, and a side fits a task."""
    few, many = (sum(features.sides(n, 10**8, 10**8, 8)) for n in (10**8, 10**9))
    assert many < 4 * few and features.sides(10**9, 10**8, 10**8, 8)[0] * features.sides(10**9, 10**8, 10**8, 8)[1] >= 1000
    by_item, by_list = features.sides(10, 10**10, 10**6, 8)
    assert 10**10 / by_item <= features.SIDE_BYTES and by_list >= 1


def test_items_are_copied_to_few_blocks_of_queries():
    assert features.query_blocks_for(1_000_000, 8) == 100 and features.query_blocks_for(5_000, 8) == 5 and features.query_blocks_for(0, 8) == 1


@pytest.mark.parametrize("block", [20_000, 4])
def test_vector_topk(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(features, "ITEM_BLOCK", block)
    monkeypatch.setattr(features, "QUERY_BLOCK", block)
    table, df = vectors
    queries = spark.createDataFrame([(1, 0), (2, 4), (3, 0), (4, 3)], "pid bigint, query bigint")
    got = features.vector_topk(queries, df, k=5).collect()
    for pid, q in ((1, 0), (2, 4), (3, 0)):
        scores = sorted((-np.floor(cosine(table[q], v) * 1e6 + 0.5), t) for t, v in table.items() if t not in (q, 28))
        assert sorted((r["rank"], r["track"]) for r in got if r["pid"] == pid) == [(i + 1, t) for i, (_, t) in enumerate(scores[:5])]
    assert not [r for r in got if r["pid"] == 4]


@pytest.mark.parametrize("window", [1, 5])
def test_window_pairs_equal_brute_force(spark, window):
    rng = np.random.default_rng(3)
    rows = [(int(p), int(rng.integers(0, 30)), int(rng.integers(0, 6))) for p in rng.integers(0, 4, 200)]
    want = {}
    for pid in {r[0] for r in rows}:
        keys = [k for _, k in sorted((pos, k) for p, pos, k in rows if p == pid)]
        for i, x in enumerate(keys):
            for j in range(i + 1, min(i + window + 1, len(keys))):
                if x != keys[j]:
                    n, w = want.get((min(x, keys[j]), max(x, keys[j])), (0, 0))
                    want[min(x, keys[j]), max(x, keys[j])] = (n + 1, w + window + 1 - (j - i))
    got = windows.window_pairs(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("track", "key"), window)
    assert {(r["a"], r["b"]): (r["n"], r["weight"]) for r in got.collect()} == want


@pytest.mark.parametrize("stretch", [3, 7])
def test_window_pairs_across_stretches(spark, monkeypatch, stretch):
    """The rows of one list meet over the ends of the stretches that the sorted table is cut into, each pair once."""
    rows = [(p, i, (i * 7 + p) % 11) for p in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("track", "key")
    want = {tuple(r) for r in windows.window_pairs(df, 4).collect()}
    monkeypatch.setattr(windows, "STRETCH", stretch)
    assert {tuple(r) for r in windows.window_pairs(df, 4).collect()} == want


def test_window_pairs_are_summed_in_as_many_tasks_as_they_need(spark, monkeypatch):
    rows = [(p, i, (i * 7 + p) % 211) for p in range(30) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("track", "key")
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 100)
    assert windows.window_pairs(df, 5).rdd.getNumPartitions() == 30


def test_rows_sent_by_factors_grow_with_the_root_of_the_blocks():
    """A row of numbers goes to one side of the grid, not to every block."""
    for cells in (10**8, 10**9, 10**10):
        by_a, by_b = windows.grid(cells, 10**6, 8, 10**6)
        assert by_a * by_b >= cells // 10**6
        assert 4 * by_a + 8 * by_b <= 12 * (cells / 10**6) ** 0.5 + 16
    assert all(n >= 20 for n in windows.grid(100, 10**7, 8, 10**6))  # no block holds more items than a side may


def test_factors_in_one_block_and_in_many(spark, monkeypatch):
    rng = np.random.default_rng(6)
    matrix = rng.random((15, 15))
    matrix = matrix + matrix.T
    cells = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(15) for j in range(15) if i != j], "a long, b long, v double")
    found = []
    for block, pack, side in ((10**6, 10**6, 10**6), (4, 3, 4)):
        monkeypatch.setattr(windows, "CELLS_PER_PACK", pack)
        monkeypatch.setattr(windows, "KEYS_PER_SIDE", side)
        got = {r["key"]: r["vector"] for r in windows.factors(cells, size=4, rounds=2, cells_per_block=block).collect()}
        table = np.array([got[i] for i in range(15)])
        found.append(table @ table.T)
    assert np.allclose(found[0], found[1], atol=1e-4)


def test_factors_rebuild_a_small_matrix(spark, monkeypatch):
    """The vectors of a matrix of low rank multiply to the matrix; cut cells give the same."""
    rng = np.random.default_rng(4)
    base = rng.random((12, 3))
    matrix = base @ base.T
    cells = spark.createDataFrame([(f"k{i}", f"k{j}", float(matrix[i, j])) for i in range(12) for j in range(12)], "a string, b string, v double")
    for block in (200_000, 5):
        got = {r["key"]: np.array(r["vector"]) for r in windows.factors(cells, size=3, rounds=3, cells_per_block=block).collect()}
        table = np.array([got[f"k{i}"] for i in range(12)])
        assert np.allclose(table @ table.T, matrix, atol=1e-3)


def test_neighbours_are_nearer_than_list_mates(spark):
    """All lists hold all items; items of one group stand side by side, the groups in another order each time."""
    rng = np.random.default_rng(1)
    rows = []
    for p in range(40):
        at = 0
        for g in rng.permutation(8):
            for t in rng.permutation(6):
                rows.append((p, at, int(g * 10 + t)))
                at += 1
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["key"]: np.array(r["vector"]) for r in models.train_embeddings(models.key_rows(df), size=8, negatives=1).collect()}
    assert set(got) == {r[2] for r in rows} and all(len(v) == 8 for v in got.values())
    near = [cosine(got[a], got[b]) for a in got for b in got if a < b and a // 10 == b // 10]
    far = [cosine(got[a], got[b]) for a in got for b in got if a < b and a // 10 != b // 10]
    assert min(near) > max(far) and np.mean(near) > np.mean(far) + 0.5
    keys = spark.createDataFrame([(g * 10 + t, f"artist {g}") for g in range(8) for t in range(6)], "track bigint, artist string")
    assert {r["key"] for r in models.train_embeddings(models.key_rows(df, keys), size=4).collect()} == {f"artist {g}" for g in range(8)}


def test_truth_leaves_the_query_out(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 5), (2, 0, 7), (3, 0, 9)], SCHEMA)
    asked = spark.createDataFrame([(1, 5), (2, 9)], "pid bigint, query bigint")
    assert sorted((r["pid"], r["track"]) for r in features.truth_without_query(rows, asked).collect()) == [(1, 6), (2, 7)]


def test_long_lists_keep_their_mean(spark):
    df = spark.range(1500).selectExpr("1L AS pid", "id AS track", "CAST(id AS double) AS cf_prob")
    got = {r["track"]: r["cf_rlt_prob"] for r in features.relative_score(df).collect()}
    assert len(got) == 1500 and abs(got[1499] - 1499 / 749.5) < 1e-12


def test_svc_beats_the_first_order_on_planted_lists(spark):
    """A track that few lists hold, always beside the seed, against one that all lists hold."""
    rows = [(p, 0, 0) for p in range(60)] + [(p, 1, 1) for p in range(6)] + [(p, 2, 2) for p in range(6)]
    rows += [(100 + p, 0, 3 + p % 5) for p in range(50)] + [(100 + p, 1, 0) for p in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    seeds = spark.createDataFrame([(900, 0, 1)], SCHEMA)
    table = models.svc_features(normalised_features(seeds, cells_of(df, counted=True)), seeds)
    best = models.svc_rerank_pooled(table, c=1.0, k=5, max_iter=50).collect()
    assert {r["track"] for r in best} == {0, 2}


def test_svc_leaves_a_tracks_own_term_out_and_returns_no_seed(spark):
    df = spark.createDataFrame(random_interactions(), SCHEMA)
    seeds = spark.createDataFrame([(100 + i % 4, i, i % 9) for i in range(16)], SCHEMA)
    pairs = normalised_features(seeds, cells_of(df, counted=True))
    table = models.svc_features(pairs, seeds)
    v = {(r["seed"], r["track"]): r["v"] for r in pairs.collect()}
    own = {(r["pid"], r["track"]) for r in seeds.collect()}
    for r in table.collect():
        terms = [v[s, r["track"]] for p, s in own if p == r["test"] and s != r["track"] and (s, r["track"]) in v]
        assert r["label"] == int((r["test"], r["track"]) in own)
        assert r["v_count"] == len(terms) and abs(r["v_sum"] - sum(terms)) < 1e-9
    best = models.svc_rerank_pooled(table, c=0.05, k=10, max_iter=5).collect()
    assert best and not own & {(r["pid"], r["track"]) for r in best}
    assert all(np.isfinite(r["score"]) and 1 <= r["rank"] <= 10 for r in best)


def brute_svc(x, y, times, c):
    """The minimum of (|w|^2 + b^2) / 2 + c * sum of squared hinge losses, by many small steps of a Newton method."""
    x = np.hstack([x, np.ones((len(x), 1))])

    def at(w):
        short = np.maximum(1 - y * (x @ w), 0)
        on = short > 0
        gradient = w - 2 * c * (times * y * short) @ x
        return w @ w / 2 + c * (times * short**2).sum(), gradient, np.eye(len(w)) + 2 * c * (x[on].T * times[on]) @ x[on]

    w = np.zeros(x.shape[1])
    for _ in range(500):
        loss, gradient, curve = at(w)
        step, t = -np.linalg.solve(curve, gradient), 1.0
        while at(w + t * step)[0] > loss + 1e-4 * t * (gradient @ step) and t > 1e-12:
            t /= 2
        w = w + t * step
    return w


@pytest.mark.parametrize("rows_per_pack", [2000, 7])
def test_models_of_lists_equal_brute_force(spark, rows_per_pack):
    df = spark.createDataFrame(random_interactions(), SCHEMA)
    seeds = spark.createDataFrame([(100 + i % 4, i, i % 9) for i in range(16)] + [(200, 0, 7777), (201, 0, 3), (201, 1, 3)], SCHEMA)
    n_tracks = 200
    for weighted in (False, True):
        pairs = (weighted_features if weighted else normalised_features)(seeds, cells_of(df, counted=True))
        packs = listmodels.packed(listmodels.candidate_rows(pairs, seeds, n_tracks), rows_per_pack)
        weights = {r["test"]: np.array(r["w"]) for r in listmodels.fit_lists(packs, c=0.5).collect()}
        scores = {(r["test"], r["track"]): (r["label"], r["score"]) for r in listmodels.decide(packs, listmodels.fit_lists(packs, c=0.5)).collect()}
        values = {(r["test"] if weighted else None, r["seed"], r["track"]): r["v"] for r in pairs.collect()}
        own = {}
        for r in seeds.collect():
            own.setdefault(r["pid"], set()).add(r["track"])
        assert set(weights) == set(own)
        for test, held in own.items():
            order = sorted(held)
            tracks = sorted({t for (p, s, t) in values if s in held and p in (None, test)} | held)
            x = np.array([[values.get((test if weighted else None, s, t), 0.0) for s in order] for t in tracks] + [[0.0] * len(order)])
            y = np.array([1.0 if t in held else -1.0 for t in tracks] + [-1.0])
            want = brute_svc(x, y, np.array([1.0] * len(tracks) + [n_tracks - len(tracks)]), 0.5)
            assert np.allclose(weights[test], want, rtol=1e-4, atol=1e-6)
            assert {t for p, t in scores if p == test} == set(tracks)
            for t, row in zip(tracks, x):
                label, score = scores[test, t]
                assert label == (t in held) and abs(score - (row @ want[:-1] + want[-1])) < 1e-4
        best = models.svc_rerank(pairs, seeds, n_tracks, c=0.5, k=10).collect()
        assert best and not [r for r in best if r["track"] in own[r["pid"]]]


def test_own_models_beat_one_for_all(spark):
    """Lists of a rare and a popular seed: each list's own weights put what stands beside both its seeds first; the statistics
    that one model has for all lists cannot tell the seeds apart."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):  # groups of tracks g*10 .. g*10+9 stand together; track 900 + g stands everywhere
        for p in range(30):
            held = [*(g * 10 + rng.choice(10, 5, replace=False)), 900 + int(rng.integers(0, 6)), *(1000 + rng.integers(0, 40, 3))]
            rows += [(g * 100 + p, i, int(t)) for i, t in enumerate(held)]
    seeds = [(5000 + g, i, t) for g in range(6) for i, t in enumerate([g * 10, g * 10 + 1, g * 10 + 2, 900, 901, 902])]
    df, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(seeds, SCHEMA)
    pairs = materialize(normalised_features(asked, cells_of(df, counted=True)), "pairs")

    def hits(ranked):
        return sum(10 * (r["pid"] - 5000) + 3 <= r["track"] < 10 * (r["pid"] - 5000) + 10 for r in ranked.collect())

    own = hits(models.svc_rerank(pairs, asked, 1200, c=0.05, k=7))
    pooled = hits(models.svc_rerank_pooled(models.svc_features(pairs, asked), c=0.05, k=7))
    assert own > pooled or own == 42, (own, pooled)


def test_trees_stop_after_patience_and_keep_the_best_round(spark):
    assert models.best_round([5, 4, 3, 3.5, 3.2, 3.1], 3) == (3, True)
    assert models.best_round([5, 4, 3, 3.5, 3.2], 3) == (3, False) and models.best_round([1.0], 5) == (1, False)
    rng = np.random.default_rng(6)
    rows = [(p, t, float(a), float(b), int(rng.random() < 0.15 + 0.7 * (a > 0.4))) for p in range(80) for t in range(8) for a, b in [rng.random(2)]]
    table = spark.createDataFrame(rows, "pid bigint, track bigint, cf_prob double, cf_rlt_prob double, label int")
    done = models.gbt_train(table, rounds=200, rate=0.3)
    assert done.rounds < 200 and len(done.errors) < 200 and done.trees.getNumTrees == done.rounds
    assert done.errors[done.rounds - 1] == min(done.errors[: done.rounds + 5]) and done.auc > 0.7
    slow = models.gbt_train(table, rounds=60, rate=0.05)
    assert slow.rounds > done.rounds and slow.errors[slow.rounds - 1] < slow.errors[0]
    longer = models.gbt_train(table, rounds=slow.rounds + 3, rate=0.05, patience=1000)
    assert [t.toDebugString.split("\n", 1)[1] for t in longer.trees.trees[: slow.rounds]] == [t.toDebugString.split("\n", 1)[1] for t in slow.trees.trees]


def test_boosted_trees_learn_the_label(spark):
    rows = [(p, t, t / 10.0, 1.0 + t / 10, int(t > 6)) for p in range(60) for t in range(10)]
    table = spark.createDataFrame(rows, "pid bigint, track bigint, cf_prob double, cf_rlt_prob double, label int")
    scored = models.gbt_score(models.gbt_train(table, rounds=8, rate=0.3), table)
    means = {r["label"]: r["m"] for r in scored.join(table.select("pid", "track", "label"), ["pid", "track"])
             .groupBy("label").agg({"prob": "avg"}).toDF("label", "m").collect()}
    assert means[1] > means[0] + 0.5
    top = rank.topk_per_list(scored.select("pid", "track", "prob"), 3, "prob").collect()
    assert {r["track"] for r in top} == {7, 8, 9}


def test_trees_are_cut_without_another_fit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(p, t, float(a), 0.5, int(rng.random() < 0.15 + 0.7 * (a > 0.4))) for p in range(80) for t in range(8) for a in rng.random(1)]
    table = spark.createDataFrame(rows, "pid bigint, track bigint, cf_prob double, cf_rlt_prob double, label int")
    fits, fit = [], models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, df: fits.append((self, fit(self, df), df)) or fits[-1][1])
    done = models.gbt_train(table, rounds=200, rate=0.3)
    assert [f.getMaxIter() for f, _, _ in fits] == [25] and done.rounds < 25
    regressor, _, fitting = fits[0]
    again = fit(regressor.copy({regressor.maxIter: done.rounds}), fitting)
    assert [t.toDebugString.split("\n", 1)[1] for t in again.trees] == [t.toDebugString.split("\n", 1)[1] for t in done.trees.trees]
    assert again.treeWeights == done.trees.treeWeights
    own = {r["track"]: r["prob"] for r in models.gbt_score(done, table.filter("pid = 3")).collect()}
    assert own == {r["track"]: r["prob"] for r in again.transform(done.model.stages[0].transform(table.filter("pid = 3"))).collect()}
    # An input that no tree uses has no weight, also behind the last one that is used.
    assert list(done.importances) == ["track", "cf_prob", "cf_rlt_prob"] and done.importances["cf_rlt_prob"] == 0.0
    assert list(done.importances.values()) == again.featureImportances.toArray().tolist()
