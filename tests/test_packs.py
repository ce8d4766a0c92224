import glob

import numpy as np
import pytest

from segue import session
from segue.operators import cooccur, models, packs, skew
from tests.lists import random_interactions

SCHEMA = "pid bigint, pos bigint, track bigint"


@pytest.mark.parametrize("tracks", [[7], [1, 2, 300, 70_000, 1 << 40], [-(1 << 63), -5, 0, (1 << 63) - 1], list(range(0, 9000, 3))])
def test_a_pack_gives_back_what_was_put_in(tracks):
    tracks = np.array(tracks, np.int64)
    columns = [np.ones(len(tracks), np.int64), tracks, np.arange(len(tracks)) % 7 * 100, np.arange(len(tracks)) / 3]
    pack = packs.encode(tracks, *columns)
    got = packs.decode(pack, len(columns))
    assert packs.size_of(pack) == len(tracks) and all(np.array_equal(a, b) for a, b in zip(got, [tracks, *columns]))
    assert got[4].dtype == np.float64 and all(len(c) == 0 for c in packs.decode(packs.encode(tracks[:0], tracks[:0]), 1) + packs.decode(None, 1))


def test_a_pack_is_short():
    """A pair of a seed and a track took sixteen bytes in arrays of whole numbers."""
    rng = np.random.default_rng(1)
    tracks = np.sort(rng.choice(20_000, 900, replace=False))
    assert len(packs.encode(tracks, rng.integers(1, 3, 900), rng.integers(10, 40, 900))) < 3 * 900


def test_groups_are_whole_over_batches():
    """A key whose rows lie in several batches is one group, null keys are a group of their own, and no group is cut to open fewer elements."""
    import pyarrow as pa

    keys = [1] * 5 + [2] + [None] * 4 + [3] * 7 + [4]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 3], pa.int64()), "n": list(range(i, min(i + 3, len(keys))))}) for i in range(0, len(keys), 3)]
    seen = []

    def step(table, heads):
        of = packs.groups_of(heads, table.num_rows)
        seen.extend((table["k"][int(h)].as_py(), table["n"].to_numpy()[of == i].tolist()) for i, h in enumerate(heads))

    assert list(packs.by_group(["k"], step)(iter(batches))) == []
    assert seen == [(1, [0, 1, 2, 3, 4]), (2, [5]), (None, [6, 7, 8, 9]), (3, [10, 11, 12, 13, 14, 15, 16]), (4, [17])]


def test_lists_fit_where_they_lie_rank_as_cut_ones(spark, monkeypatch):
    """A list's own model is fit in the task that has its values, without a stage of packs; cut lists get the same tracks."""
    df = spark.createDataFrame(random_interactions(), SCHEMA)
    seeds = spark.createDataFrame([(100 + i % 3, i, i % 7) for i in range(9)] + [(103, 0, None), (103, 1, 5), (104, 0, 999)], SCHEMA)
    pairs = cooccur.normalised_packs(seeds, cooccur.cells_of(df, counted=True)).staged()
    labels, write = [], session.materialize
    monkeypatch.setattr("segue.operators.listmodels.materialize", lambda d, label="stage": labels.append(label) or write(d, label))
    whole = sorted(tuple(r) for r in models.svc_rerank(pairs, seeds, 40, c=0.5, k=12).collect())
    assert whole and not {"list-packs", "list-weights"} & set(labels)
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 60)
    cut = sorted(tuple(r) for r in models.svc_rerank(pairs, seeds, 40, c=0.5, k=12).collect())
    assert "list-packs" in labels
    places = lambda rows: [(p, r) for p, _, _, r in sorted(rows, key=lambda x: (x[0], x[3]))]
    assert places(whole) == places(cut)
    score = {(p, t): s for p, t, s, _ in cut}
    assert all(abs(score[p, t] - s) < 1e-4 for p, t, s, _ in whole if (p, t) in score) and len(score.keys() & {(p, t) for p, t, _, _ in whole}) > 0.9 * len(cut)


def test_shuffle_files_go_with_their_job(spark):
    """What a written stage shuffled is not kept on disk beside what comes after it."""
    session.configure(spark)
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    folders = [str(x) for x in root]
    spark.sparkContext._jvm.System.gc()
    before = {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    session.materialize(spark.range(200_000).selectExpr("id % 1000 AS k", "id").repartition(5, "k"), "gone")
    import time

    for _ in range(50):
        after = {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
        if not after - before:
            break
        time.sleep(0.2)
    assert not after - before


def test_nearest_items_with_repeated_and_null_keys(spark, monkeypatch):
    """The packs of a query's blocks merge to its best rows; an item that comes twice is two of them, one without a key is found as null."""
    from segue.operators import features

    monkeypatch.setattr(features, "ITEM_BLOCK", 4)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.2]), (2, [1.0, 0.1]), (3, [-1.0, 0.1]), (None, [1.0, 0.05]), (4, [0.0, 0.0]), (5, [0.0, 2.0]), (9, [1.0, 0.2])]
    items = spark.createDataFrame(rows, "track bigint, vector array<float>")
    asked = spark.createDataFrame([(10, 1), (11, 1), (12, 77)], "pid bigint, query bigint")
    found = features.vector_topk(asked, items, k=4)
    assert found.columns == ["query", "pid", "track", "score", "rank"] and dict(found.dtypes)["rank"] == "int"
    got = sorted((r["pid"], r["rank"], r["track"]) for r in found.collect())
    assert got == [(p, i + 1, t) for p in (10, 11) for i, t in enumerate([None, 2, 2, 9])]
    assert {(r["track"], r["score"]) for r in found.collect()} >= {(9, 0.980581), (2, 0.995037)}


def test_retrieved_candidates_are_made_once(spark, monkeypatch):
    """The features read the candidates, and their means, from one written stage."""
    from segue.operators import features

    labels, write = [], session.materialize
    monkeypatch.setattr(features, "materialize", lambda d, label="stage": labels.append(label) or write(d, label))
    candidates = spark.createDataFrame([(1, 5, 2.0), (1, 6, 4.0), (2, 5, 1.0)], "pid bigint, track bigint, cf_prob double")
    items = spark.createDataFrame([(5, 1, 1, "a", "b", "c"), (6, 1, 2, "d", "e", "f")], "track bigint, artist int, album int, track_name string, album_name string, artist_name string")
    lists = spark.createDataFrame([(1, "a"), (2, None)], "pid bigint, clean string")
    table = features.feature_table(candidates, candidates.limit(1), candidates, items, lists, None, {})
    assert labels == ["retrieved"]
    assert table.columns == ["pid", "track", "cf_prob", "cf_rlt_prob", "label", "artist", "album", "name_sim", "album_sim", "artist_sim"]
    assert sorted((r["pid"], r["track"], round(r["cf_rlt_prob"], 6), r["label"]) for r in table.collect()) == [(1, 5, 0.666667, 1), (1, 6, 1.333333, 0), (2, 5, 1.0, 0)]
