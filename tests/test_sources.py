import gzip
import json
import os
import threading
from functools import partial

import pytest

from segue import schemas, sources
from segue.operators.rank import union_slices
from segue.session import materialize, stage_path, temporary_stages, together
from segue.sources.writers import submission_rows, write_submission


def test_json_slices(spark, tmp_path):
    track = {"artist_uri": "a:1", "pos": 0, "artist_name": "A", "track_uri": "t:1", "track_name": "T", "album_uri": "b:1",
             "duration_ms": 1000, "album_name": "B"}
    for i in range(2):
        lists = [{"pid": 10 * i + j, "name": "x", "num_tracks": 2, "modified_at": 1, "tracks": [track, {**track, "pos": 1, "track_uri": "t:2"}]}
                 for j in range(3)]
        lists.append({"pid": 10 * i + 9, "name": None, "num_tracks": 0, "tracks": []})
        (tmp_path / f"slice{i}.json").write_text(json.dumps({"info": {"v": 1}, "playlists": lists}, indent=2))
    lists = sources.read_json_lists(spark, str(tmp_path))
    assert lists.count() == 8
    rows = sources.unnest_tracks(lists)
    assert rows.columns == ["pid"] + schemas.TRACK_FIELDS.names
    assert sorted((r["pid"], r["pos"], r["track_uri"]) for r in rows.collect())[:2] == [(0, 0, "t:1"), (0, 1, "t:2")]
    assert rows.count() == 12


def test_gzip_csv_and_columns(spark, tmp_path):
    path = tmp_path / "x.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("pos,track_uri,pid\n0,5,1\n1,6,1\n")
    got = sources.read_csv_gz(spark, str(path), schemas.INTERACTIONS, ["pid", "track"])
    assert [tuple(r) for r in got.collect()] == [(1, 5), (1, 6)]
    out = str(tmp_path / "out")
    sources.write_table(got, out, "csv")
    assert spark.read.option("header", True).csv(out).count() == 2


def test_text_formats(spark, tmp_path):
    (tmp_path / "trip").write_text("u1\ts1\t3\nu2\ts1\t1\n")
    (tmp_path / "sep").write_text("A1<SEP>S1<SEP>The Band<SEP>Song, one\n")
    (tmp_path / "lines").write_text(" u1 \nu2\n")
    (tmp_path / "idx").write_text("s1 1\ns2 2\n")
    assert [tuple(r) for r in sources.read_triplets(spark, str(tmp_path / "trip")).collect()] == [("u1", "s1", 3), ("u2", "s1", 1)]
    assert tuple(sources.read_sep_tracks(spark, str(tmp_path / "sep")).first()) == ("A1", "S1", "The Band", "Song, one")
    assert [r["user"] for r in sources.read_lines(spark, str(tmp_path / "lines")).collect()] == ["u1", "u2"]
    index = sources.read_key_value(spark, str(tmp_path / "idx"))
    ranked = spark.createDataFrame([(2, 1, "s2"), (2, 2, "s1"), (1, 1, "s1")], "pid int, rank int, song string")
    out = str(tmp_path / "rec")
    sources.write_indexed_lines(ranked, index, out)
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ["1", "2 1"]


def test_row_range(spark):
    df = spark.range(50).withColumnRenamed("id", "pid").repartition(6)
    assert sorted(r["pid"] for r in sources.read_row_range(df, ["pid"], 20, 5).collect()) == [20, 21, 22, 23, 24]


def test_incomplete_lists(spark, tmp_path):
    lists = [{"pid": 1, "name": None, "num_holdouts": 3, "num_samples": 1, "num_tracks": 4, "tracks": [{"pos": 0, "track_uri": "t:1"}]},
             {"pid": 2, "num_holdouts": 5, "num_samples": 0, "num_tracks": 5, "tracks": []}, {"pid": 3, "name": "x"}]
    (tmp_path / "c.json").write_text(json.dumps({"playlists": lists}))
    got = sources.read_json_lists(spark, str(tmp_path), schemas.TEST_SLICE)
    assert sorted((r["pid"], r["name"], r["num_holdouts"]) for r in got.collect()) == [(1, None, 3), (2, None, 5), (3, "x", None)]
    assert [(r["pid"], r["track_uri"], r["album_uri"]) for r in sources.unnest_tracks(got).collect()] == [(1, "t:1", None)]


def test_headerless_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("".join(f"{i},{i * 2},{i % 3}\n" for i in range(20)))
    got = sources.read_csv_rows(spark, str(tmp_path / "r.csv"), schemas.INTERACTIONS, ["pos"], 5, 4)
    assert sorted(tuple(r) for r in got.collect()) == [(i, i * 2, i % 3) for i in range(5, 9)]


def test_submission_rows(spark):
    a = spark.createDataFrame([(1, 1, 9), (1, 2, 8)], "pid int, rank int, track int")
    b = spark.createDataFrame([(2, 1, 7)], "pid int, rank int, track int")
    both = union_slices({"v1": a, "v2": b})
    assert {r["slice"] for r in both.collect()} == {"v1", "v2"}
    assert sorted(tuple(r) for r in submission_rows(both, 3).collect()) == [(1, 9, 8, None), (2, 7, None, None)]


def test_submission_files_are_in_slice_order(spark, tmp_path):
    rows = [(f"v{v}", 5000 - 100 * v + p, r, 100 * v + r) for v in (1, 2, 3, 9, 10) for p in range(40) for r in (1, 2, 3)]
    slices = spark.createDataFrame(rows, "slice string, pid int, rank int, track int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    try:
        write_submission(slices, str(tmp_path / "out"), 3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "out").glob("part-*.csv"))
    assert len(files) > 1
    read = [tuple(map(int, line.split(","))) for f in files for line in f.read_text().splitlines()[1:]]
    place = {p: int(s[1:]) for s, p, *_ in rows}
    order = sorted({(int(s[1:]), p) for s, p, *_ in rows})
    assert [r[0] for r in read] == [p for _, p in order]
    assert all(r[1:] == tuple(100 * place[r[0]] + i for i in (1, 2, 3)) for r in read)


def test_temporary_stages_are_deleted(spark):
    kept = materialize(spark.range(3), "kept")
    with temporary_stages(spark):
        inner = materialize(kept.selectExpr("id * 2 AS id"), "inner")
        files = inner.inputFiles()
        path = stage_path(spark, "result")
        inner.write.parquet(path)
        with pytest.raises(ValueError), temporary_stages(spark):
            lost = materialize(spark.range(1), "lost").inputFiles()
            raise ValueError
    gone = [f.removeprefix("file://") for f in [*files, *lost]]
    assert gone and not any(os.path.exists(f) for f in gone)
    assert kept.count() == 3 and sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 4]


def test_independent_steps_run_at_the_same_time(spark):
    """Each step waits for the other one; results come in the order of the steps, an error of a step is raised."""
    met = threading.Barrier(2)

    def step(n):
        met.wait(60)
        return spark.range(n).count()

    assert together(spark, [partial(step, 3), partial(step, 5)]) == [3, 5] and together(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1 // 0, lambda: 1])
