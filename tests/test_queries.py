"""Every registered query against its SQL on the smallest data set."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from segue.plans.catalog import QUERIES
from segue.plans.challenge import Challenge
from segue.session import materialize
from tests.check_oracles import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
OWN = sorted(QUERIES)  # the training-data queries have tests of their own
MODELS = [name for name in OWN if name not in oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(OWN) & set(oracle_sql())))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    found = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_only_models_have_no_sql():
    assert set(MODELS) == {
        "svc_rerank", "svc_rerank_weighted", "w2v_tracks", "w2v_albums", "w2v_artists", "gbt_train", "gbt_report", "gbt_score",
        "challenge_slices", "evaluate_svc", "evaluate_svc_pooled", "evaluate_gbt", "submission",
    }


@pytest.mark.parametrize("name", [m for m in MODELS if m not in ("challenge_slices", "submission")])
def test_model_query_gives_rows(spark, name):
    assert not queries()[name](spark, FOLDER).isEmpty()


@pytest.fixture(scope="module")
def whole_run(spark):
    return materialize(queries()["challenge_slices"](spark, FOLDER), "whole-run")


def test_whole_run(whole_run):
    rows = whole_run.collect()
    by_list = {}
    for r in rows:
        by_list.setdefault((r["slice"], r["pid"]), []).append((r["rank"], r["track"]))
    assert len({pid for _, pid in by_list}) == len(by_list)
    for ranked in by_list.values():
        ranked.sort()
        assert [r for r, _ in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) <= 500
        assert len({t for _, t in ranked}) == len(ranked)


def test_submission(spark, whole_run, monkeypatch):
    monkeypatch.setattr(Challenge, "run", lambda self: whole_run)  # the run itself is not repeated
    rows = queries()["submission"](spark, FOLDER).collect()
    assert len({r["pid"] for r in rows}) == len(rows) > 0 and len(rows[0]) == 501
    assert all(v is None or v.startswith("track:") for r in rows for v in r[1:])


def test_entry(spark):
    assert entry(spark).count() > 0
