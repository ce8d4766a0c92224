"""The queries against their SQL on the smallest tables, and the pipeline against a brute-force version of its steps."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from segue.llm import language, line_dedup, minhash, packing, quality
from segue.llm.bpe_codec import vocabulary_path
from segue.llm.queries import ORACLES, QUERIES
from segue.session import materialize
from tests.check_oracles import TABLES, rows_of
from tests.llm.corner import corner_docs, empty_docs
from tests.llm.test_near_duplicates import brute_near
from tests.llm.test_scans_and_lines import brute_lines

FOLDER = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_": "doc_id held_out score predicted", "op3_": "doc_id n_shingles component_id kept",
    "op4_": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op5_": "vec_id n_links component_id kept",
    "op6_": "doc_id size text_crc32 law shard slot grown_shard", "op7_": "doc_id held_out lang_pred score",
    "op8_": "page_id", "op9_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11_": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_": "doc_id size source_size target taken", "op13_": "word form root n n_near form_n",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_one_query_for_each_operator():
    for start in CONTRACT:
        assert sum(name.startswith(start) for name in QUERIES) == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_its_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    want = next(c for start, c in CONTRACT.items() if name.startswith(start)).split()
    assert df.columns[: len(want)] != [] and set(want) <= set(df.columns)
    assert not df.isEmpty()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], FOLDER), name))
        if name != "packing":
            assert tables[-1].columns == columns
    read = [[r.asDict() for r in t.collect()] for t in tables[:5]]
    by_id = [{r["doc_id"]: r for r in rows} for rows in read]

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    scored = quality.classify_held_out(docs, labels).select("row.doc_id", "score").collect()
    assert set(by_id[1]) == {r.doc_id for r in scored if r.score >= 0.7}
    told = language.identify_held_out(tables[1]).select("row.doc_id", "rejected").collect()
    assert set(by_id[2]) == {r.doc_id for r in told if not r.rejected}

    lines = [(r["doc_id"], r["text"], None, r["source"]) for r in read[2]]
    assert sorted(((str(r["doc_id"]), r["text"]) for r in read[3]), key=repr) == brute_lines(lines, line_dedup.MAX_SHARE, line_dedup.MIN_PAGES)
    assert all(r["n_chars"] == len(r["text"]) for r in read[3])
    _, low = brute_near([(r["doc_id"], r["text"]) for r in read[3]], 5)
    assert set(by_id[4]) == {i for i, c in low.items() if i == c}

    tokenizer = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    ids = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids + [2] for r in read[4]}
    covered = collections.Counter()
    for p in tables[5].collect():
        covered[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    assert covered == {i: len(t) for i, t in ids.items()}


def test_pipeline_drops_a_planted_line(spark):
    """A line on eight of a hundred documents of a source goes; one on four of them stays, as it does elsewhere."""
    texts = [(i, f"own line {i}\n" + ("Subscribe to our letter\n" if i % 13 == 0 else "Rare line\n" if i % 25 == 1 else "") + f"end {i}", "en", "a") for i in range(100)]
    texts += [(100 + i, f"Subscribe to our letter\nelsewhere {i}", "en", "b") for i in range(3)]
    docs = corner_docs(spark, texts)
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup_by_source(spark, docs, FOLDER).collect()}
    want = {i: t.replace("Subscribe to our letter\n", "") if src == "a" else t for i, t, _, src in texts}
    assert {i: r.text for i, r in got.items()} == want and sum(t != want[i] for i, t, *_ in texts) == 8
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_pipeline_stages_take_corner_rows(spark):
    for docs in (corner_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, FOLDER)
            if name != "packing":
                assert found.columns == docs.columns
            found.collect()


def test_run(spark):
    assert not corpus_pipeline.run(spark, FOLDER).isEmpty()
    assert minhash.MISS < 1e-3 and packing.SIZE == 4096
