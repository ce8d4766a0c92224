import collections
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segue.llm import language, quality
from segue.llm.carry import held_out
from tests.llm.corner import SCHEMA, TEXTS, corner_docs, empty_docs, rows

SAMPLES = {"aa": ["abab abba", "baab ab", "bbba a"], "xx": ["xyxy xyyx", "yx xy"]}


def brute_probability(lang, context, symbol):
    levels = {}
    for name, texts in SAMPLES.items():
        counts = collections.Counter()
        for t in texts:
            s = "   " + t + " "
            counts.update(s[i - 3 : i + 1] for i in range(3, len(s)))
        levels[name] = {4: counts}
        for n in (3, 2, 1):
            levels[name][n] = collections.Counter(g[1:] for g in levels[name][n + 1])
    size = 1 + len({g for own in levels.values() for g in own[1]})

    def p(n, gram):
        counts = levels[lang][n]
        ones, twos = (sum(v == x for v in counts.values()) for x in (1, 2))
        discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
        if n == 1:
            total = sum(counts.values())
            return max(counts[gram] - discount, 0) / total + discount * len(counts) / total / size
        total = sum(v for g, v in counts.items() if g[:-1] == gram[:-1])
        kinds = sum(g[:-1] == gram[:-1] for g in counts)
        low = p(n - 1, gram[1:])
        return (max(counts[gram] - discount, 0) + discount * kinds * low) / total if total else low

    return math.log(p(4, context + symbol))


def test_character_models_against_brute_force():
    counts = collections.Counter((lang, int(g)) for lang, texts in SAMPLES.items() for t in texts for g in language.ngrams([t])[0])
    model = language.build(pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "gram", "n"]))
    for text in ("abxy ab", "zz yxab b", "ba"):
        found = model.log_probability(language.ngrams([text])[0])
        s = "   " + text + " "
        for i in range(3, len(s)):
            for j, lang in enumerate(model.langs):
                assert abs(found[i - 3, j] - brute_probability(lang, s[i - 3 : i], s[i])) < 1e-5


def test_model_is_a_distribution():
    counts = collections.Counter((lang, int(g)) for lang, texts in SAMPLES.items() for t in texts for g in language.ngrams([t])[0])
    model = language.build(pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "gram", "n"]))
    alphabet = "abxy "
    for context in ("  a", "xyx", "zzz"):
        grams = np.concatenate([language.ngrams([context + c])[0][-1:] if c != " " else language.ngrams([context])[0][-1:] for c in alphabet])
        context_grams = np.array([(int(g) & 0xFFFF) | sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context)) for g in grams], np.uint64)
        context_grams = (context_grams & ~np.uint64(0xFFFF)) | np.array([ord(c) for c in alphabet], np.uint64)
        total = np.exp(model.log_probability(context_grams).astype(float)).sum(axis=0) + np.exp(model.unseen) * 0
        assert (total <= 1 + 1e-5).all() and (total > 0.8).all()


def test_ngrams_of_corner_texts():
    grams, offs, letters = language.ngrams([t for _, t, *_ in TEXTS])
    assert letters.tolist() == [True, True, True, False, False, False, False, True, True, True, True, True, True]
    assert (np.diff(offs)[~letters] == 0).all()
    alone = [language.ngrams([t])[0].tolist() for _, t, *_ in TEXTS]
    assert [grams[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == alone


def lang_docs(spark, n=400):
    random.seed(4)
    pools = {"de": ["straße", "und", "der", "hund", "läuft", "nicht"], "en": ["street", "and", "the", "dog", "runs", "not"]}
    texts = [(i, " ".join(random.choices(pools[k], k=random.randint(3, 30))), k, None) for i in range(n) for k in [random.choice(["de", "en"])]]
    return texts


def test_language_by_held_out_accuracy(spark):
    texts = lang_docs(spark) + [(9000, None, "de", None), (9001, "12 !", "de", None), (9002, "щъ " * 40, None, None)]
    got = language.identify_held_out(corner_docs(spark, texts)).select("row.doc_id", "row.lang", "lang_pred", "score", "rejected", "row.key").collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts) and all(by_id[i].lang_pred == lang for i, _, lang, _ in texts if i < 9000)
    assert sum(by_id[i].rejected for i, *_ in texts if i < 9000) == 0
    assert [(by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) for i in (9000, 9001)] == [("und", 0.0, True)] * 2
    assert by_id[9002].lang_pred in ("de", "en")


def test_language_judges_texts_of_every_length(spark):
    """Gibberish and a foreign language go whether or not known texts of their length exist; what is known stays."""
    random.seed(6)
    pools = {"de": ["straße", "und", "der", "hund", "läuft", "nicht"], "en": ["street", "and", "the", "dog", "runs", "not"]}
    prose = lambda k, n: " ".join(random.choices(pools[k], k=n))
    letters = lambda n: " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(3, 9))) for _ in range(n))
    spanish = lambda n: " ".join(random.choices("la casa blanca tiene muchas ventanas pequeñas hacia el jardín".split(), k=n))
    known = [(i, prose(k, random.randint(40, 160)), k, None) for i in range(300) for k in [random.choice(["de", "en"])]]
    known += [(300 + i, "щука плывёт по реке " * (3 + i), "ru", None) for i in range(8)]  # a rare language
    bad = [(1000 + i, make(n), None, None) for i, (make, n) in enumerate((m, n) for m in (letters, spanish) for n in (6, 20, 80, 600, 9000))]
    bad += [(1100, "жжъъ ыыэъ " * 50, None, None)]
    good = [(2000 + i, prose(k, n), None, None) for i, (k, n) in enumerate((k, n) for k in pools for n in (1, 2, 5, 600, 9000))]
    good += [(2100, "щука плывёт по реке " * 30, None, None)]
    found = language.identify(corner_docs(spark, known + bad + good), corner_docs(spark, known), keep=["doc_id"])
    rejected = {r.doc_id for r in found.select("row.doc_id", "rejected").collect() if r.rejected}
    assert rejected == {i for i, *_ in bad}


def test_language_bounds():
    full = ("en", "en", 8, 400, 1.5, 0.04)
    found = [full, ("en", "en", 3, 2, 9.0, 4.0), ("en", "xx", 8, 90, 7.0, 1.0), ("xx", "xx", 6, 3, 2.0, 0.0)]
    got = {(lang, c): (m, d) for lang, c, m, d in language.bounds(found, ["en", "xx", "zz"])}
    assert set(got) == {(lang, c) for lang in ("en", "xx", "zz") for c in range(65)}
    assert got["en", 8] == got["en", 30] == (1.5, 0.2) and got["en", 4] == (1.5, 0.8)
    assert got["xx", 6][0] == 2.0 and got["xx", 6][1] > 0.2 and got["zz", 8][0] > 1.5
    assert language.bounds([], ["en"]) == []


def test_language_blocks_equal_the_whole_model(spark):
    """A model that does not fit one block leaves no n-gram out: all results are those of the whole model."""
    texts = lang_docs(spark, 300) + [(900, None, None, None), (901, "12 !", "de", None), (902, "щъ " * 40, None, None), (903, "xyz qq " * 9, None, None)]
    docs = corner_docs(spark, texts)
    blocks = language.train(docs, block_cells=60)
    assert language.train(docs).n == 1 and blocks.n > 3 and (blocks.pieces > 1).any()
    whole = language.train(docs).load(0)
    grams = language.ngrams([t for _, t, *_ in texts])[0]
    for b in range(blocks.n):
        mine = grams[blocks.of(grams) == b]
        np.testing.assert_allclose(blocks.load(b).log_probability(mine), whole.log_probability(mine), rtol=1e-6)
    read = lambda **size: {r.doc_id: r for r in language.identify(docs, docs, keep=["doc_id", "lang"], **size).select("row.doc_id", "lang_pred", "rejected", "score", "cross_entropy").collect()}
    want, got = read(), read(block_cells=60)
    assert len(got) == len(texts) and {i: r[:3] for i, r in got.items()} == {i: r[:3] for i, r in want.items()}
    for i, r in want.items():
        assert got[i].score == pytest.approx(r.score, abs=1e-6) and got[i].cross_entropy == pytest.approx(r.cross_entropy, abs=1e-6)


def test_language_does_not_read_the_hold_out(spark):
    texts = lang_docs(spark, 200)
    docs = corner_docs(spark, texts)
    turned = docs.withColumn("lang", F.when(held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    read = lambda d: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify_held_out(d).select("row.doc_id", "lang_pred", "score").collect())
    assert read(docs) == read(turned)


def test_language_takes_corner_rows(spark):
    got = language.identify_held_out(corner_docs(spark)).select("row.*", F.col("lang_pred").alias("found")).collect()
    assert len(got) == len(TEXTS) and all(r.key == "clash" for r in got)
    assert {r.found for r in got if r.text is None or r.doc_id in (3, 4, 5)} == {"und"}
    assert language.identify_held_out(empty_docs(spark)).collect() == []
    nothing = corner_docs(spark, [(i, t, None, None) for i, t, *_ in TEXTS])
    assert all(r.lang_pred == "und" and r.rejected for r in language.identify_held_out(nothing).collect())


def test_sorted_hashes():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000).astype(np.uint64))
    index = language.SortedHashes(keys)
    at = index.find(keys)
    assert (keys[index.order[at]] == keys).all()
    assert (index.find(keys + np.uint64(1 << 61)) == -1).all()


def test_dual_descent_reaches_the_hinge_optimum():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 20)) < 0.3).astype(float)
    labels = (x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.1, 300) > 0.3).astype(int)
    values = np.concatenate([np.flatnonzero(r) for r in x]).astype(np.int32)
    offs = np.concatenate([[0], np.cumsum([int(r.sum()) for r in x])])
    weights = quality.descend(values, offs, labels, np.ones(20), epochs=400)
    unit = x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)
    sign = labels * 2.0 - 1
    cost = len(labels) / (2 * np.where(labels > 0, (labels > 0).sum(), (labels <= 0).sum()))
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - sign * (unit @ w[:-1] + w[-1]))).sum()
    best = loss(weights)
    for _ in range(200):
        assert loss(weights + rng.normal(0, 0.02, 21)) > best * 0.999


def test_features_are_sets_by_text():
    texts = [t for _, t, *_ in TEXTS]
    values, offs = quality.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own, _ = quality.features(pa.array([t], pa.string()))
        assert values[offs[i] : offs[i + 1]].tolist() == own.tolist() == sorted(set(own.tolist()))


def quality_docs(n=600):
    random.seed(5)
    out, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = random.choices(["tree", "house", "river", "walks", "sings", "slowly"], k=random.randint(5, 40))
        out.append((i, " ".join(words if good else [w + random.choice(["%%%", "$$$"]) for w in words]), None, None))
        labels.append((i, int(good)))
    return out, labels


def test_quality_by_held_out_accuracy(spark):
    texts, labels = quality_docs()
    labels = spark.createDataFrame(labels + [(0, 0), (None, 1), (5, None), (10**6, 1)], "doc_id long, quality int")
    found = quality.classify_held_out(corner_docs(spark, texts + TEXTS[3:6]), labels)
    got = found.withColumn("held", held_out("row.doc_id")).select("row.doc_id", "row.text", "score", "predicted", "held").collect()
    assert len(got) == len(texts) + 3
    right = [r.predicted == int("%%%" not in r.text and "$$$" not in r.text) for r in got if r.held and r.text and len(r.text) > 20]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_does_not_read_the_hold_out(spark):
    texts, labels = quality_docs(300)
    docs, labels = corner_docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    read = lambda l: sorted((r.doc_id, round(r.score, 9)) for r in quality.classify_held_out(docs, l).select("row.doc_id", "score").collect())
    assert read(labels) == read(turned)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify_held_out(corner_docs(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (8, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.classify_held_out(corner_docs(spark), one).collect()} == {1.0}
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.classify_held_out(docs, one).collect() == [] and rows(TEXTS)
