"""Periodic runs, mixing and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from segue.llm import mixing, periodic, spelling
from segue.llm.arrays import Spans, text_bytes
from tests.llm.corner import LONG, TEXTS, corner_docs, empty_docs

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, powers=4, least=6):
    """(start, length, period) of all runs, period by period."""
    n, found = len(words), {}
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, powers * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted_words(doc_id, text):
    words = SPACE.findall(text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_op11(rows):
    out = []
    for doc_id, text in rows:
        words = planted_words(doc_id, text)
        runs = brute_runs(words)
        best = None
        for a, n, q in runs:  # in the order of start and period
            if best is None or n * best[2] > best[1] * q:
                best = (a, n, q)
        sha = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        text_sha = hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        out.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha, text_sha))
    return sorted(out, key=repr)


def op11_rows(df):
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 12), st.integers(1, 40), st.integers(0, 1 << 30))
def test_catcher_equals_brute_force_however_words_arrive(words, period, times, seed):
    rng = random.Random(seed)
    words = words[:40] + (words[:period] * times)[:120] + words[40:]
    names = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    catcher, i = periodic.SquareCatcher(), 0
    while i < len(names):
        step = rng.randint(1, 30)
        catcher.append(names[i : i + step])
        i += step
    assert [(a, b - a, q) for a, b, q in catcher.runs().tolist()] == brute_runs(words)


def test_one_word_repeated_and_overlapping_runs():
    catcher = periodic.SquareCatcher(200_000)
    catcher.append(np.full(200_000, 7, np.uint64))
    assert catcher.runs().tolist() == [[0, 200_000, 1]]
    assert brute_runs(list("ababababaaaaaaa")) == [(0, 9, 2), (8, 7, 1)]


def test_runs_do_not_cross_texts():
    import pyarrow as pa

    data, offs = text_bytes(pa.array(["a b a b a b", "a b a b a b a b", "x", None, "z " * 9]))
    rows, cuts = periodic.runs_of_texts(data, Spans(data, offs))
    assert cuts.tolist() == [0, 0, 1, 1, 1, 2] and rows.tolist() == [[0, 8, 2], [0, 9, 1]]


def test_op11_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 30_000]
    short = docs.filter("coalesce(length(text), 0) < 30000")
    want = brute_op11(rows)
    found = periodic.op11_periodic_runs(spark, FOLDER)
    assert op11_rows(found.join(short.select("doc_id"), "doc_id", "left_semi")) == want
    assert sum(r[1] for r in want) > 5


def test_runs_of_corner_rows(spark):
    texts = TEXTS + [(20, "ha " * 50 + "end", "en", "a"), (21, "a b c " * 5 + "a b", "en", "a"), (21, "ah " * 6, None, None)]
    got = periodic.collapse_runs(corner_docs(spark, texts)).collect()
    want = []
    for i, t, *_ in texts:
        words = SPACE.findall(t or "")
        runs = [(0, len(words), 5)] if t == LONG else brute_runs(words)
        want.append((i, len(words), runs, collapsed(words, runs)))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert periodic.collapse_runs(empty_docs(spark)).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Targets by the words of the rule: shares by weight, stopped ones give their excess to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values()) * percent / 100
    while True:
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**target, **share}
        target |= {s: most * sizes[s] for s in over}


def check_mix(rows, texts):
    sizes = collections.Counter()
    smallest = {}
    for _, text, *_, source in texts:
        n = len(SPACE.findall(text or ""))
        sizes[source] += n
        if n:
            smallest[source] = min(smallest.get(source, n), n)
    target = brute_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-12, abs=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == sorted(((t[0], len(SPACE.findall(t[1] or ""))) for t in texts), key=repr)
    return taken, target, smallest


def brute_multiplier(sizes, target, scale, most=2):
    low, high = -1e6, 1e6
    for _ in range(300):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            taken = (sizes * np.minimum(most, np.exp(mid * sizes / scale))).sum()
        low, high = (mid, high) if taken < target else (low, mid)
    return (low + high) / 2


def test_mixing_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    rows = [r.asDict() for r in mixing.mix_sources(docs, F.col("source")).collect()]
    texts = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    taken, target, smallest = check_mix(rows, texts)
    for source, t in target.items():
        own = [r for r in rows if r["source"] == source and r["size"]]
        assert abs(taken[source] - t) <= smallest[source] + 0.002 * t
        sizes = np.array([r["size"] for r in own], float)
        if t < 2 * sizes.sum():
            scale = (sizes**2).sum() / sizes.sum()
            rate = np.minimum(2, np.exp(brute_multiplier(sizes, t, scale) * sizes / scale))
            assert np.allclose([r["rate"] for r in own], rate, rtol=1e-4)
        else:
            assert all(r["rate"] == 2 for r in own)
        # A whole copy is the rate rounded, but for what the cells before it left over.
        assert all(abs(r["copies"] - r["rate"]) <= 1.5 + 1e-9 for r in own)
    again = [r.asDict() for r in mixing.mix_sources(docs.repartition(7), F.col("source")).collect()]
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_mixing_of_corner_rows(spark):
    from pyspark.sql import functions as F

    rows = [r.asDict() for r in mixing.mix_sources(corner_docs(spark), F.col("source")).collect()]
    check_mix(rows, TEXTS)
    assert mixing.mix_sources(empty_docs(spark), F.col("source")).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_sources(blank, F.col("source")).collect()] == [(0.0, 0), (0.0, 0)]


def brute_words(texts, slip=199, min_length=6, min_count=5):
    counts = collections.Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if n >= min_count and len(w) >= min_length}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(counts, lead=5):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= lead * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def variant_rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_words_and_variants_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert variant_rows(spelling.op13_spelling_variants(spark, FOLDER)) == brute_variants(brute_words(texts))


def test_words_of_corner_rows(spark):
    texts = TEXTS + [(30, "Größe GRÖßE größe", None, None), (31, "x" * 100 + " " + "y" * 70_000, None, None), (32, "naïveté÷×", None, None)]
    got = {r.word: r.n for r in spelling.count_words(corner_docs(spark, texts), min_length=1, min_count=1, slip=3).collect()}
    assert got == brute_words([t[:2] for t in texts], 3, 1, 1)
    assert spelling.count_words(empty_docs(spark)).collect() == []
    assert spelling.group_variants(spelling.count_words(empty_docs(spark))).collect() == []


def test_every_near_pair_is_found(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(150)]
    words = set(base) | {"a" * n for n in range(6, 30)}
    for w in base:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :] + "", w[:i] + "z" + w[i:], w[:i] + "é" + w[i + 1 :]}
    counts = {w: rng.choice([5, 24, 25, 125, 625]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert variant_rows(spelling.group_variants(df)) == brute_variants(counts)
    from segue.operators import skew

    monkeypatch.setattr(skew, "MATCHES_PER_PIECE", 3)  # every signature is cut
    assert variant_rows(spelling.group_variants(df)) == brute_variants(counts)
