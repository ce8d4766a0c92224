import random

import numpy as np
import pytest

from segue.llm import embeddings, minhash
from segue.llm.components import components
from tests.llm.corner import TEXTS, corner_docs, empty_docs


def brute_components(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(random.randrange(60), random.randrange(60)) for _ in range(45)]
    links += [(200, i) for i in range(201, 230)] + [(7, 7)]
    random.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == brute_components(nodes, [e for e in links if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_near(texts, k):
    sets = {}
    for i, t, *_ in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    ids = sorted(sets)
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return sets, brute_components(ids, links)


def family(first, n, words, changes, rng):
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(changes):
            own[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        out.append((first + i, " ".join(own), None, None))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k, monkeypatch):
    # Large buckets begin at four classes here, so that drawn rounds and blocks take part.
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    texts = family(0, 60, 100, 4, rng) + family(100, 40, 60, 3, rng) + family(200, 6, 300, 9, rng)
    texts += [(300 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(50)), None, None) for i in range(40)]
    texts += [(400, "one", None, None), (401, "One", None, None), (402, "", None, None), (403, None, None, None)]
    got = {r.doc_id: r for r in minhash.near_duplicates(corner_docs(spark, texts), k=k).collect()}
    sets, low = brute_near(texts, k)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == low
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_take_corner_rows(spark):
    got = minhash.near_duplicates(corner_docs(spark)).collect()
    assert len(got) == len(TEXTS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].component_id == 0 and not by_id[1].kept and by_id[0].kept
    assert by_id[None].component_id is None and by_id[None].kept
    assert all(by_id[i].kept and by_id[i].n_shingles == 0 for i in (2, 3, 4))
    assert minhash.near_duplicates(empty_docs(spark)).collect() == []


def test_least_matches_leave_a_miss_probability():
    rng = np.random.default_rng(0)
    least = minhash.least_matches(80, 1e-3)
    equal = rng.random((20_000, minhash.COMPARED)) < 0.85
    alive = np.ones(len(equal), bool)
    for i, m in enumerate(least):
        alive &= equal[:, : (i + 1) * minhash.BATCH].sum(axis=1) >= m
    assert alive.mean() > 0.99
    low = rng.random((20_000, minhash.COMPARED)) < 0.4
    assert (low[:, : minhash.BATCH].sum(axis=1) >= least[0]).mean() < 0.6 and least[-1] > 0.6 * minhash.COMPARED


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, id string, cell string, a long")


def test_lattice_points_are_nearest():
    x = np.random.default_rng(0).standard_normal((500, 8)) * 3
    p = embeddings.nearest_e8(x)
    others = p[:, None, :] + embeddings.NEIGHBOURS
    assert (((x[:, None, :] - others) ** 2).sum(axis=2) >= ((x - p) ** 2).sum(axis=1)[:, None] - 1e-9).all()
    assert len(np.unique(embeddings.NEIGHBOURS, axis=0)) == 240 and np.allclose((embeddings.NEIGHBOURS**2).sum(axis=1), 2)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 32))
    many = np.concatenate([base, *(base[:12] + rng.standard_normal((12, 32)) * s for s in (0.05, 0.1, 0.15, 0.2)), base[:5], base[:5] * 3])
    many = many.astype(np.float32).astype(float)
    label = [int(i % 3) for i in range(40)] + [int(i % 3) for _ in range(4) for i in range(12)] + [i % 3 for i in range(5)] * 2
    got = {r.vec_id: r for r in embeddings.near_vectors(vectors(spark, [(i, v.tolist(), label[i], "x", "y", 1) for i, v in enumerate(many)], kind)).collect()}
    unit = many / np.linalg.norm(many, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    low = brute_components(range(len(many)), list(zip(a.tolist(), b.tolist())))
    assert {i: r.n_links for i, r in got.items()} == {i: int(n) for i, n in enumerate(near.sum(axis=1))}
    assert {i: r.component_id for i, r in got.items()} == low


def test_near_vectors_take_corner_rows(spark):
    v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, v, 2), (3, v, None), (None, v, 1), (4, None, 1), (5, [], 1), (6, [0.0] * 3, 1),
            (7, [1.0, None, 3.0], 1), (8, [nan, 2.0, 3.0], 1), (9, [inf, 2.0, 3.0], 1), (10, [1.0, 2.0], 1), (11, [1e300, 2e300, 3e300], 1)]
    got = embeddings.near_vectors(vectors(spark, [(*r, "x", "y", 1) for r in rows], "double")).collect()
    assert len(got) == len(rows)
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None)
    linked = [(0, 3, 0, True), (1, 3, 0, False), (1, 3, 0, False), (11, 3, 0, False)]
    assert [f for f in found if f[1]] == linked
    assert [f for f in found if not f[1]] == [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 10)]
    assert embeddings.near_vectors(vectors(spark, [])).collect() == []
