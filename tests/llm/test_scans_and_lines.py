import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segue.llm import arrays, licenses, line_dedup, quality_rules
from tests.llm.corner import LONG, TEXTS, corner_docs, empty_docs


def words(text):
    return re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))


def places(text):
    found = words(text)
    return [
        (t.label, i) for t in licenses.BASE for i in range(len(found)) if found[i : i + len(t.words)] == t.words
    ]


def test_license_scan_finds_every_place_of_a_phrase(spark):
    random.seed(1)
    pool = ["mit", "MIT", "license", "License", "apache", "general", "public", "x", "-", "\n", "ß"]
    texts = [(i, " ".join(random.choices(pool, k=random.randint(0, 40))), None, None) for i in range(200)] + TEXTS
    got = licenses.scan(corner_docs(spark, texts), licenses.BASE + licenses.NOTICES).collect()
    assert len(got) == len(texts)
    want = sorted((str(i), len(words(t)), sorted(places(t))) for i, t, *_ in texts)
    have = sorted((str(r.doc_id), r.n_words, sorted((s.label, s.start) for s in r.spans if s.exact)) for r in got)
    assert have == want


def test_license_scan_bridges_changes(spark):
    notice = next(t for t in licenses.NOTICES if t.label == "bsd").words
    changed = notice[:6] + ["some", "more"] + notice[6:]
    half = notice[: len(notice) // 2]
    docs = corner_docs(spark, [(1, " ".join(changed), None, None), (2, " ".join(half), None, None)])
    got = {r.doc_id: r.spans for r in licenses.scan(docs, licenses.NOTICES).collect()}
    assert [(s.label, s.start, s.end) for s in got[1]] == [("bsd", 0, len(changed))] and got[2] == []


def brute_labels(text, min_cover=0.75, slack=3):
    """Labels of a text: every template held against every place, spans inside longer ones left out."""
    found, spans = words(text), []
    for t in licenses.BASE + licenses.NOTICES:
        runs = [tuple(t.words[j : j + t.k]) for j in range(len(t.words) - t.k + 1)]
        hits = {}
        for i in range(len(found) - t.k + 1):
            for j, run in enumerate(runs):
                if tuple(found[i : i + t.k]) == run:
                    hits.setdefault(i - j, []).append((i, j))
        groups = []
        for d in sorted(hits):
            if groups and not t.exact and d - groups[-1][-1] <= slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            own = [h for d in group for h in hits[d]]
            covered, start, end = {j for _, j in own}, min(i for i, _ in own), max(i for i, _ in own) + t.k
            if t.exact:
                good = len(covered) == len(runs)
            else:
                good = len(covered) / len(runs) >= min_cover and end - start <= len(t.words) * 1.25 + slack
                good = good and (not t.telling or len(runs) - 1 in covered)
            if good:
                spans.append((t.label, t.exact, start, end))
    stay = [x for x in spans if x[1] or not any(not y[1] and y[2] <= x[2] and y[3] >= x[3] and y[2:] != x[2:] for y in spans)]
    return sorted({x[0] for x in stay})


SAID = {
    "This page is licensed under CC BY-NC 4.0 by us": ["cc-by-nc"],
    "licensed under CC BY 4.0": ["cc-by"], "Licensed under CC-BY-NC-SA.": ["cc-by-nc-sa"], "licensed under CC BY-ND": ["cc-by-nd"],
    "Our texts are licensed under a Creative Commons Attribution-ShareAlike license": ["cc-by-sa"],
    "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives license": ["cc-by-nc-nd"],
    "licensed under a Creative Commons Attribution license": ["cc-by"],
    "licensed under a Creative Commons Zero dedication": [], "all rights reserved by the author": [],
    licenses._MIT_WARRANTY: ["mit"], f"x {licenses._ISC_GRANT}, {licenses._ISC_REST} y": ["isc"],
    f"{licenses._MIT_GRANT}, {licenses._MIT_RIGHTS} {licenses._MIT_WARRANTY}": ["mit"],
}


def test_license_labels_against_brute_force(spark):
    random.seed(7)
    notices = [t.text for t in licenses.NOTICES]
    texts = list(SAID)
    for _ in range(150):
        parts = []
        for _ in range(random.randint(1, 3)):
            w = random.choice(notices).split()
            for _ in range(random.randint(0, 2)):
                w.insert(random.randrange(len(w) + 1), random.choice(["x", "the", "NonCommercial"])) if random.random() < 0.5 else w.pop(random.randrange(len(w)))
            parts += [*w, *["and"] * random.randint(0, 2)]
        texts.append(" ".join(parts))
    assert all(brute_labels(t) == want for t, want in SAID.items())
    docs = corner_docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: sorted({s.label for s in r.spans}) for r in licenses.scan(docs, licenses.BASE + licenses.NOTICES).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}


def test_license_scan_of_nothing(spark):
    assert licenses.scan(empty_docs(spark), licenses.BASE).collect() == []


def brute_lines(texts, max_share, min_pages):
    norm = lambda l: re.sub(r"[\t\x0b\f\r]", " ", l).strip(" ").lower()
    lines_of = [{norm(l) for l in (t or "").split("\n")} - {""} for _, t, *_ in texts]
    hashed = lambda l: hashlib.md5(l.encode()).hexdigest() + hashlib.md5(b"+" + l.encode()).hexdigest()
    names = [[min((hashed(l)[at : at + 16] for l in ls), default=None) for at in (0, 16, 32, 48)] for ls in lines_of]
    host, total = {}, {}
    for lines, name, (_, _, _, src) in zip(lines_of, names, texts):
        if src is not None and lines:
            total.setdefault(src, [set(), set(), set(), set()])
            for j in range(4):
                total[src][j].add(name[j])
                for l in lines:
                    host.setdefault((src, l), [set(), set(), set(), set()])[j].add(name[j])
    out = []
    for i, t, _, src in texts:
        if t is None or src is None:
            out.append((str(i), t))
            continue

        def over(l):
            n = max((len(x) for x in host.get((src, l), [])), default=0)
            return n >= min_pages and n > max_share * max(map(len, total[src]))

        kept = [l for l in t.split("\n") if not over(norm(l))]
        out.append((str(i), "\n".join(kept) if any(map(norm, kept)) else t))
    return sorted(out, key=repr)


def test_copies_of_a_page_are_no_boilerplate(spark):
    essay = "An essay of three lines\nthat was copied ten times\nwithin one source"
    texts = [(i, f"own line {i}\nMenu\nmore own words {i}\nlast line {i}", None, "a") for i in range(90)]
    texts += [(90 + i, essay, None, "a") for i in range(10)] + [(100 + i, essay + f"\nchanged {i}", None, "b") for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(corner_docs(spark, texts), F.col("source")).collect()}
    assert all(got[90 + i] == essay for i in range(10)) and all(got[i] == texts[i][1].replace("Menu\n", "") for i in range(90))
    assert sorted(((str(i), t) for i, t in got.items()), key=repr) == brute_lines(texts, line_dedup.MAX_SHARE, line_dedup.MIN_PAGES)


@pytest.mark.parametrize("hold_rows", [True, False])
def test_line_dedup_against_brute_force(spark, hold_rows):
    random.seed(2)
    pool = ["Home", " home ", "About us", "x", "y", "", "\t", "z z", "Legal"]
    texts = [(i, "\n".join(random.choices(pool, k=random.randint(0, 6)) + [f"own {i}"]), None, random.choice("ab")) for i in range(60)]
    texts = [*texts, *TEXTS, (70, None, None, "a"), (71, "Home", None, None), (72, "home", None, "c")]
    got = line_dedup.drop_boilerplate(corner_docs(spark, texts), F.col("source"), max_share=0.3, min_pages=3, hold_rows=hold_rows)
    assert got.columns == corner_docs(spark).columns
    assert sorted(((str(r.doc_id), r.text) for r in got.collect()), key=repr) == brute_lines(texts, 0.3, 3)
    assert line_dedup.drop_boilerplate(empty_docs(spark), F.col("source")).collect() == []


def test_page_lines(spark):
    html = "<html><script>var a='<p>';</script><nav><a>Home</a></nav><p>One<br>two &amp; <b>three</b></p><!-- x --></html>"
    pages = spark.createDataFrame([(1, "HTTPS://Ex.com:80/a", html), (2, None, None), (3, "no url", "plain")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.text) for r in line_dedup.page_lines(pages).collect()}
    assert got == {1: ("ex.com:80", "Home\nOne\ntwo &amp;\nthree"), 2: (None, ""), 3: (None, "plain")}


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for l in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", l):
            dup += l in seen
            seen.add(l)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def test_quality_measures_against_brute_force():
    random.seed(3)
    texts = ["".join(random.choices("ab é#%\n\t x", k=random.randint(0, 200))) for _ in range(300)] + [t for _, t, *_ in TEXTS]
    got = quality_rules.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        have = [got[c][i].as_py() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        assert have == brute_measures(text), text[:80]
        assert sum(got["sizes"][i].as_py()) == have[1]


def test_quality_rules_reject_depleted_documents(spark):
    menu = "Read more about our company and its many products and services here today"
    texts = [(i, f"{menu}\nshort own {i} text of five", None, "a") for i in range(8)]
    texts += [(20, f"{menu}\n" + " ".join(f"w{j}" for j in range(80)), None, "a"), (21, menu, None, "b"), (22, menu, None, None)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(corner_docs(spark, texts), F.col("source")).collect()}
    assert not any(got[i].kept for i in range(8)) and got[20].kept and got[21].kept and got[22].kept
    assert got[3].left_chars == len("shortown3textoffive")
    long = [(40 + i, f"own {i}\n\n  {menu.upper()} \n" + ("more\n" * i), None, "c") for i in range(8)] + [(60, None, None, "c"), (61, menu, None, None)]
    shown = quality_rules.apply_rules(corner_docs(spark, texts + long), F.col("source"), with_text=True).collect()
    normal = lambda l: " ".join(l.lower().split())
    held = {}
    for i, t, _, src in texts + long:
        for l in {normal(l) for l in (t or "").split("\n")} - {""}:
            held.setdefault((src, l), set()).add(i)
    size = {src: sum(x[3] == src for x in texts + long) for src in "abc"}
    over = {k for k, docs in held.items() if k[0] and len(docs) >= quality_rules.MIN_DOCS and len(docs) > quality_rules.MAX_SHARE * size[k[0]]}
    want = {i: t if t is None else "\n".join(l for l in t.split("\n") if (src, normal(l)) not in over) for i, t, _, src in texts + long}
    assert {r.doc_id: r.text for r in shown} == want and want[47] == "own 7\n\n"


def test_quality_rules_count_documents_beside_shares(spark):
    """Boilerplate of a large host has a small share: it goes by the lower share, or by the count alone."""
    random.seed(5)
    pool = [f"Common line {j} of the host" for j in range(30)]
    texts = [(i, "\n".join([*random.choices(pool, k=random.randint(0, 3)), f"own {i}"]), None, random.choice("aaab")) for i in range(400)]
    texts += [(i, "Accept all cookies to go on reading\nown " + str(i), None, "c") for i in range(400, 430)]
    texts += [(i, f"own {i}", None, "c") for i in range(430, 1000)]
    docs = corner_docs(spark, texts)

    def brute(max_share, min_docs, max_docs):
        sets = {i: (src, {" ".join(l.lower().split()) for l in t.split("\n")}) for i, t, _, src in texts}
        total, n = {}, {}
        for src, lines in sets.values():
            total[src] = total.get(src, 0) + 1
            for l in lines:
                n[src, l] = n.get((src, l), 0) + 1
        over = {k for k, c in n.items() if c >= min_docs and c > max_share * total[k[0]] or c > max_docs}
        # A repeated line counts once.
        return {i: sum(len(l.replace(" ", "")) for l in lines if (src, l) not in over) for i, (src, lines) in sets.items()}

    def left(**limits):
        got = quality_rules.apply_rules(docs, F.col("source"), **limits).collect()
        distinct = {i: sum(len(l.replace(" ", "")) for l in set(t.lower().split("\n"))) for i, t, *_ in texts}
        return {r.doc_id: distinct[r.doc_id] - (r.word_chars - r.left_chars) for r in got}

    once = [(i, t) for i, t, *_ in texts if len(set(t.split("\n"))) == len(t.split("\n"))]
    for max_share, min_docs, max_docs in ((0.05, 5, 200), (0.5, 5, 20), (0.9, 50, 9), (0.05, 5, 25)):
        have, want = left(max_share=max_share, min_docs=min_docs, max_docs=max_docs), brute(max_share, min_docs, max_docs)
        assert {i: have[i] for i, _ in once} == {i: want[i] for i, _ in once}
    # With the defaults a line on one document in twenty or more goes.
    menu = [(i, f"Terms of use\n{'own' + str(i)}" if i % 10 == 0 else f"own{i}", None, "d") for i in range(300)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(corner_docs(spark, menu), F.col("source")).collect()}
    assert all(r.word_chars - r.left_chars == (len("termsofuse") if i % 10 == 0 else 0) for i, r in got.items())


def test_quality_rules_take_corner_rows(spark):
    got = quality_rules.apply_rules(corner_docs(spark), F.col("source")).collect()
    assert len(got) == len(TEXTS)
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 4, 5, 8))
    assert quality_rules.apply_rules(empty_docs(spark), F.col("source")).collect() == []


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingles_against_brute_force(k):
    random.seed(4)
    texts = [" ".join(random.choices("abc", k=random.randint(0, 12))) for _ in range(100)]
    data, offs = arrays.text_bytes(pa.array(texts))
    spans = arrays.Spans(data, offs)
    grams, bounds = arrays.distinct_per_text(*arrays.shingles(arrays.span_hashes(data, spans.starts, spans.ends), spans.first, k))
    named = {}
    for i, text in enumerate(texts):
        w = text.split()
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        assert bounds[i + 1] - bounds[i] == len(want)
        named.setdefault(frozenset(want), set()).add(tuple(grams[bounds[i] : bounds[i + 1]].tolist()))
    assert all(len(v) == 1 for v in named.values()) and len({next(iter(v)) for v in named.values()}) == len(named)
