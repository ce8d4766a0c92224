import collections
import os
import random
import zlib

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segue.llm import bpe, bpe_codec, minhash, packing, quality_rules, sharding
from segue.llm.bpe import Encoder, code_classes
from tests.llm.corner import TEXTS, corner_docs, empty_docs

ODD = [
    "", None, "a", "   ", "don't 's ''s 'll'sx x'd  \n\n y \t'tis", "<|endoftext|>", "x<|endoftext|> <|startoftext|>y<|endoftext|>",
    "É é Σς ΑΣ ǅ ſt İ 𝒳 ½ ² ٣ 中文字 ​   　 x\x85y \x1c z", "a" * 21 + " aaaa aaaaa", "é" * 50, "1234 567 8", "'s't're'",
    "hello   world  ", "́́ áb", "ﬁ Ⅻ ½x", "\r\n\r\n x", " 's  's 't", "!!!???...''' 'S 'T", "<|endoftext", "|><|endoftext|",
]


def library(name):
    return Tokenizer.from_file(bpe_codec.vocabulary_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_library_s_ids(name):
    random.seed(1)
    texts = ODD + ["".join(random.choices("ab 's\nt1é.,'  lrevd\t", k=random.randint(0, 60))) for _ in range(2000)]
    texts += [t for _, t, *_ in TEXTS]
    encoder, tokenizer = Encoder(bpe_codec.vocabulary_path(name)), library(name)
    for part in (texts[:700], texts[700:], texts[:50]):
        ids, bounds = encoder.encode(part)
        for i, text in enumerate(part):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_letters_and_numbers_are_the_library_s():
    """Every assigned code point of the basic plane falls into the class that the library's pattern gives it."""
    tokenizer = library("byte_bpe_50k.json")
    kind = code_classes()
    points = [c for c in range(0x21, 0xD800) if kind[c] in (1, 2)]
    wrong = [c for c in points[::7] if len(tokenizer.pre_tokenizer.pre_tokenize_str(f"{'a' if kind[c] == 1 else '1'}{chr(c)}")) != 1]
    assert wrong == []


def test_encode_and_decode(spark):
    path = bpe_codec.vocabulary_path("byte_bpe_50k.json")
    tokenizer = library("byte_bpe_50k.json")
    got = bpe_codec.decode(bpe_codec.encode(corner_docs(spark), path), path).collect()
    assert len(got) == len(TEXTS)
    want = sorted((str(i), t or "", tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in TEXTS)
    assert sorted((str(r.doc_id), r.decoded, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert all(tokenizer.decode(ids, skip_special_tokens=False) == t for _, t, ids in want)
    assert bpe_codec.encode(empty_docs(spark), path).collect() == []
    cut = spark.createDataFrame([(1, 1, bytearray(np.array([35050], "<u4").tobytes()))], "doc_id long, n_tokens long, ids binary")
    assert bpe_codec.decode(cut, path).first().decoded == tokenizer.decode([35050])


def check_packed(pieces, documents, size):
    """documents: key -> list of id lists."""
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for key, tokens in documents.items():
        have = collections.Counter()
        for p in by_doc[key]:
            raw = np.frombuffer(p.ids, "<u4").tolist()
            assert p.length == len(raw) and p.ids_crc32 == zlib.crc32(bytes(p.ids))
            assert any(t[p.start : p.start + p.length] == raw and len(t) == p.doc_tokens for t in tokens)
            have.update(range(p.start, p.start + p.length))
        want = collections.Counter()
        for t in tokens:
            want.update(range(len(t)))
        assert have == want
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == size or (at < size and at & (at - 1) == 0)
    fills = [sum(p.length for p in own) for own in sequences.values()]
    assert sum(f != size for f in fills) <= size.bit_length()


@pytest.mark.parametrize("partitions", [1, 7])
def test_packing(spark, partitions, monkeypatch):
    monkeypatch.setattr(packing, "PARTITIONS_PER_GROUP", 2)
    random.seed(2)
    texts = [(100 + i, " ".join(random.choices(["a", "the", "house"], k=random.randint(0, 90))), None, None) for i in range(150)]
    texts += [t for t in TEXTS if len(t[1] or "") < 1000]
    tokenizer = library("word_bpe_49k.json")
    documents = collections.defaultdict(list)
    for i, t, *_ in texts:
        documents[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    docs = corner_docs(spark, texts).repartition(partitions)
    got = packing.pack(docs, bpe_codec.vocabulary_path("word_bpe_49k.json"), size=64, open_windows=3).collect()
    check_packed(got, documents, 64)


def test_packing_of_nothing_and_of_long_texts(spark):
    path = bpe_codec.vocabulary_path("word_bpe_49k.json")
    assert packing.pack(empty_docs(spark), path).collect() == []
    tokenizer = library("word_bpe_49k.json")
    documents = collections.defaultdict(list)
    for i, t, *_ in TEXTS:
        documents[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    check_packed(packing.pack(corner_docs(spark), path).collect(), documents, 4096)


def test_best_fit_prefers_the_tightest_window():
    windows = packing.Windows(10, 3)
    tokens = lambda n: np.zeros(n, np.int32)
    assert list(windows.place(1, tokens(7))) == [] and list(windows.place(2, tokens(4))) == []
    assert list(windows.place(3, tokens(3)))[0][0][0] == 1  # 7 + 3 fill a window
    assert sorted(windows.free.tolist()) == [6, 10, 10]
    assert len(list(windows.place(4, tokens(25)))) == 2


def shards_of(got):
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    return by


def test_sharding(spark):
    random.seed(3)
    texts = [(i, "x y " * random.randint(0, 300), None, None) for i in range(1500)]
    texts += [(2000 + i, "same text " * 20, None, None) for i in range(900)]  # a group above a third of the rows
    got = sharding.shard(corner_docs(spark, texts), units_per_partition=200).collect()
    assert len(got) == len(texts)
    by = shards_of(got)
    assert set(by) == set(range(16))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    sizes = [sum(r.size for r in rows) for rows in by.values()]
    assert max(sizes) - min(sizes) < 0.03 * min(sizes)
    text_of = dict((i, t) for i, t, *_ in texts)
    assert all(r.size == len(text_of[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text_of[r.doc_id].encode()) for r in got)


def test_sharding_keeps_small_groups_together(spark):
    texts = [(i, f"text {i // 2} " * 9, None, None) for i in range(6000)]
    got = sharding.shard(corner_docs(spark, texts)).collect()
    where = collections.defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_sharding_takes_corner_rows(spark):
    got = sharding.shard(corner_docs(spark)).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len((t or "").encode()) + 1) for i, t, *_ in TEXTS)
    assert sharding.shard(empty_docs(spark)).collect() == []


def test_greedy_takes_the_shard_with_most_room():
    units = np.array([[10, 10, 1], [6, 6, 1], [5, 5, 1], [1, 1, 1]], float)
    placed = sharding.greedy(units, 2)
    assert placed[0] != placed[1] and placed[1] == placed[2] and placed[3] == placed[0]


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_greedy_equals_brute_force(shards):
    """Each unit goes where the plain dot product of its shares with what is left of a shard is highest, the first of equals."""
    rng = np.random.default_rng(shards)
    units = np.stack([rng.integers(1, 500, 300), rng.integers(1, 90, 300), rng.integers(1, 4, 300)], axis=1).astype(float)
    total = [sum(u[j] for u in units) for j in range(3)]
    left, want = [[1 / shards] * 3 for _ in range(shards)], []
    for unit in units:
        part = [x / t for x, t in zip(unit, total)]
        fit = [sum(room[j] * (part[j] * w) for j, w in enumerate(sharding.WEIGHTS)) for room in left]
        best = max(range(shards), key=lambda s: (round(fit[s], 15), -s))
        want.append(best)
        for j in range(3):
            left[best][j] -= part[j]
    got = sharding.greedy(units, shards).tolist()
    sizes = np.bincount(got, weights=units[:, 0], minlength=shards)
    assert sum(g != w for g, w in zip(got, want)) == 0 and sizes.max() - sizes.min() <= units[:, 0].max()


THUE_MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
UNLIKE = [THUE_MORSE + " x", THUE_MORSE.translate(str.maketrans("ab", "ba")) + " x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("collide", [False, True])
def test_words_are_told_apart_by_their_bytes(monkeypatch, name, collide):
    """Two words that cancel out in any polynomial hash, and words that all share one hash."""
    if collide:
        true = bpe.span_hashes
        monkeypatch.setattr(bpe, "span_hashes", lambda d, a, b: np.where(b - a > 8, np.uint64(7), true(d, a, b)))
    texts = [*UNLIKE, "a longer wordlike thing and anotherlongone", "anotherlongone again, anotherlongtwo", *UNLIKE[::-1]]
    path = bpe_codec.vocabulary_path(name)
    true_ids = Tokenizer.from_file(path)
    encoder = bpe.Encoder(path)
    for _ in range(2):  # the second time all words are known
        ids, offs = encoder.encode(texts)
        for i, text in enumerate(texts):
            assert ids[offs[i] : offs[i + 1]].tolist() == true_ids.encode(text, add_special_tokens=False).ids


def test_cancelling_words_are_different_everywhere(spark):
    one, two = (set(minhash.shingle_sets(pa.array([t]), 2)[0].tolist()) for t in UNLIKE)
    assert not one & two
    docs = spark.createDataFrame(list(enumerate(UNLIKE)), "doc_id long, text string")
    assert all(r.kept for r in minhash.near_duplicates(docs, k=2).collect())
    got = quality_rules.measure(pa.array(["\n".join(UNLIKE)]))
    assert got["n_dup_lines"][0].as_py() == 0 and len(got["keys"][0]) == 2
