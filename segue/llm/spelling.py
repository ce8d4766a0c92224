"""Grouping of spelling variants by PartEnum signatures.

Two words that differ by one code point have letter multisets that differ in at most two places: a multiset is a set
of (letter, how many of it came before), and a code point put in or left out changes one element, a replaced one
two.  The elements are dealt to `PARTS` parts by a hash.  At most two parts differ between near words, so for each choice of
two parts to leave out a word has one signature of all the others, and near words share at least one: an exact
equi-join.  A word of L code points meets those of L and of L + 1 only.  The edit distance is verified inside the join, so what
comes out are near words, not candidates; signatures of many words are cut into pieces.

Words are counted per batch before the shuffle, and everything after works on the distinct words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from segue.llm.arrays import LOWER, Spans, bounded_batches, frugal, span_hashes, text_bytes
from segue.operators.skew import copy_to_pieces, cut, heavy_keys
from segue.session import configure, materialize

MIN_LENGTH, MIN_COUNT, LEAD = 6, 5, 5
PARTS, MOST_APART = 6, 2
SLIP = 199  # the contract's: every so-manieth word by its hash loses a code point

_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[1] = True


def letter_runs(data: np.ndarray, offs: np.ndarray) -> Spans:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, which are C3 80 to C3 BF in UTF-8."""
    small = data | 0x20
    letter = (small >= ord("a")) & (small <= ord("z")) & (data < 0x80)
    lead = data == 0xC3
    letter |= lead
    letter[1:] |= lead[:-1]
    return Spans((~letter).astype(np.uint8), offs, _OUTSIDE)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_behind(start: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, carried on from the crc32 `start` of what stands before it."""
    crc, sizes = ~start, ends - starts
    which = np.flatnonzero(sizes <= 64)
    for j in range(64):
        which = which[sizes[which] > j]
        if not len(which):
            break
        crc[which] = _CRC[(crc[which] ^ data[starts[which] + j]) & 0xFF] ^ (crc[which] >> 8)
    out = ~crc
    for i in np.flatnonzero(sizes > 64).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(start[i]))
    return out


def _without_one(word: bytes, h: int) -> str:
    text = word.decode()
    at = h % len(text)
    return text[:at] + text[at + 1 :]


def _count(min_length: int, slip: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = text_bytes(batch.column("text"))
            runs = letter_runs(data, offs)
            data = LOWER[data]
            changed: list[str] = []
            stays = np.ones(len(runs), bool)
            if slip:
                ids = [f"{'' if i is None else i}:".encode() for i in batch.column("id").to_pylist()]
                before = np.array([zlib.crc32(x) for x in ids], np.uint32)
                crc = crc_behind(before[runs.text_of], data, runs.starts, runs.ends)
                hit = np.flatnonzero(crc % slip == 0)
                stays[hit] = False
                words = (data[a:b].tobytes() for a, b in zip(runs.starts[hit].tolist(), runs.ends[hit].tolist()))
                changed = [_without_one(w, h) for w, h in zip(words, crc[hit].tolist())]
            heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            keep = np.flatnonzero(stays & (heads[runs.ends] - heads[runs.starts] >= min_length))
            starts, ends = runs.starts[keep], runs.ends[keep]
            # Two unlike hashes name a word.
            names = np.stack([span_hashes(data, starts, ends, f) for f in (0, 1)], axis=1)
            order = np.lexsort((names[:, 1], names[:, 0]))
            first = np.ones(len(order), bool)
            first[1:] = (names[order[1:]] != names[order[:-1]]).any(axis=1)
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(order)))
            one = order[at]
            words = [data[a:b].tobytes().decode() for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            changed = [w for w in changed if len(w) >= min_length]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words + changed, pa.string()), pa.array(np.concatenate([count, np.ones(len(changed), np.int64)]))],
                names=["word", "n"],
            )

    return run


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    slip: int | None = None,
) -> DataFrame:
    """(word, n) of every word of at least `min_length` code points and `min_count` occurrences in whole texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased.  With `slip`, a run loses the code point h mod
    length where `slip` divides h, the crc32 of '<id>:<run>' (a null id is empty).  Null texts have no words."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = source.mapInArrow(frugal(_count(min_length, slip)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def signatures(word: Column, parts: int = PARTS, apart: int = MOST_APART) -> Column:
    """For each choice of `apart` parts to leave out, the hash of the letters dealt to the others."""
    letters = F.array_sort(F.split(word, ""))
    numbered = F.transform(letters, lambda c, i: F.concat(c, (i + 1 - F.array_position(letters, c)).cast("string")))

    def part(p: int) -> Column:
        return F.array_join(F.filter(numbered, lambda e: F.pmod(F.xxhash64(e), F.lit(parts)) == p), "")

    held = [part(p) for p in range(parts)]
    return F.transform(F.array(F.array(*held)), lambda h: F.array(*[
        F.xxhash64(F.lit(i), *[h[p] for p in range(parts) if p not in out]) for i, out in enumerate(combinations(range(parts), apart))
    ]))[0]


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), once for every two of the distinct `words` (word, n) with edit distance one."""
    signed = materialize(words.select("word", "n", F.length("word").alias("size"), signatures(F.col("word")).alias("sigs")), "signatures")
    each = signed.select("word", "n", "size", F.explode("sigs").alias("sig"))
    own = each.select(F.xxhash64("sig", "size").alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = each.select(
        F.explode(F.array(F.struct(F.xxhash64("sig", "size").alias("key"), F.lit(False).alias("longer")),
                          F.struct(F.xxhash64("sig", F.col("size") - 1).alias("key"), F.lit(True).alias("longer")))).alias("k"),
        F.col("word").alias("b"), F.col("n").alias("n_b"),
    ).select("k.*", "b", "n_b")
    heavy = heavy_keys(own, "key")
    left, right = cut(own, "key", heavy, "a"), copy_to_pieces(other, "key", heavy)
    near = left.join(
        right, (left["key"] == right["key"]) & (left["piece"] == right["piece"]) & (F.col("longer") | (F.col("a") < F.col("b")))
        & (F.levenshtein("a", "b", 1) == 1)
    )
    return near.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def group_variants(words: DataFrame, lead: int = LEAD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of `words` (word, n), which are distinct.

    Two words are near if they differ by exactly one code point put in, left out or replaced.  form: the near word of largest
    n, of equals the smallest by code point, if its n is at least `lead` times the word's, else null.  root: the last word that
    forms lead to, the word itself without a form.  `lead` is over one, so forms never go in a circle.  An empty
    table gives an empty result; words of any length are compared whole; other columns are not read."""
    words = materialize(words.select("word", "n"), "vocabulary")
    near = materialize(near_words(words), "near-words")
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    good = -F.col("best.m") >= lead * F.col("n")
    formed = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.other")).alias("form"),
        F.when(good, -F.col("best.m")).alias("form_n"),
    ), "forms")
    roots = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round halves the way to the last form; n grows by `lead` at each step, so there are few
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(
            roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"
        )
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return formed.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return group_variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), slip=SLIP))


# crc32 by its rule: a table entry is eight shifts, a text one table step a byte.  The edit distance there counts bytes, so
# the 64 letters beyond ASCII stand for one byte each while it is taken.
SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS t),
r AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
b AS (SELECT id, w, n, list_transform(regexp_extract_all(hex(encode(id || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM r),
h AS (SELECT w, n, xor(4294967295, list_reduce(bytes, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) AS h FROM b, crc),
o AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n, length(word) AS size, translate(word,
      array_to_string(list_transform(range(192, 256), lambda c: chr(c::INT)), ''), array_to_string(list_transform(range(33, 97), lambda c: chr(c::INT)), '')) AS short
      FROM o GROUP BY word HAVING sum(n) >= {MIN_COUNT} AND length(word) >= {MIN_LENGTH}),
p AS MATERIALIZED (SELECT x.word, y.word AS other, y.n AS m FROM v AS x JOIN v AS y
      ON y.size BETWEEN x.size - 1 AND x.size + 1 AND x.word <> y.word AND levenshtein(x.short, y.short) = 1),
f AS MATERIALIZED (SELECT word, any_value(v.n) AS n, count(other) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM v LEFT JOIN p USING (word) GROUP BY word),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN form_n >= {LEAD} * n THEN form END AS form, CASE WHEN form_n >= {LEAD} * n THEN form_n END AS form_n FROM f),
c(word, root) AS (SELECT word, word FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n FROM g JOIN c ON c.word = g.word JOIN g AS last ON last.word = c.root AND last.form IS NULL"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": SQL}
