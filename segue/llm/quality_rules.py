"""Quality rules: measures of each text, and lines that many documents of one host repeat.

The measures and the hashes of the normalised lines are taken in one pass over the text, on byte arrays.
The documents that hold a line are counted per host; a document whose words mostly stand in lines above
the limits is depleted and rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from segue.llm.arrays import LOWER, SPACES, Spans, bounded_batches, frugal, mix, shingles, span_hashes, text_bytes
from segue.llm.lines import lines_over
from segue.session import materialize

MAX_SHARE = 0.05
MIN_DOCS = 5
MAX_DOCS = 200  # over it a line goes whatever its share; it acts on hosts of over MAX_DOCS / MAX_SHARE documents
MIN_LEFT = 0.3
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 5

MEASURES = (
    "r long, id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "keys array<long>, sizes array<long>"
)


def _sum_by(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[i]:cuts[i + 1]]."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[cuts])


def repeated_words(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that stand in a run of `window` words found twice or more in the text."""
    sizes = np.diff(first)
    n = len(hashes)
    if n < window:
        return np.zeros(len(sizes), np.int64)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(text_of[: n - window + 1] == text_of[window - 1 :])
    # Whole windows of long enough texts, in order; a text with fewer words has none.
    grams, offs = shingles(hashes, first, window)
    keep = np.repeat(sizes >= window, np.diff(offs))
    keys = mix(grams[keep] + text_of[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(sizes), np.int64)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = whole[twice[at] == keys]
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return _sum_by(np.cumsum(cover[:-1]) > 0, first)


def normal_keys(data: np.ndarray, words: Spans, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of lines of the words a to b - 1: the words in lower case with one blank between."""
    space = SPACES[data]
    stays = ~space
    stays[1:] |= ~space[:-1]
    place = np.concatenate([[0], np.cumsum(stays)])
    squeezed = np.where(space, np.uint8(32), LOWER[data])[stays]
    return span_hashes(squeezed, place[words.starts[a]], place[words.ends[b - 1]])


def line_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of every line, 0 for a blank one, offsets by text); a text has one line more than line ends."""
    ends = np.flatnonzero(data == 10)
    owner = np.searchsorted(offs, ends, "right") - 1
    first = np.arange(len(offs) - 1) + np.searchsorted(ends, offs[:-1])
    cuts = np.append(first, len(ends) + len(offs) - 1)
    starts = np.zeros(cuts[-1], np.int64)
    starts[first] = offs[:-1]
    starts[np.arange(len(ends)) + owner + 1] = ends + 1
    stops = np.zeros(cuts[-1], np.int64)
    stops[cuts[1:] - 1] = offs[1:]
    stops[np.arange(len(ends)) + owner] = ends
    words = Spans(data, offs)
    a, b = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, stops)
    keys = np.zeros(len(starts), np.uint64)
    full = b > a
    keys[full] = normal_keys(data, words, a[full], b[full])
    return keys, cuts


def measure(column: pa.Array) -> dict[str, pa.Array]:
    """The measures of each text of a string column, and the hash and word characters of its distinct lines."""
    data, offs = text_bytes(column)
    words = Spans(data, offs)
    # Code points: bytes that do not continue a UTF-8 sequence.
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = heads[words.ends] - heads[words.starts]
    n_texts = len(offs) - 1

    lines = Spans(data, offs, _LINE_END)
    word_from, word_to = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    full = word_to > word_from
    text_of_line = lines.text_of[full]
    salt = text_of_line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    raw = mix(span_hashes(data, lines.starts[full], lines.ends[full]) + salt)
    n_lines = np.bincount(text_of_line, minlength=n_texts)
    _, at = np.unique(raw, return_index=True)
    n_distinct = np.bincount(text_of_line[at], minlength=n_texts)

    a, b = word_from[full], word_to[full]
    key = normal_keys(data, words, a, b)
    char_sums = np.concatenate([[0], np.cumsum(chars)])
    own, first_at, which = np.unique(mix(key + salt), return_index=True, return_inverse=True)
    size = np.bincount(which, weights=(char_sums[b] - char_sums[a]), minlength=len(own)).astype(np.int64)
    order = np.argsort(first_at, kind="stable")  # texts in order again
    first_at, size = first_at[order], size[order]
    cuts = np.searchsorted(text_of_line[first_at], np.arange(n_texts + 1)).astype(np.int32)

    hashes = span_hashes(data, words.starts, words.ends)
    longs = lambda x: pa.array(np.asarray(x, np.int64))
    return {
        "n_words": longs(words.per_text), "word_chars": longs(_sum_by(chars, words.first)),
        "n_symbols": longs(_sum_by(_SYMBOL[data], offs)), "n_dup_lines": longs(n_lines - n_distinct),
        "n_repeat_words": longs(repeated_words(hashes, words.first)),
        "keys": pa.ListArray.from_arrays(pa.array(cuts), longs(key[first_at].view(np.int64))),
        "sizes": pa.ListArray.from_arrays(pa.array(cuts), longs(size)),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("r", "id", "host")), *found.values()], names=["r", "id", "host", *found]
            )


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose key is among `over`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_bytes(batch.column("text"))
        keys, cuts = line_keys(data, offs)
        out = []
        for i, (text, over) in enumerate(zip(batch.column("text").to_pylist(), batch.column("over").to_pylist())):
            if over and text is not None:
                gone = np.isin(keys[cuts[i] : cuts[i + 1]], np.array(over, np.int64).view(np.uint64))
                text = "\n".join(line for line, drop in zip(text.split("\n"), gone.tolist()) if not drop)
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("r"), pa.array(out, pa.string())], names=["r", "text"])


def apply_rules(
    docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT, max_docs: int | None = MAX_DOCS,
    with_text: bool = False,
) -> DataFrame:
    """One row per row of `docs`: its measures, base_failed, left_chars and kept; with `with_text` also the text without the
    lines over the limits.

    A line is its words in lower case.  It is over the limits when over `max_share` of the host's documents
    hold it, and `min_docs` of them at least, or when over `max_docs` of them hold it.  left_chars: word characters outside such lines; a document is
    depleted when they are less than `min_left` of its word characters.  base_failed: fewer than `min_words`
    words, or over `max_repeated_percent` of them in repeated runs of five.  Null and empty texts have no
    words and fail the base rules; a null host shares lines with nothing; repeated rows count as documents
    and each get a row.  Very long texts are measured whole; an empty table gives an empty result.  Other columns are
    not read.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(
        F.monotonically_increasing_id().alias("r"), F.col(id_col).cast("long").alias("id"), host.cast("string").alias("host"),
        F.col(text_col).alias("text"),
    )
    if with_text:  # row numbers and texts must stay together
        source = materialize(source, "quality-texts")
    rows = materialize(source.mapInArrow(frugal(_measured), MEASURES), "quality-rules")
    # Written, so that the join with the lines of the documents knows its size.
    over = materialize(lines_over(rows.select("host", "keys"), max_share, min_docs, max_docs), "lines-over")
    held = rows.select("r", "host", F.explode(F.arrays_zip("keys", "sizes")).alias("l")).select("r", "host", F.col("l.keys").alias("line"), "l.sizes")
    gone = held.join(over, ["host", "line"]).groupBy("r").agg(F.sum("sizes").alias("gone"), F.collect_list("line").alias("over"))
    gone = gone if with_text else gone.drop("over")
    joined = rows.drop("host", "keys", "sizes").join(gone, "r", "left")
    left = F.col("word_chars") - F.coalesce("gone", F.lit(0).cast("long"))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))
    if with_text:
        lines = gone.select("r", "over")
        texts = source.select("r", "text").join(lines, "r", "left").mapInArrow(frugal(_stripped), "r long, text string")
        joined = joined.join(texts.withColumnRenamed("text", "_text"), "r")
    return joined.select(
        F.col("id").alias(id_col), *([F.col("_text").alias(text_col)] if with_text else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), left.alias("left_chars"),
        (~base_failed & (left >= min_left * F.col("word_chars"))).alias("kept"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("source"))


WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
      regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT r, host, line, regexp_extract_all(line, '{WORD}') AS w FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d)),
full_l AS (SELECT r, host, line, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
      length(array_to_string(w, '')) AS chars FROM l WHERE len(w) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_l GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win
      JOIN (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1) USING (r, g)) GROUP BY r),
t AS (SELECT host, count(*) AS total FROM d WHERE host IS NOT NULL GROUP BY host),
f AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT r) AS n FROM full_l GROUP BY ALL) JOIN t USING (host)
      WHERE n >= {MIN_DOCS} AND n > {MAX_SHARE} * total OR n > {MAX_DOCS}),
gone AS (SELECT r, sum(chars) AS gone FROM full_l JOIN f USING (host, norm) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0)::BIGINT AS gone
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, word_chars - gone AS left_chars,
       NOT base_failed AND word_chars - gone >= {MIN_LEFT} * word_chars AS kept FROM b"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": SQL}
