"""Periodic runs of words by online dyadic square catching.

Words are appended to a stream.  Whenever a block of 2^k words, aligned to its size, is complete, it becomes a catcher of
squares with periods from 2^k to 2^(k+1) - 1.  Each appended word ends one suffix of 2^k words per level, and exactly
one catcher lies at such a distance before it: if the names of the suffix and of the catcher's block are
equal, the block recurs one period later.  Catchers of neighbouring blocks that fire at one period are squares that
merge; when the next block does not fire, the merged stretch is closed, extended to its exact ends word by word,
and reported as a run.  A run of four periods or more always fires two blocks at its smallest period.

Texts are one stream with a word of its own between them, so a batch is advanced in array steps.  A level keeps the
names of the last three blocks' length only; work is linear in the words times the levels, memory linear in the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from segue.llm.arrays import Spans, bounded_batches, frugal, mix, span_hashes, text_bytes

POWERS = 4  # periods that a run holds at least
LEAST = 6  # words that a run holds at least
SLICE = 1 << 17  # words that are advanced together

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.uint64(0x94D049BB133111EB)
_RUN = "struct<start:long,length:long,period:long>"


class _Level:
    """Catchers of blocks of `size` words: the names of the last windows and the stretches that still grow."""

    def __init__(self, size: int):
        self.size = size
        self.base, self.names = 0, np.zeros(0, np.uint64)  # names[i] is that of the window from base + i on
        self.chains = np.zeros((0, 3), np.int64)  # (period, first, last + 1) of equal words one period apart

    def trim(self, before: int) -> None:
        if before > self.base:
            self.names = self.names[before - self.base :].copy()
            self.base = before


class SquareCatcher:
    """Runs of at least `powers` periods and `least` words in a stream of word names.

    `longest`: no run is longer than that many words (a bound on the levels)."""

    def __init__(self, longest: int | None = None, powers: int = POWERS, least: int = LEAST):
        self.powers, self.least, self.longest = powers, least, longest
        self.n = 0
        self.words = np.zeros(1024, np.uint64)
        # Of the runs that cover a word, the end of the one that reaches furthest, and its period.
        self.reach, self.by = np.zeros(1024, np.int64), np.ones(1024, np.int64)
        self.levels = [_Level(1)]
        self.found: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        for i in range(0, len(words), SLICE):
            self._advance(words[i : i + SLICE])

    def runs(self) -> np.ndarray:
        """(start, end, period) of all runs, by start and period; the stream ends here."""
        for level in self.levels:
            self._close(level, self.n, at_end=True)
        out = np.array(self.found, np.int64).reshape(-1, 3)
        out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
        # One stretch has one smallest period; its multiples are the same run.
        new = np.ones(len(out), bool)
        new[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
        out = out[new]
        return out[np.lexsort((out[:, 2], out[:, 0]))]

    def _grow(self, more: int) -> None:
        if self.n + more > len(self.words):
            size = max(2 * len(self.words), self.n + more)
            for name, fill in (("words", 0), ("reach", 0), ("by", 1)):
                old = getattr(self, name)
                new = np.full(size, fill, old.dtype)
                new[: self.n] = old[: self.n]
                setattr(self, name, new)

    def _advance(self, part: np.ndarray) -> None:
        self._grow(len(part))
        old, self.n = self.n, self.n + len(part)
        self.words[old : self.n] = part
        self.levels[0].names = np.concatenate([self.levels[0].names, part])
        most = self.n if self.longest is None else self.longest // self.powers
        while 2 * self.levels[-1].size <= min(self.n, most):
            self.levels.append(_Level(2 * self.levels[-1].size))
        for k, level in enumerate(self.levels):
            if k:
                self._name(level, self.levels[k - 1])
            self._catch(level, old)
            self._close(level, self.n)
        for level in self.levels:
            level.trim(self.n - 3 * level.size)

    def _name(self, level: _Level, below: _Level) -> None:
        """Names of the windows that are complete now, each from its two halves."""
        low, high = level.base + len(level.names), self.n - level.size + 1
        if high > low:
            one = below.names[low - below.base : high - below.base]
            two = below.names[low + below.size - below.base : high + below.size - below.base]
            level.names = np.concatenate([level.names, mix(one * _STEP + mix(two ^ _SEPARATOR))])

    def _catch(self, level: _Level, old: int) -> None:
        """Compare each new suffix with the catcher one to two blocks before it, and merge what fires."""
        size = level.size
        last = np.arange(max(old, 2 * size - 1), self.n)
        suffix = last + 1 - size
        block = (suffix - size) // size * size
        fired = np.flatnonzero(level.names[suffix - level.base] == level.names[block - level.base])
        if not len(fired):
            return
        first = block[fired]
        new = np.stack([suffix[fired] - first, first, first + size], axis=1)
        every = np.concatenate([level.chains, new])
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        apart = np.ones(len(every), bool)
        apart[1:] = (every[1:, 0] != every[:-1, 0]) | (every[1:, 1] != every[:-1, 2])
        heads = np.flatnonzero(apart)
        tails = np.append(heads[1:], len(every)) - 1
        level.chains = np.stack([every[heads, 0], every[heads, 1], every[tails, 2]], axis=1)

    def _close(self, level: _Level, n: int, at_end: bool = False) -> None:
        """Report the stretches whose next block did not fire.

        They are held back for one more block, so that shorter periods are always reported first."""
        period, first, stop = level.chains.T
        over = np.full(len(period), True) if at_end else stop + period + 2 * level.size - 1 < n
        done, level.chains = level.chains[over], level.chains[~over]
        enough = (done[:, 2] - done[:, 1]) + 2 * (level.size - 1) >= (self.powers - 1) * done[:, 0]
        done = done[enough]
        # A stretch inside a run whose period divides its own is that run again.
        known = (self.reach[done[:, 1]] >= done[:, 2] + done[:, 0]) & (done[:, 0] % self.by[done[:, 1]] == 0)
        for q, a, b in done[~known].tolist():
            self._report(q, a, b, level.size)

    def _report(self, q: int, a: int, b: int, size: int) -> None:
        w = self.words
        if not np.array_equal(w[a:b], w[a + q : b + q]):
            return
        low, high = max(0, a - size), min(self.n - q, b + size)
        unlike = np.flatnonzero(w[low:a] != w[low + q : a + q])
        start = low + int(unlike[-1]) + 1 if len(unlike) else low
        unlike = np.flatnonzero(w[b:high] != w[b + q : high + q])
        end = (b + int(unlike[0]) if len(unlike) else high) + q
        if end - start >= max(self.least, self.powers * q):
            self.found.append((start, end, q))
            further = start + np.flatnonzero(self.reach[start:end] < end)
            self.reach[further], self.by[further] = end, q


def runs_of_texts(data: np.ndarray, words: Spans, powers: int = POWERS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """((start, length, period) of every run by text, offsets by text); starts are word numbers of the text."""
    names = span_hashes(data, words.starts, words.ends)
    text_of, n_texts = words.text_of, len(words.per_text)
    stream = np.empty(len(names) + n_texts, np.uint64)
    stream[np.arange(len(names)) + text_of] = names
    stream[words.first[1:] + np.arange(n_texts)] = mix(np.arange(n_texts, dtype=np.uint64) * _STEP + _SEPARATOR)
    catcher = SquareCatcher(int(words.per_text.max(initial=0)), powers, least)
    catcher.append(stream)
    found = catcher.runs()
    heads = words.first[:-1] + np.arange(n_texts)
    owner = np.searchsorted(heads, found[:, 0], "right") - 1
    rows = np.stack([found[:, 0] - heads[owner], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    return rows, np.searchsorted(owner, np.arange(n_texts + 1))


def _joined(data: np.ndarray, words: Spans, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    which = np.flatnonzero(keep)
    starts, ends = words.starts[which], words.ends[which]
    first = np.searchsorted(which, words.first)
    blank = np.ones(len(which), np.int64)
    blank[first[1:][first[1:] > first[:-1]] - 1] = 0  # none behind the last word of a text
    sizes = ends - starts + blank
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])
    out = data[np.minimum(take, max(len(data) - 1, 0))]
    out[bounds[1:][blank > 0] - 1] = 32
    return pa.Array.from_buffers(
        pa.string(), len(first) - 1, [None, pa.py_buffer(bounds[first].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())]
    )


def _collapse(powers: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = text_bytes(batch.column("text"))
            words = Spans(data, offs)
            rows, cuts = runs_of_texts(data, words, powers, least)
            change = np.zeros(len(words) + 1, np.int64)
            head = np.repeat(words.first[:-1], np.diff(cuts)) + rows[:, 0]
            np.add.at(change, head + rows[:, 2], 1)
            np.add.at(change, head + rows[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            runs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words.per_text), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs),
                 _joined(data, words, kept)],
                names=["id", "n_words", "runs", "collapsed"],
            )

    return run


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", powers: int = POWERS, least: int = LEAST
) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row of `docs`; a run is (start, length, period), counted in words.

    Words end at ASCII white space.  A run is a stretch with smallest period q, of `least` words and `powers` * q words at least,
    that no neighbouring word extends; runs are ordered by start, then period.  collapsed: the words that are in no run or in the
    first period of every run that holds them, joined by one blank.  A null text is an empty one: no words, no
    runs, an empty collapsed text.  A very long text is a batch of its own, whole.  Repeated rows and ids are each
    worked on by themselves; an empty table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = f"id long, n_words long, runs array<{_RUN}>, collapsed string"
    return source.mapInArrow(frugal(_collapse(powers, least)), schema).withColumnRenamed("id", id_col)


WORD = r"[^\x20\x09-\x0D]+"


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where 10 divides h = crc32 of the id, the words from a = h div 10 mod n on repeat with period
    1 + (n - a) div (3 + h div 10 mod 8)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        cycles = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
        whole = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(cycles), F.lit(1), n - a))
        return F.when(n > 0, F.array_join(whole, " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    # A one-element array binds the words, so that they are taken once.
    planted = F.transform(F.array(words), repeated)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(plant(spark.read.parquet(f"{sf_dir}/documents.parquet")))

    def before(x: Column, y: Column) -> Column:
        """Greatest length / period first, then smallest start, then period; fractions compared as whole numbers."""
        more = y["length"] * x["period"] - x["length"] * y["period"]
        order = F.when(more != 0, F.signum(more)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
        return order.otherwise(F.signum(x["period"] - y["period"])).cast("int")

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    ranked = found.select("*", best.alias("best"))
    return ranked.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict = {}
