"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column.

A batch is one byte array and the offsets of its texts.  Everything here is linear in the bytes and
keeps no Python object per word, so the memory of a task follows `BATCH_BYTES`, not the table.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

# Bytes of text that one Arrow batch carries to a Python worker (a longer text is a batch of its own).
BATCH_BYTES = 2 << 20
BATCH_ROWS = 1_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
# Two unlike hashes of a word: an odd factor and a start each.
_FAMILIES = ((0x2545F4914F6CDD1D, 0x1B873593CC9E2D51), (0xD1342543DE82EF95, 0x85EBCA6B27D4EB2F))
LANES = 8  # words of up to 8 lanes of 8 bytes are hashed lane by lane, longer ones by a digest
_LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

# Code points that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives its memory back when it ends: Python workers live on beside the next stage."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get by bytes, so that long texts do not pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Runs of bytes outside `breaks`, none across two texts; text i holds the runs first[i]:first[i+1]."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACES):
        inside = ~breaks[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        before = np.empty(len(data), bool)
        before[:1] = True
        np.logical_or(~inside[:-1], edge[1:-1], out=before[1:])
        after = np.empty(len(data), bool)
        after[-1:] = True
        np.logical_or(~inside[1:], edge[1:-1], out=after[:-1])
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of each run of bytes, the same wherever the run stands.

    Runs of up to 8 bytes and one size never collide; every further lane goes through the mixer before the next
    is taken in, so no arrangement of letters cancels out.  Long runs take a BLAKE2 digest.  `family` 0 and 1 are unlike
    hashes: what is equal in both is taken as equal where the bytes themselves are out of reach."""
    factor, start = (np.uint64(x) for x in _FAMILIES[family])
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    sizes = ends - starts
    out = sizes.astype(np.uint64) * _STEP + start
    which = np.flatnonzero(sizes <= 8 * LANES)
    for j in range(LANES):
        which = which[sizes[which] > 8 * j]
        if not len(which):
            break
        lane = lanes[starts[which] + 8 * j] & _LANE_MASKS[np.minimum(sizes[which] - 8 * j, 8)]
        out[which] = mix((out[which] ^ lane) * factor)
    for i in np.flatnonzero(sizes > 8 * LANES).tolist():
        held = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, person=b"%d" % family)
        out[i] = int.from_bytes(held.digest(), "little")
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k words in a row, offsets by text); a text of fewer words has one over all its words."""
    n = len(hashes)
    sizes = np.diff(first)
    grams = hashes.copy()
    for j in range(1, k):
        grams[: n - j] = mix(grams[: n - j] * _STEP + hashes[j:])
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    # A short text's gram must not reach into the next text: hash its words alone.
    for i in np.flatnonzero((sizes > 0) & (sizes < k)):
        own = hashes[first[i] : first[i] + 1].copy()
        for j in range(first[i] + 1, first[i + 1]):
            own = mix(own * _STEP + hashes[j : j + 1])
        grams[first[i]] = mix(own + np.uint64(sizes[i]))[0]
    offs = np.concatenate([[0], np.cumsum(counts)])
    take = np.repeat(first[:-1] - offs[:-1], counts) + np.arange(offs[-1])
    return grams[take], offs


def distinct_per_text(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    values = values.copy()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offs[:-1][offs[:-1] < len(values)]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[offs]
