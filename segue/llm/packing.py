"""Packing of token sequences into fixed windows, online and with bounded space.

Each partition keeps a fixed number of open windows.  What is left of a document after its full windows
goes, whole, into the open window it fits best; when none fits, the fullest is filled up with the head of the
document and emitted.  The windows still open at the end of a partition are merged in groups of partitions,
again and again, until one is left; its last tokens are cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from segue.llm.arrays import bounded_batches, frugal
from segue.llm.bpe import Encoder
from segue.llm.bpe_codec import vocabulary_path
from segue.session import materialize

SIZE = 4096
OPEN_WINDOWS = 32
END_ID = 2
PARTITIONS_PER_GROUP = 32

# slot and window are set for pieces of windows that are still open; only those carry their ids, unless asked.
PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "slot long, window int, ids binary"
)
NAMES = [c.split()[0] for c in PIECE.split(", ")]


class Windows:
    """The open windows of one partition.  A window is its pieces (doc, start, doc_tokens, ids) and its fill."""

    def __init__(self, size: int, number: int):
        self.size = size
        self.pieces: list[list] = [[] for _ in range(number)]
        self.free = np.full(number, size, np.int64)

    def put(self, at: int, piece: tuple) -> list | None:
        """Add a piece; the pieces of the window when that fills it."""
        self.pieces[at].append(piece)
        self.free[at] -= len(piece[3])
        if self.free[at]:
            return None
        full, self.pieces[at] = self.pieces[at], []
        self.free[at] = self.size
        return full

    def place(self, doc, tokens: np.ndarray) -> Iterator[list]:
        """Place a document; the windows it completes."""
        start, total = 0, len(tokens)
        while total - start >= self.size:
            yield [(doc, start, total, tokens[start : start + self.size])]
            start += self.size
        while start < total:
            fits = np.where(self.free >= total - start, self.free, self.size + 1)
            best = int(fits.argmin())
            if fits[best] > self.size:
                best = int(self.free.argmin())  # none fits: fill up the fullest
            take = min(total - start, int(self.free[best]))
            full = self.put(best, (doc, start, total, tokens[start : start + take]))
            start += take
            if full:
                yield full


def _rows(window: list, sequence: int | None, slot: int | None, number: int | None, keep_ids: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, total, ids in window:
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        held = raw if keep_ids or sequence is None else None
        out.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, slot, number, held))
        offset += len(ids)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 8, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=NAMES)


def _pack(path: str, size: int, number: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, windows, done = None, Windows(size, number), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or Encoder(path)
            ids, bounds = encoder.encode(batch.column("text").to_pylist())
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                for full in windows.place(doc, np.append(ids[a:b], np.int32(end_id))):
                    rows += _rows(full, part << 32 | done, None, None, keep_ids)
                    done += 1
            if rows:
                yield _batch(rows)
        left = [r for i, w in enumerate(windows.pieces) if w for r in _rows(w, None, part, i, True)]
        if left:
            yield _batch(left)

    return run


def _merge(size: int, level: int, last: bool, keep_ids: bool):
    """Merge the open windows of a group of slots into full ones; what stays open is one window."""

    def run(key, frame):
        import pandas as pd  # here, as the other tasks do without it

        group = int(key[0])
        frame = frame.sort_values(["slot", "window", "offset"])
        windows, done, rows = Windows(size, 1), 0, []

        def emit(pieces: list) -> None:
            nonlocal done
            rows.extend(_rows(pieces, level << 56 | group << 32 | done, None, None, keep_ids))
            done += 1

        for doc, start, total, raw in zip(frame["doc_id"], frame["start"], frame["doc_tokens"], frame["ids"]):
            ids, at = np.frombuffer(raw, "<u4"), 0
            doc = None if pd.isna(doc) else int(doc)
            while at < len(ids):
                take = min(len(ids) - at, int(windows.free[0]))
                full = windows.put(0, (doc, int(start) + at, int(total), ids[at : at + take]))
                at += take
                if full:
                    emit(full)
        rest = windows.pieces[0]
        if rest and last:
            # The bits of the number of tokens left: sequences of a power of two each.
            left = sum(len(p[3]) for p in rest)
            for bit in reversed(range(left.bit_length())):
                if left >> bit & 1:
                    need, mine = 1 << bit, []
                    while need:
                        doc, start, total, ids = rest.pop(0)
                        mine.append((doc, start, total, ids[:need]))
                        if len(ids) > need:
                            rest.insert(0, (doc, start + need, total, ids[need:]))
                        need -= len(mine[-1][3])
                    emit(mine)
        elif rest:
            rows.extend(_rows(rest, None, group, 0, True))
        found = pd.DataFrame(rows, columns=NAMES, dtype=object)  # else a column with a null turns to floats
        return found.astype({c: "Int64" for c in NAMES[:8]} | {"window": "Int32"})

    return run


def pack(
    docs: DataFrame, path: str, size: int = SIZE, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True,
) -> DataFrame:
    """Pieces of the documents' tokens: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    Every row of `docs` is one document: the ids of its whole text and `end_id`.  A null or empty text is the
    end id alone; rows that repeat an id are packed each by itself.  Every id lies in one piece; sequences have
    `size` ids, but for the last few, which have a power of two.  `size` must be a power of two.  ids are
    little-endian 32-bit numbers, null without `keep_ids`.  No rows give no pieces.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Sequence ids hold the partition's number, so the placing is done once and written.
    placed = materialize(source.mapInArrow(frugal(_pack(path, size, open_windows, end_id, keep_ids)), PIECE), "packed")
    out = placed.filter("sequence_id IS NOT NULL")
    left = placed.filter("sequence_id IS NULL")
    slots, level = (left.agg(F.max("slot")).first()[0] or 0) + 1, 0
    while True:
        slots, level = -(-slots // PARTITIONS_PER_GROUP), level + 1
        group = F.floor(F.col("slot") / PARTITIONS_PER_GROUP).alias("group")
        merged = materialize(
            left.groupBy(group).applyInPandas(_merge(size, level, slots == 1, keep_ids), PIECE), f"merged-{level}"
        )
        out = out.unionByName(merged.filter("sequence_id IS NOT NULL"))
        if slots == 1:
            break
        left = merged.filter("sequence_id IS NULL")
    return out.drop("slot", "window").withColumnRenamed("doc_id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, vocabulary_path("word_bpe_49k.json"), keep_ids=False).drop("ids")


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict = {}
