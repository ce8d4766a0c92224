"""Numbers by track as short byte strings.

Pairs of seeds and tracks are many and small: a track's place among sorted ones, a count, a size.  A pack holds the tracks of one
list or seed in rising order as differences, and its numbers, each column in as few bytes as it needs; a column of one value is
stored once, and long packs are compressed.  Packs travel through shuffles whole and are opened where they are summed,
a batch of sorted rows at a time: a task holds one batch and the rows of one key.

Tracks are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

KINDS = ["u1", "u2", "u4", "u8", "i8", "f8"]
CONSTANT, LONG_PACK = 8, 512
PAIRS_AT_ONCE = 1_000_000  # so many elements of packs are open at once, or those of one key
ZSTD = pa.Codec("zstd", 1)


def _column(values: np.ndarray) -> bytes:
    """The kind of the numbers and the numbers."""
    if values.dtype.kind == "f":
        kind = 5
    elif values.dtype.kind == "i" and values.min() < 0:
        kind = 4
    else:
        top = int(values.max())
        kind = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
    same = (values[0] == values).all()
    return bytes([kind + CONSTANT * bool(same)]) + (values[:1] if same else values).astype("<" + KINDS[kind]).tobytes()


def encode(tracks: np.ndarray, *values: np.ndarray) -> bytes:
    """A pack of rising `tracks` and their numbers."""
    if not len(tracks):
        return b""
    place = np.ascontiguousarray(tracks, np.int64).view(np.uint64)
    steps = place[1:] - place[:-1]
    body = place[:1].tobytes() + (_column(steps) if len(steps) else b"") + b"".join(_column(v) for v in values)
    n = len(tracks).to_bytes(4, "little")
    if len(body) < LONG_PACK:
        return b"\0" + n + body
    return b"\1" + n + len(body).to_bytes(4, "little") + ZSTD.compress(body, asbytes=True)


def size_of(pack: bytes | None) -> int:
    return int.from_bytes(pack[1:5], "little") if pack else 0


def decode(pack: bytes | None, columns: int) -> list[np.ndarray]:
    """The tracks and the columns of numbers of a pack."""
    if not pack:
        return [np.zeros(0, np.int64) for _ in range(columns + 1)]
    body = pack[5:] if pack[0] == 0 else ZSTD.decompress(pack[9:], int.from_bytes(pack[5:9], "little"), asbytes=True)
    n, at = size_of(pack), 8
    out = []
    for size in ([n - 1] if n > 1 else []) + [n] * columns:
        kind, same = KINDS[body[at] % CONSTANT], body[at] >= CONSTANT
        values = np.frombuffer(body, "<" + kind, 1 if same else size, at + 1)
        at += 1 + values.nbytes
        out.append(np.repeat(values, size) if same else values)
    place = np.empty(n, np.uint64)
    place[0] = int.from_bytes(body[:8], "little")
    if n > 1:
        place[1:] = out.pop(0)
        np.cumsum(place, out=place)
    return [place.view(np.int64), *[v if v.dtype.kind == "f" else v.astype(np.int64) for v in out]]


def part_of(tracks: np.ndarray, parts: int) -> np.ndarray:
    """The part that each track belongs to."""
    mixed = tracks.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def heads_of(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First rows of the groups of equal neighbouring keys."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        column = table.column(key)
        a, b = column.slice(1), column.slice(0, max(n - 1, 0))
        differs, one = pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b))
        new[1:] |= np.asarray(pc.if_else(pc.is_null(differs), one, differs))
    return np.flatnonzero(new)


def spans(rows: pa.Table | pa.RecordBatch, heads: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring groups that are opened together: the number of the first and of the one behind the last."""
    if "pack" not in rows.schema.names:
        if len(heads):
            yield 0, len(heads)
        return
    before = np.cumsum([0, *map(size_of, rows.column("pack").to_pylist())])
    ends, low = before[np.append(heads[1:], rows.num_rows)] if len(heads) else before[:0], 0
    while low < len(heads):
        high = max(low + 1, int(np.searchsorted(ends, before[heads[low]] + PAIRS_AT_ONCE, "right")))
        yield low, high
        low = high


Step = Callable[[pa.Table, np.ndarray], pa.RecordBatch | pa.Table | None]


def by_group(keys: list[str], step: Step):
    """A map over sorted batches: `step` gets rows and the first row of each of their groups, no group in two calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            heads = heads_of(rows, keys)
            for low, high in spans(rows, heads):
                first = heads[low]
                part = rows.slice(first, (heads[high] if high < len(heads) else rows.num_rows) - first)
                out = step(part, heads[low:high] - first)
                if out is not None:
                    yield from [out] if isinstance(out, pa.RecordBatch) else out.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(heads_of(batch, keys)[-1])
            joined = held and len(heads_of(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) == 1
            if last == 0 and joined:
                held.append(batch)  # all of it belongs to the group that is held
                continue
            yield from done(pa.Table.from_batches([*held, batch.slice(0, last)], batch.schema).combine_chunks())
            held = [batch.slice(last)]
        if held:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    return run


def opened(packs, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each element, tracks and numbers of all packs one after another)."""
    found = [decode(p, columns) for p in packs.to_pylist()]
    if not found:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64)] * (columns + 1)
    row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    return row, [np.concatenate([f[i] for f in found]) for i in range(columns + 1)]


def order_by(group: np.ndarray, tracks: np.ndarray) -> np.ndarray:
    """The order by group and track; equal ones keep theirs."""
    if not len(tracks):
        return np.zeros(0, np.int64)
    low, high = int(tracks.min()), int(tracks.max())
    width = high - low + 1
    if width * (int(group.max()) + 1) < 1 << 62:
        return np.argsort(group * width + (tracks - low), kind="stable")
    return np.lexsort((tracks, group))


def changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """Places where one of the columns takes another value, the first included."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def groups_of(heads: np.ndarray, rows: int) -> np.ndarray:
    """The number of the group of each row."""
    return np.repeat(np.arange(len(heads)), np.diff(np.append(heads, rows)))


def pack_rows(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, size, pack): the rows (by, track, values) of each key as a pack."""
    rows = rows.select(*by, F.col("track").cast("long"), *values).filter("track IS NOT NULL")
    fields = [f for f in rows.schema.fields if f.name in by]

    def step(table: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        numbers = [table.column(c).to_numpy() for c in ("track", *values)]
        ends = np.append(heads, table.num_rows)
        made = [encode(*[c[low:high] for c in numbers]) for low, high in zip(ends, ends[1:])]
        own = [table.column(c).combine_chunks().take(pa.array(heads)) for c in by]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends)), pa.array(made, pa.binary())], [*by, "size", "pack"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "size long", "pack binary"])
    return rows.repartition(*by).sortWithinPartitions(*by, "track").mapInArrow(by_group(by, step), schema)


def unpacked(df: DataFrame, columns: int, made: str, make: Callable[..., list], drop: tuple[str, ...] = ()) -> DataFrame:
    """A row for each element of the packs of `df`: its other columns but `drop`, and the columns `made`, which `make` gives from the
    opened rows, the row of each element, its tracks and its numbers."""
    kept = [f for f in df.schema.fields if f.name not in ("pack", *drop)]
    names = [c.split()[0] for c in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in spans(batch, np.arange(batch.num_rows)):
                rows = batch.slice(low, high - low)
                row, numbers = opened(rows.column("pack"), columns)
                own = [rows.column(f.name).take(pa.array(row)) for f in kept]
                new = [c if isinstance(c, pa.Array) else pa.array(c) for c in make(rows, row, *numbers)]
                yield pa.RecordBatch.from_arrays([*own, *new], [*[f.name for f in kept], *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [made])
    return df.mapInArrow(run, schema)


def deal_packs(df: DataFrame, by: list[str], columns: int, tasks: int, most_parts: int, then: tuple[str, ...] = ()) -> DataFrame:
    """The packs of `df` (by, parts, ..., pack) and a number `part`, all rows of one key and part in one of `tasks` partitions, sorted by both and by `then`.

    Where `parts` is over one, a pack is split by its tracks, see `part_of`; a row comes once for each part, also
    where its pack has nothing for it.  `most_parts`: the greatest number of parts in `df`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", part int"
    place = df.columns.index("pack")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, part, packs = [], [], []
            for i, (pack, parts) in enumerate(zip(batch.column("pack").to_pylist(), batch.column("parts").to_pylist())):
                if parts == 1:
                    own = [pack]
                else:
                    numbers = decode(pack, columns)
                    of = part_of(numbers[0], parts)
                    own = [encode(*[c[of == p] for c in numbers]) for p in range(parts)]
                take += [i] * len(own)
                part += range(len(own))
                packs += own
            out = [c.take(pa.array(take, pa.int64())) for c in batch.columns]
            out[place] = pa.array(packs, pa.binary())
            yield pa.RecordBatch.from_arrays([*out, pa.array(part, pa.int32())], [*batch.schema.names, "part"])

    sent = df.mapInArrow(split, schema) if most_parts > 1 else df.withColumn("part", F.lit(0))
    return sent.repartition(tasks, *by, "part").sortWithinPartitions(*by, "part", *then)
