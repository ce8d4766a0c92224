"""Near-duplicate embeddings by lattice hashing.

In each of several tables a vector is projected to eight dimensions at random, scaled, and decoded to the nearest
point of the E8 lattice.  Vectors at the same point are candidates, and so are those at the neighbouring
points that a vector is nearest to.  Candidates are confirmed by their cosine in double precision.
Equal vectors of a label are one class from the start, so copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from segue.llm.arrays import bounded_batches, frugal, mix
from segue.llm.components import components
from segue.session import materialize

MIN_COSINE = 0.98
TABLES = 8
PROBES = 16
RADIUS = 5.0  # lattice units that a unit vector's projection is long, on average
_SIDE = 8


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or all of a half with an even number of minuses."""
    found = []
    for i, j in combinations(range(_SIDE), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(_SIDE)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) / 2 for s in product((1, -1), repeat=_SIDE) if s.count(-1) % 2 == 0]
    return np.stack(found)


NEIGHBOURS = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole-numbered point with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8: the even whole numbers, or these moved by a half."""
    one, two = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - one) ** 2).sum(axis=1) <= ((x - two) ** 2).sum(axis=1)
    return np.where(nearer[:, None], one, two)


def projection(dimensions: int, table: int, radius: float = RADIUS) -> np.ndarray:
    random = np.random.default_rng([dimensions, table, 8])
    return random.standard_normal((dimensions, _SIDE)) * (radius / np.sqrt(_SIDE))


def _cell(points: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
    """64-bit name of (table, label, lattice point)."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    key = mix(label.view(np.uint64) + np.full(1, table + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    shape = (len(points), *[1] * (points.ndim - 2))
    key = np.broadcast_to(key.reshape(shape), points.shape[:-1]).copy()
    for j in range(_SIDE):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + doubled[..., j])
    return key.view(np.int64)


def cells(units: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(vector, table, 1 + probes) names of the own cell and of the neighbours nearest to the vector."""
    out = np.empty((len(units), tables, 1 + probes), np.int64)
    for t in range(tables):
        x = units @ projection(units.shape[1], t)
        point = nearest_e8(x)
        toward = (x - point) @ NEIGHBOURS.T
        best = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _cell(point, t, label)
        out[:, t, 1:] = _cell(point[:, None, :] + NEIGHBOURS[best], t, label)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _pack(kind: str):
    """Vectors as raw bytes; null for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for known, v in zip(batch.column("known").to_pylist(), batch.column("vector")):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), kind) if known and v.is_valid else np.zeros(0, kind)
                # Adding zero turns a negative zero into zero: both are the same number.
                raw.append((x + x.dtype.type(0)).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(raw, pa.binary())], names=["id", "label", "raw"]
            )

    return run


def _by_size(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    raw = column.to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1)


def _cells(kind: str, tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("id"), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for at, rows in _by_size(batch.column("raw"), kind):
                for a in range(0, len(at), 500):
                    part = at[a : a + 500]
                    names = cells(_unit(rows[a : a + 500]), labels[part], tables, probes)
                    n = tables * (1 + probes)
                    own = np.zeros((len(part), tables, 1 + probes), bool)
                    own[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids.take(pa.array(part)).to_numpy(), n)), pa.array(names.ravel()), pa.array(own.ravel())],
                        names=["id", "cell", "own"],
                    )

    return run


def _confirm(kind: str, min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("raw_a").to_pylist(), batch.column("raw_b").to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            same = np.fromiter((len(x) == len(y) for x, y in zip(left, right)), bool, batch.num_rows)
            chosen = np.flatnonzero(same)
            sizes = np.fromiter((len(left[i]) for i in chosen), np.int64, len(chosen))
            for size in np.unique(sizes):
                at = chosen[sizes == size]
                x = _unit(np.frombuffer(b"".join(left[i] for i in at), kind).reshape(len(at), -1))
                y = _unit(np.frombuffer(b"".join(right[i] for i in at), kind).reshape(len(at), -1))
                keep[at] = (x * y).sum(axis=1) >= min_cosine
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(keep)))

    return run


def near_vectors(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`.

    Rows of equal label are linked when their cosine is `min_cosine` or more and a table finds them: at 0.98 and
    the default tables practically all are found.  A row whose label or id is null, or whose vector is null, empty, zero
    or holds a null or non-finite number, is linked with nothing; so are vectors of different lengths.
    n_links counts other rows, copies included.  component_id: the smallest id reachable by links; kept: it is
    the own id (true without an id).  Ids and labels are whole numbers; an
    empty table gives an empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    vector = F.col(vector_col)
    known = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull()), F.lit(False))
    source = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), known.alias("known"),
        vector.cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"),
    )
    rows = materialize(source.mapInArrow(frugal(_pack(kind)), "id long, label long, raw binary"), "vectors")
    classes = materialize(
        rows.filter("raw IS NOT NULL").groupBy("label", "raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vector-classes"
    )
    named = materialize(
        classes.select("id", "label", "raw").mapInArrow(frugal(_cells(kind, tables, probes)), "id long, cell long, own boolean"), "cells"
    )
    inside = named.filter("own").select(F.col("id").alias("a"), "cell")
    around = named.select(F.col("id").alias("b"), "cell")
    met = inside.join(around, "cell").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = classes.select("id", "label", "raw")
    pairs = met.join(side.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("raw").alias("raw_a")), "a")
    pairs = pairs.join(side.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("raw").alias("raw_b")), "b")
    pairs = pairs.filter("la = lb").select("a", "b", "raw_a", "raw_b")
    links = materialize(pairs.mapInArrow(frugal(_confirm(kind, min_cosine)), "a long, b long"), "vector-links")
    sizes = classes.select("id", "n")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = ends.join(sizes.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("n").alias("around"))
    comps = components(links).withColumnRenamed("id", "a")
    result = classes.join(around, F.col("id") == F.col("a"), "left").drop("a").join(comps, F.col("id") == F.col("a"), "left").select(
        "label", "raw", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"),
    )
    whole = rows.join(result, ["label", "raw"], "left")
    component = F.coalesce("component", "id")
    return whole.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
e AS MATERIALIZED (SELECT a.r AS ra, a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.r <> b.r
      WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
n AS (SELECT ra, count(*) AS n FROM e GROUP BY ra),
reach(id, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, reach.low FROM reach JOIN e ON e.a = reach.id WHERE reach.low < e.b),
c AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM v LEFT JOIN n ON n.ra = v.r JOIN c ON c.id = v.vec_id"""

QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup}
ORACLES = {"op5_embedding_near_dedup": SQL}
