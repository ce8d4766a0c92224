"""Near duplicates by MinHash bands and sequential Bayesian verification.

Documents of equal shingle sets are one class from the start.  Classes that share a band of their signature are
candidates.  A pair's signatures are compared batch by batch; after each batch the pair is dropped when the
posterior probability that its similarity reaches the threshold is below the chosen miss probability.  What is
left is confirmed on the full shingle sets.

Only components are asked for, so a bucket's pairs are never all made.  First each class meets the smallest
of its bucket, then, in buckets whose classes are still apart, others: a drawn one in large buckets, all of
another component in small ones.  In large buckets that are still apart the classes outside the leading component are
compared with all others block by block inside tasks, which give out links only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from segue.llm.arrays import LOWER, Spans, bounded_batches, distinct_per_text, frugal, mix, shingles, span_hashes, text_bytes
from segue.llm.components import components
from segue.operators.skew import numbers_below
from segue.session import materialize

BANDS, ROWS = 32, 6  # a pair at 0.8 shares no band with probability 6e-5
COMPARED = 128  # values of the signature that are kept for the comparison
BATCH = 16
CONFIRMED = 1  # family of hashes on which links are confirmed
MISS = 1e-5  # per batch
SMALL_BUCKET = 48
BLOCK = 500
BROADCAST_IDS = 1_000_000

_FACTORS = np.random.default_rng(20240229).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = np.random.default_rng(20240301).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the least number of equal values that keeps a pair.

    With every similarity as likely beforehand, n values of which m are equal leave similarity t or more with the
    probability that at most m of n + 1 throws of chance t succeed."""
    t, out = percent / 100, []
    for n in range(BATCH, COMPARED + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def shingle_sets(column: pa.Array, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes, offsets by text) of the lower-cased words of each text.

    Signatures come from one family of word hashes; equal sets and links are confirmed with another, so a false link
    needs a collision in both."""
    data, offs = text_bytes(column)
    data = LOWER[data]
    words = Spans(data, offs)
    return distinct_per_text(*shingles(span_hashes(data, words.starts, words.ends, family), words.first, k))


def _raw(values: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix."""
    width = values.shape[1] * values.itemsize
    bounds = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(values.tobytes())])


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sets, offs = shingle_sets(batch.column("text"), k)
            others, other_offs = shingle_sets(batch.column("text"), k, CONFIRMED)
            some = offs[1:] > offs[:-1]
            starts = offs[:-1][some]
            least = np.zeros((n, BANDS * ROWS), np.uint32)
            if len(starts):
                short = (sets >> np.uint64(32)).astype(np.uint32)
                for j in range(BANDS * ROWS):
                    least[some, j] = np.minimum.reduceat((short ^ _MASKS[j]) * _FACTORS[j], starts)
            bands = np.empty((n, BANDS), np.uint64)
            for j in range(BANDS):
                key = np.full(n, j + 1, np.uint64)
                for v in range(j * ROWS, (j + 1) * ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, v])
                bands[:, j] = key
            # Two sums over the set, each in its own family of hashes, name it.
            one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            if len(starts):
                one[some] = np.add.reduceat(mix(sets), starts)
                two[some] = np.add.reduceat(mix(others), other_offs[:-1][some])
            longs = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offs)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), longs),
                 _raw(least[:, :COMPARED])],
                names=["id", "n_shingles", "d1", "d2", "bands", "signature"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets, offs = shingle_sets(batch.column("text"), k, CONFIRMED)
                held = pa.Array.from_buffers(
                    pa.binary(), batch.num_rows, [None, pa.py_buffer((offs * 8).astype(np.int32).tobytes()), pa.py_buffer(sets.tobytes())]
                )
                yield pa.RecordBatch.from_arrays([batch.column("id"), held], names=["id", "shingles"])

    return run


def survivors(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Numbers of the rows of two signature matrices that no batch rules out."""
    left, equal = np.arange(len(one)), np.zeros(len(one), np.int64)
    for i, least in enumerate(least_matches(percent)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal = equal + (one[left, part] == two[left, part]).sum(axis=1)
        keep = equal >= least
        left, equal = left[keep], equal[keep]
    return left


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COMPARED)


def _prune(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(survivors(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), percent))
                yield batch.select(["a", "b"]).take(keep)

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _cell(percent: int):
    """Links between the strays of one block and the classes of another, one for each component at most.

    Signatures rule pairs out first; what survives is counted exactly, by marking a stray's shingles."""

    def run(key, frame):
        import pandas as pd  # here, as the other tasks do without it

        ids, comps = frame["id"].to_numpy(), frame["component"].to_numpy()
        sigs = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(len(frame), COMPARED)
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        marked = np.zeros(len(names), bool)
        stray = frame["stray"].to_numpy()
        others, out = np.flatnonzero(~stray), []
        for i in np.flatnonzero(stray):
            near = others[comps[others] != comps[i]]
            near = near[survivors(np.broadcast_to(sigs[i], (len(near), COMPARED)), sigs[near], percent)]
            if not len(near):
                continue
            own = flat[offs[i] : offs[i + 1]]
            marked[own] = True
            sizes = offs[near + 1] - offs[near]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(offs[near] - bounds[:-1], sizes) + np.arange(bounds[-1])
            shared = np.diff(np.concatenate([[0], np.cumsum(marked[flat[take]])])[bounds])
            marked[own] = False
            linked = near[100 * shared >= percent * (len(own) + sizes - shared)]
            _, first = np.unique(comps[linked], return_index=True)
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in linked[first]]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


class _Candidates:
    """The classes in shared buckets, and the links found between them so far."""

    def __init__(self, classes: DataFrame, sets: DataFrame, members: DataFrame, percent: int):
        self.signatures = classes.select("id", "signature")
        self.sets, self.members, self.percent = sets, members, percent
        self.links: DataFrame | None = None

    def look_at(self, pairs: DataFrame) -> None:
        """Compare pairs (a, b) of ids and add the links among them."""
        sig = self.signatures
        pairs = pairs.distinct()
        pairs = pairs.join(sig.select(F.col("id").alias("a"), F.col("signature").alias("sig_a")), "a")
        pairs = pairs.join(sig.select(F.col("id").alias("b"), F.col("signature").alias("sig_b")), "b")
        left = pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(frugal(_prune(self.percent)), "a long, b long")
        left = left.join(self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
        left = left.join(self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
        found = left.select("a", "b", "set_a", "set_b").mapInArrow(frugal(_confirm(self.percent)), "a long, b long")
        self._add(materialize(found, "near-links"))

    def _add(self, found: DataFrame) -> None:
        self.links = found if self.links is None else self.links.unionByName(found)

    def compare_strays(self, apart: DataFrame) -> None:
        """Compare the classes outside their bucket's leading component with all classes of such buckets.

        Buckets with the same leading component are one group, so that two classes meet once, however many
        buckets they share.  A group is cut into blocks of strays and blocks of classes; a task compares two."""
        counts = apart.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        lead = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("lead"))
        rows = materialize(apart.join(lead, "bucket").select("lead", "id", "component").distinct(), "strays")
        is_stray = F.col("component") != F.col("lead")
        blocks = rows.groupBy("lead").agg(
            F.ceil(F.count(F.when(is_stray, 1)) / BLOCK).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("columns")
        )
        held = self.signatures.dropDuplicates(["id"]).join(self.sets, "id")
        dealt = rows.join(blocks, "lead").join(held, "id")
        strays = numbers_below(
            dealt.filter(is_stray).withColumn("row", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int")), F.col("columns"), "column"
        ).withColumn("stray", F.lit(True))
        every = numbers_below(
            dealt.withColumn("column", F.pmod(F.xxhash64("id"), F.col("columns")).cast("int")), F.col("rows"), "row"
        ).withColumn("stray", F.lit(False))
        cells = strays.unionByName(every).drop("rows", "columns")
        self._add(materialize(cells.groupBy("lead", "row", "column").applyInPandas(_cell(self.percent), "a long, b long"), "near-links"))

    def apart(self, above: int = 0) -> DataFrame:
        """(bucket, id, size, component) in the buckets of over `above` classes that lie in different components."""
        comps = components(self.links).withColumnRenamed("id", "cid")
        marked = self.members.filter(F.col("size") > above).join(comps, F.col("id") == F.col("cid"), "left").select(
            "bucket", "id", "size", F.coalesce("component", "id").alias("component")
        )
        mixed = marked.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
        return materialize(marked.join(mixed.select("bucket"), "bucket"), "apart")


def _star(rows: DataFrame, place: Column) -> DataFrame:
    """Each class of a bucket with the one of the smallest place, if they are in different components."""
    heads = rows.groupBy("bucket").agg(F.min_by(F.struct("id", "component"), place).alias("head"))
    met = rows.join(heads, "bucket").filter("component <> head.component")
    return met.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`.

    Words end at ASCII white space, A to Z are lower-cased; a text of fewer than `k` words is one shingle.  Texts are
    linked when 100 * shared >= percent * union of their shingles.  component_id: the smallest id reachable by
    links; kept: it is the own id.  Null and empty texts and texts without words are linked with nothing.
    Rows that share an id follow each its own text; a row without an id is linked with nothing, has no
    component and is kept.  Ids are whole numbers.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = materialize(source.mapInArrow(
        frugal(_sketch(k)), "id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"
    ), "sketches")
    full = sketches.filter("n_shingles > 0 AND id IS NOT NULL")
    firsts = materialize(full.groupBy("d1", "d2").agg(F.min("id").alias("first")), "classes")
    classes = materialize(
        full.join(firsts.select("d1", "d2", F.col("first").alias("id")), ["d1", "d2", "id"])
        .dropDuplicates(["d1", "d2", "id"]).select("id", "d1", "d2", "bands", "signature"),
        "class-sketches",
    )
    in_buckets = classes.select("id", F.explode("bands").alias("bucket"))
    shared = in_buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(in_buckets.join(shared, "bucket"), "buckets")

    wanted = materialize(members.select("id").distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = materialize(source.join(wanted, "id", "left_semi").mapInArrow(frugal(_sets(k)), "id long, shingles binary").dropDuplicates(["id", "shingles"]), "sets")

    found = _Candidates(classes, sets, members, percent)
    found.look_at(_star(members.withColumn("component", F.col("id")), F.col("id")))
    apart = found.apart()
    if not apart.isEmpty():
        one = apart.filter(F.col("size") <= SMALL_BUCKET)
        two = one.select("bucket", F.col("id").alias("b"), F.col("component").alias("other"))
        every = one.join(two, "bucket").filter("id < b AND component <> other").select(F.col("id").alias("a"), "b")
        drawn = _star(apart.filter(F.col("size") > SMALL_BUCKET), F.xxhash64("id", "bucket"))
        found.look_at(every.unionByName(drawn))
        apart = found.apart(SMALL_BUCKET)
        if not apart.isEmpty():
            found.compare_strays(apart)

    comps = components(found.links).withColumnRenamed("id", "first")
    named = sketches.select("id", "n_shingles", "d1", "d2").join(firsts, ["d1", "d2"], "left").join(comps, "first", "left")
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    component = F.when(linked, F.coalesce("component", "first")).otherwise(F.col("id"))
    return named.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE array_to_string(w[i : i + 1], ' ') END AS g
      FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, count(*) AS size FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS n_both FROM s AS x JOIN s AS y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
e AS MATERIALIZED (SELECT na.doc_id AS a, nb.doc_id AS b FROM p JOIN n AS na ON na.r = p.a JOIN n AS nb ON nb.r = p.b
      WHERE 100 * n_both >= 80 * (na.size + nb.size - n_both)),
e2 AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e2.b, reach.low FROM reach JOIN e2 ON e2.a = reach.id WHERE reach.low < e2.b),
c AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(size, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c ON c.id = d.doc_id"""

QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
ORACLES = {"op3_minhash_near_dedup": SQL}
