"""Quality classifier: naive-Bayes support vectors.

Features are indicators of hashed n-grams of words and signs.  Each is scaled by the logarithm of the ratio of
its smoothed rates in the two classes, counted over all labelled training rows; a linear hinge-loss model on
the scaled features is then fit by dual coordinate descent on a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from segue.llm.arrays import LOWER, bounded_batches, distinct_per_text, frugal, mix, span_hashes, text_bytes
from segue.llm.carry import held_out, with_row
from segue.session import materialize

DIMENSIONS = 1 << 18
MAX_TRAIN_ROWS = 16_000  # labelled rows that the hinge-loss fit sees, drawn by a hash of the id
BROADCAST_LABELS = 2_000_000  # above so many labels they are joined by a shuffle
EPOCHS = 12
COST = 1.0
KEEP_SCORE = 0.7

# 0: between words; 1: part of a word (letters, digits, all bytes beyond ASCII); 2: a sign, a word by itself.
_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1


def features(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct feature numbers, offsets by text): words, pairs of neighbours, pairs of word shapes, and
    which of five words in a row are the same."""
    data, offs = text_bytes(column)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start = np.ones(len(data), bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1 : len(data)] | (kind[1:] == 2)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    words = span_hashes(LOWER[data], starts, ends)
    first = np.searchsorted(starts, offs)
    text_of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    inside = text_of[1:] == text_of[:-1]
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[inside]
    # A pair of shapes: whether the neighbours are words or which signs they are, and whether they touch.
    shape = np.where(kind[starts] == 1, np.uint64(1), words)
    touch = (ends[:-1] == starts[1:]).astype(np.uint64)
    shapes = mix(shape[:-1] * np.uint64(0xD6E8FEB86659FD93) + shape[1:] + touch)[inside]
    # Which of five neighbours repeat each other, whatever they are.
    repeats, whole = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= 5:
        whole = np.flatnonzero(text_of[:-4] == text_of[4:])
        one, two = words[1:] == words[:-1], words[2:] == words[:-2]
        bits = sum(same[j : len(words) - 4 + j].astype(np.uint64) << np.uint64(b) for b, (same, j) in enumerate(
            [(one, 0), (one, 1), (one, 2), (one, 3), (two, 0), (two, 1), (two, 2)]))
        repeats = mix(bits[whole] + np.uint64(0x5DEECE66D))
    values = np.concatenate([words, pairs, shapes, repeats]) % np.uint64(dimensions)
    owner = np.concatenate([text_of, text_of[1:][inside], text_of[1:][inside], text_of[whole]])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(offs) - 1)
    return distinct_per_text(values[order].astype(np.int32), np.concatenate([[0], np.cumsum(counts)]))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values, offs = features(batch.column("text"))
            packed = pa.Array.from_buffers(
                pa.binary(), batch.num_rows,
                [None, pa.py_buffer((offs * 4).astype(np.int32).tobytes()), pa.py_buffer(values.astype("<i4").tobytes())],
            )
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), packed], names=["id", "label", "features"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((2, DIMENSIONS), np.int64)
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for label, packed in zip(labels, batch.column("features").to_pylist()):
            held[label, np.frombuffer(packed, "<i4")] += 1
    some = np.flatnonzero(held.sum(axis=0))
    for a in range(0, len(some), 1 << 16):
        part = some[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(held[0, part]), pa.array(held[1, part])], names=["feature", "bad", "good"]
        )


def descend(
    values: np.ndarray, offs: np.ndarray, labels: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS, cost: float = COST
) -> np.ndarray:
    """Weights (and a bias at the end) of the hinge-loss model, by dual coordinate descent.

    Rows are feature numbers values[offs[i]:offs[i + 1]], scaled by `ratio` and to length one."""
    n = len(labels)
    sign = np.where(labels > 0, 1.0, -1.0)
    # Each class has the same total cost.
    share = np.array([max((labels == c).sum(), 1) for c in (0, 1)])
    most = cost * n / (2 * share[(labels > 0).astype(int)])
    weights = np.zeros(len(ratio) + 1)
    alpha = np.zeros(n)
    rows = []
    for i in range(n):
        at = values[offs[i] : offs[i + 1]]
        x = ratio[at]
        rows.append((at, x / max(np.sqrt(x @ x), 1e-9)))
    random = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(n):
            at, x = rows[i]
            square = x @ x + 1.0
            gradient = sign[i] * (weights[at] @ x + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square, 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[at] += step * x
                weights[-1] += step
                moved += abs(step)
                alpha[i] = new
        if moved < 1e-3 * n:
            break
    return weights


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from margins to the rate of label 1, by Newton's method."""
    good, bad = (labels > 0).sum(), (labels <= 0).sum()
    goal = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        g = np.array([((p - goal) * margins).sum() + 1e-3 * (slope - 1), (p - goal).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(slope, 1e-3)), float(offset)


def margins_of(values: np.ndarray, offs: np.ndarray, weights: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    scaled = np.concatenate([[0.0], np.cumsum(weights[values] * ratio[values])])[offs]
    squares = np.concatenate([[0.0], np.cumsum(ratio[values] ** 2)])[offs]
    return np.diff(scaled) / np.sqrt(np.maximum(np.diff(squares), 1e-18)) + weights[-1]


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, column: pa.Array) -> np.ndarray:
        values, offs = features(column)
        margin = margins_of(values, offs, self.weights, self.ratio)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _fit(shared):
    """The model of a sample of rows, as one row; a fifth of them sets the curve from margins to scores."""

    def run(frame):
        import pandas as pd  # here, as the other tasks do without it

        ratio = shared.value
        frame = frame.sort_values(["place", "id"])
        labels = frame["label"].to_numpy()
        packed = [np.frombuffer(x, "<i4") for x in frame["features"]]

        def rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            chosen = [packed[i] for i in which]
            return np.concatenate([*chosen, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(x) for x in chosen])]).astype(int)

        every = np.arange(len(labels))
        test, rest = every[every % 5 == 4], every[every % 5 != 4]
        slope, offset = 4.0, 0.0
        if len(set(labels[test])) == 2 and len(set(labels[rest])) == 2:
            part = descend(*rows(rest), labels[rest], ratio)
            slope, offset = sigmoid_fit(margins_of(*rows(test), part, ratio), labels[test])
        weights = descend(*rows(every), labels, ratio)
        return pd.DataFrame({"weights": [weights.astype("<f8").tobytes()], "slope": [slope], "offset": [offset]})

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS) -> Model | float:
    """The model of the rows of `docs` that have a label (id, label 0 or 1) in `labels`.

    Repeated labels of an id count once, the greatest; null ids and labels do not count.  With labels of one class only
    the result is that class's rate, with none it is 0.5.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.toDF("id", "label").dropna().groupBy("id").agg(F.max("label").cast("int").alias("label")).filter("label IN (0, 1)")
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = materialize(texts.mapInArrow(frugal(_sparse), f"id {id_type}, label int, features binary"), "quality-features")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes))) if sizes else 0.5
    counts = rows.select("label", "features").mapInArrow(frugal(_counts), "feature int, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    ).toPandas()  # at most DIMENSIONS rows
    # Smoothed so that a feature never seen speaks for neither class.
    every = sizes[0] + sizes[1]
    bad, good = np.full(DIMENSIONS, 2 * sizes[0] / every), np.full(DIMENSIONS, 2 * sizes[1] / every)
    bad[counts["feature"]] += counts["bad"]
    good[counts["feature"]] += counts["good"]
    ratio = np.log((good / sizes[1]) / (bad / sizes[0]))
    # The sample: every row while they are few, else a hash of the id below a bound.
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30))
    bound = min(1.0, max_train_rows / every)
    sample = rows.withColumn("place", place).filter(F.col("place") < int(bound * (1 << 30)))
    shared = spark.sparkContext.broadcast(ratio)
    fit = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit(shared), "weights binary, slope double, offset double").first()
    if fit is None:
        return sizes[1] / sum(sizes.values())
    return Model(ratio, np.frombuffer(bytes(fit["weights"]), "<f8"), fit["slope"], fit["offset"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                text = batch.column("text")
                found = model.score(text) if isinstance(model, Model) else np.full(batch.num_rows, model)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], names=["row", "score"])

    return run


def classify(docs: DataFrame, model: Model | float, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, score, predicted) for every row of `docs`; `row` is the input row, or its columns `keep`.

    score: probability of label 1; predicted: 1 from KEEP_SCORE on.  Null and empty texts have no features and get
    the score of the bias alone; equal texts get equal scores.  Very long texts are scored whole; an empty table gives an empty
    result.
    """
    bounded_batches(docs.sparkSession)
    source = with_row(docs, keep, text=F.col(text_col))
    schema = T.StructType([source.schema["row"]]).add("score", "double")
    scored = source.mapInArrow(frugal(_score(docs.sparkSession.sparkContext.broadcast(model))), schema)
    return scored.withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


def classify_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """`classify` by a model of the labelled rows outside the hold-out; labels has (id, label)."""
    return classify(docs, train(docs.filter(~held_out(id_col)), labels, id_col), keep=keep)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = classify_held_out(docs, labels, keep=["doc_id"])
    return found.select("row.doc_id", "score", "predicted").withColumn("held_out", held_out("doc_id"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLES: dict = {}
