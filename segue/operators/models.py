"""Learned parts: item embeddings, boosted-tree ranking, co-occurrence classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from segue.functions.hashing import hash_below
from segue.operators.cooccur import Packs
from segue.operators.listmodels import STEPS, list_statistics, ranked_lists
from segue.operators.rank import topk_per_list
from segue.operators.windows import NEGATIVES, SAMPLE, WINDOW, factors, shifted_information, window_pairs
from segue.session import materialize

EMBEDDING_SIZE, EMBEDDING_ROUNDS = 100, 4


def key_rows(interactions: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(pid, pos, key): the rows of each list as tracks, or as their albums or artists."""
    if keys is None:
        return interactions.select("pid", "pos", F.col("track").alias("key"))
    return interactions.select("pid", "pos", "track").join(keys.toDF("track", "key"), "track").select("pid", "pos", "key")


def train_embeddings(rows: DataFrame, size: int = EMBEDDING_SIZE, rounds: int = EMBEDDING_ROUNDS, seed: int = 1,
                     window: int = WINDOW, negatives: int = NEGATIVES, sample: float = SAMPLE) -> DataFrame:
    """(key, vector) from `rows` (pid, pos, key): factors of the shifted mutual information of neighbours in the lists.

    Items that stand near the same items get near vectors.  Keys are whole numbers or texts and are not renumbered; an item
    without a neighbour has no vector."""
    staged = materialize(rows.select("pid", "pos", "key"), "key-rows")
    pairs = materialize(window_pairs(staged, window), "window-pairs")
    counts = materialize(staged.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key-counts")
    return factors(materialize(shifted_information(pairs, counts, negatives, sample), "information"), size, rounds, seed)


# Fixed values of the boosted trees.
GBT_DEPTH, GBT_RATE, GBT_ROUNDS, GBT_ROWS, GBT_ROWS_ONE_SEED, GBT_FEATURES = 5, 0.01, 1700, 0.7, 0.8, "0.9"
GBT_INPUTS = ["track", "cf_prob", "album", "artist", "name_sim", "album_sim", "artist_sim", "cf_rlt_prob",
              "freq", "w2v_track_sim", "w2v_album_sim", "w2v_artist_sim"]


def model_inputs(features: DataFrame) -> list[str]:
    return [c for c in GBT_INPUTS if c in features.columns]


GBT_PATIENCE = 5
FIRST_ROUNDS = 25


@dataclass(frozen=True)
class Boosted:
    """Trees cut at their best round, and the squared error on the validation lists after each round that was tried."""

    model: PipelineModel
    rounds: int
    errors: list[float]
    auc: float | None

    @property
    def trees(self) -> GBTRegressionModel:
        return self.model.stages[-1]

    @property
    def importances(self) -> dict[str, float]:
        """The importance of each model input; one behind the last that a tree uses is not in the vector of a cut model."""
        names, weights = self.model.stages[0].getInputCols(), self.trees.featureImportances.toArray().tolist()
        return dict(zip(names, weights + [0.0] * (len(names) - len(weights))))


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the smallest error, whether `patience` rounds passed without a smaller one)."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(longer: GBTRegressionModel, n: int, context: SparkContext) -> GBTRegressionModel:
    """The model of the first n trees of a longer one, which a fit of n rounds with the same seed would give."""
    kind = context._jvm.org.apache.spark.ml.regression
    trees = context._gateway.new_array(kind.DecisionTreeRegressionModel, n)
    weights = context._gateway.new_array(context._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(longer._java_obj.trees())[:n], longer.treeWeights[:n])):
        trees[i], weights[i] = tree, weight
    kept = GBTRegressionModel(kind.GBTRegressionModel(longer.uid, trees, weights))
    return kept.setFeaturesCol(longer.getFeaturesCol()).setPredictionCol(longer.getPredictionCol())


def gbt_train(features: DataFrame, rounds: int = GBT_ROUNDS, rate: float = GBT_RATE, rows: float = GBT_ROWS,
              seed: int = 1, test_ratio: float = 0.2, patience: int = GBT_PATIENCE) -> Boosted:
    """Boosted regression trees on the 0/1 label, stopped after `patience` rounds without a smaller error on the lists of
    the test share, and cut at the best round.

    A fit of n rounds gives the first n trees of every longer fit with the same seed, so the length is doubled until the
    error has stopped falling, and the last fit is cut at the best round.  Training passes over the table once per tree
    level, so it is written as a stage first.  Without a list in the test share all rounds are kept."""
    inputs = VectorAssembler(inputCols=model_inputs(features), outputCol="features")
    marked = materialize(inputs.transform(features.withColumn("is_valid", hash_below(test_ratio, "pid", seed=seed))).select(
        "features", "label", "is_valid"
    ), "gbt-input")
    # The drawn rows depend on the order of the files, and a folder lists them in any order.
    files = sorted(marked.inputFiles())
    marked = marked.sparkSession.read.schema(marked.schema).parquet(*files) if files else marked
    fitting, held = marked.filter("NOT is_valid"), marked.filter("is_valid")

    def fit(n: int) -> GBTRegressionModel:
        return GBTRegressor(
            featuresCol="features", labelCol="label", predictionCol="prob", maxDepth=GBT_DEPTH, maxIter=n,
            stepSize=rate, subsamplingRate=rows, featureSubsetStrategy=GBT_FEATURES, seed=seed,
        ).fit(fitting)

    watched = not held.isEmpty()
    length = min(FIRST_ROUNDS, rounds) if watched else rounds
    while True:
        trees = fit(length)
        errors = trees.evaluateEachIteration(held, "squared") if watched else []
        keep, over = best_round(errors, patience) if watched else (length, True)
        if over or length == rounds:
            break
        length = min(2 * length, rounds)
    if keep < length:
        trees = first_trees(trees, keep, marked.sparkSession.sparkContext)
    auc = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label").evaluate(trees.transform(held)) if watched else None
    return Boosted(PipelineModel([inputs, trees]), keep, errors, auc)


def gbt_score(boosted: Boosted, features: DataFrame) -> DataFrame:
    return boosted.model.transform(features).select("pid", "track", "cf_prob", "prob")


def svc_features(pairs: DataFrame | Packs, seeds: DataFrame) -> DataFrame:
    """(test, track, label, v_sum, v_mean, v_max, v_count) per candidate of a list.

    `pairs` holds v per (seed, track) or per (test, seed, track).  A track's own term as a seed is
    left out, so that seeds and other tracks are described alike."""
    return list_statistics(pairs, seeds)


SVC_INPUTS = ["v_sum", "v_mean", "v_max", "v_count"]


def svc_rerank(pairs: DataFrame | Packs, seeds: DataFrame, tracks: int | DataFrame, c: float, k: int = 500, steps: int = STEPS) -> DataFrame:
    """(pid, track, score, rank): candidates by the decision value of their list's own linear SVC, which tells the list's seeds
    from all other tracks by the values `pairs` of its seeds; seeds are not returned.

    All models are fit together, see `listmodels`; `c` weighs the summed loss."""
    return ranked_lists(pairs, seeds, tracks, c, k, steps)


def svc_rerank_pooled(features: DataFrame, c: float, k: int = 500, max_iter: int = 100) -> DataFrame:
    """(pid, track, score, rank): candidates by the decision value of one linear SVC for all lists, on the statistics of
    `svc_features`; seeds are not returned.

    The usual C weighs the summed loss, Spark's regParam the mean loss, hence 1 / (C n)."""
    staged = materialize(VectorAssembler(inputCols=SVC_INPUTS, outputCol="features").transform(features), "svc-input")
    n = staged.count()
    model = LinearSVC(featuresCol="features", labelCol="label", regParam=1.0 / (c * max(n, 1)), maxIter=max_iter).fit(staged)
    decided = model.transform(staged.filter(F.col("label") == 0))
    score = vector_to_array("rawPrediction")[1]
    return topk_per_list(decided.select(F.col("test").alias("pid"), "track", score.alias("score")), k)
