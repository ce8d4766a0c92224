"""Hold-out splits.  All of them give the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from segue.functions.hashing import hash_below, stable_hash
from segue.operators.order import with_row_index
from segue.operators.skew import numbers_below
from segue.session import materialize

HOLDOUT_SEED = 666  # fixed value


def split_lists(lists: DataFrame, test_ratio: float = 0.2, seed: int = HOLDOUT_SEED) -> DataFrame:
    """Mark every list as test (about the given share) or train."""
    return lists.withColumn("is_test", hash_below(test_ratio, "pid", seed=seed))


def first_items(interactions: DataFrame, t: int) -> DataFrame:
    """The first t rows of every list.  The row limit is applied before the shuffle as well,
    so a hot list sends at most t rows per task."""
    by_pos = Window.partitionBy("pid").orderBy("pos", "track")
    return interactions.withColumn("_rn", F.row_number().over(by_pos)).filter(F.col("_rn") <= t).drop("_rn")


def _mark_head(rows: DataFrame, order: list[str], t: int) -> DataFrame:
    """`rows` with is_head, true for the first t rows of each list, and is_long, true for lists of more rows.

    Only the heads of the lists are sorted; the last row of each head is joined back, and every other row is
    compared with it where it stands.  Equal rows are counted first, so that a head can end among them."""
    by_order = Window.partitionBy("pid").orderBy(*order)
    # One row more than the head shows whether a list is longer.
    head = rows.withColumn("_rn", F.row_number().over(by_order)).filter(F.col("_rn") <= t + 1)
    inside = F.col("_rn") <= t
    cut = head.groupBy("pid").agg(
        F.max(F.when(inside, F.struct(*order, (-F.col("_rn")).alias("_first")))).alias("_cut"),
        F.max(F.when(inside, F.col("_rn"))).alias("_size"), (F.max("_rn") > t).alias("is_long"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).join(cut, "pid")
    here, last = F.struct(*order), F.struct(*[F.col(f"_cut.{c}").alias(c) for c in order])
    at_end = F.col("_size") + F.col("_cut._first") + 1  # rows of the head that equal its last one
    heads = F.when(here < last, F.col("_n")).when(here == last, at_end).otherwise(0)
    each = numbers_below(counted.withColumn("_heads", heads), F.col("_n"), "_i")
    return each.select(*rows.columns, "is_long", (F.col("_i") < F.col("_heads")).alias("is_head"))


def mark_prefix(interactions: DataFrame, t: int) -> DataFrame:
    """(pid, pos, track, is_seed): whether a row is among the first t of its list."""
    marked = _mark_head(interactions.select("pid", "pos", "track"), ["pos", "track"], t)
    return marked.select("pid", "pos", "track", F.col("is_head").alias("is_seed"))


def split_prefix(interactions: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """Seeds: the first t items of every list; truth: all its other rows."""
    marked = materialize(mark_prefix(interactions, t), "prefix")
    return marked.filter("is_seed").drop("is_seed"), marked.filter("NOT is_seed").drop("is_seed")


def split_random_items(interactions: DataFrame, t: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds: t rows of every list longer than t drawn without replacement; truth: its tracks
    that were not drawn; train: lists of at most t rows in full, and the seeds of the others."""
    rows = interactions.select("pid", "pos", "track").withColumn("_h", stable_hash("pid", "pos", "track", seed=seed))
    marked = materialize(_mark_head(rows, ["_h", "pos", "track"], t).drop("_h"), "drawn")
    picked = marked.filter("is_head")
    tracks = marked.filter("is_long").groupBy("pid", "track").agg(F.bool_or("is_head").alias("drawn"))
    # A list of at most t rows is drawn whole, so the draw is the train side of every list.
    return (
        picked.filter("is_long").select("pid", "pos", "track"), tracks.filter("NOT drawn").select("pid", "track"),
        picked.select("pid", "pos", "track"),
    )


def split_sequential(lists: DataFrame, n_train: int, n_test: int) -> DataFrame:
    """The first n_train lists by pid train, the next n_test test."""
    part = F.when(F.col("_row") < n_train, "train").otherwise("test")
    indexed = with_row_index(lists, ["pid"], "_row").filter(F.col("_row") < n_train + n_test)
    return indexed.withColumn("part", part).drop("_row")
