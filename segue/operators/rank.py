"""Top-k per list, seed removal, backfill and output slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.operators.order import with_row_index
from segue.operators.skew import numbers_below
from segue.session import materialize

SCORE_UNITS = 1_000_000.0


def rounded(score: Column | str) -> Column:
    """Scores to six digits before ranking: a sum of floats depends on its order in the last digits.

    Plain arithmetic, since `round` goes through a decimal object for every row."""
    score = F.col(score) if isinstance(score, str) else score
    return F.floor(score * SCORE_UNITS + 0.5) / SCORE_UNITS


def topk_per_list(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """(pid, track, score, rank) of the k best tracks of every list; equal scores by track.

    Spark applies the limit before the shuffle too, so a hot list sends k rows per task."""
    best = Window.partitionBy("pid").orderBy(F.desc(score), "track")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def drop_seeds(scored: DataFrame, seeds: DataFrame) -> DataFrame:
    """Candidates that are not seeds of their own list."""
    return scored.join(seeds.select("pid", "track").distinct(), ["pid", "track"], "left_anti")


def rank_emit(scored: DataFrame, seeds: DataFrame, top: int = 550, k: int = 500, score: str = "score") -> DataFrame:
    """The `top` best by model score, seeds dropped, the first k of the rest."""
    best = topk_per_list(scored.select("pid", "track", score), top, score).drop("rank")
    return topk_per_list(drop_seeds(best, seeds), k, score)


def ranked_arrays(ranked: DataFrame, value: str = "track") -> DataFrame:
    """(pid, pred[]) from ranked rows; the arrays are as long as the ranking depth."""
    packed = F.array_sort(F.collect_list(F.struct("rank", value)))
    return ranked.groupBy("pid").agg(F.transform(packed, lambda x: x[value]).alias("pred"))


def popularity_backfill(pids: DataFrame, ranked: DataFrame, seeds: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """Fill every list up to k tracks by popularity, after what it already has.

    `popular` is (rank, track), all tracks by falling popularity, as `popularity_order` makes it.

    A list that lacks x tracks and knows y looks at the x + y most popular ones: at least x of those
    are new to it.  Their places are told from the list's own known tracks, row by row, and only the
    places that are filled become rows and get their track from the broadcast head."""
    have = ranked.groupBy("pid").agg(F.count(F.lit(1)).alias("n_have"))
    known = seeds.select("pid", "track").unionByName(ranked.select("pid", "track")).distinct()
    n_known = known.groupBy("pid").agg(F.count(F.lit(1)).alias("n_known"))
    short = materialize(
        pids.select("pid").join(have, "pid", "left").join(n_known, "pid", "left")
        .fillna(0, subset=["n_have", "n_known"])
        .filter(F.col("n_have") < k),
        "short-lists",
    )
    depth = (k - F.col("n_have") + F.col("n_known")).cast("int")
    deepest = short.agg(F.max(depth).alias("x")).first()["x"] or 0
    head = materialize(popular.filter(F.col("rank") <= deepest).select("track", F.col("rank").cast("int").alias("place")), "popular-head")
    head = F.broadcast(head)  # a few thousand rows, whatever the catalogue
    taken = known.join(head, "track").groupBy("pid").agg(F.collect_set("place").alias("taken"))
    # A list that comes more than once shares its places among its copies.
    asked = short.groupBy("pid", "n_have", depth.alias("depth")).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    asked = asked.join(taken, "pid", "left")
    places = F.sequence(F.lit(1), F.col("depth"))
    fresh = F.when(F.col("taken").isNull(), places).otherwise(F.array_except(places, "taken"))
    wanted = asked.select("pid", "n_have", "copies", F.posexplode(F.slice(fresh, F.lit(1), F.lit(k))).alias("i", "place"))
    wanted = numbers_below(wanted, F.col("copies"), "copy")
    wanted = wanted.withColumn("rank", (F.col("n_have") + F.col("i") * F.col("copies") + F.col("copy") + 1).cast("int"))
    fill = wanted.filter(F.col("rank") <= k).join(head, "place").select("pid", "track", "rank")
    return ranked.select("pid", "track", "rank").filter(F.col("rank") <= k).unionByName(fill)


def random_tracks(pids: DataFrame, items: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k different tracks for every list, the same on every run.

    Tracks are numbered 0..n-1.  A list starts at a place of its own and walks the numbers in
    steps of a prime larger than any catalogue, which meets k different tracks (all, when
    there are fewer than k)."""
    prime = 2_147_483_647  # fixed value
    numbered = with_row_index(items.select("track").distinct(), ["track"], "_no")
    total = numbered.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if total == 0:
        return pids.select("pid", F.lit(None).cast("bigint").alias("track"), F.lit(0).alias("rank")).limit(0)
    start = F.pmod(F.pmod(F.col("pid"), F.lit(prime)) * 48271 + seed, F.lit(prime))
    walk = pids.select("pid", start.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(min(k, total) - 1))).alias("j"))
    spot = F.pmod(F.col("s") + F.col("j").cast("bigint") * (prime % total), F.lit(total))
    return (
        walk.select("pid", (F.col("j") + 1).alias("rank"), spot.alias("_no"))
        .join(numbered, "_no").select("pid", "track", "rank")
    )


def union_slices(slices: dict[str, DataFrame]) -> DataFrame:
    """Result slices under one another, each row marked with its slice."""
    marked = [df.select(F.lit(name).alias("slice"), "pid", "rank", "track") for name, df in slices.items()]
    return reduce(DataFrame.unionByName, marked)
