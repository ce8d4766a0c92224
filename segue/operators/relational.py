"""Filters, joins and aggregations over lists, items and interactions.

Tables: interactions (pid, pos, track), lists (pid, name, ...), items (track, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.functions.hashing import hash_below
from segue.operators.order import numbered

# Seed counts and list-length limits of the sub-tasks.
SUBTASK_SAMPLES = {"v1": 0, "v2": 1, "v3": 5, "v4": 5, "v5": 10, "v6": 10, "v7": 25, "v8": 100}
LENGTH_LIMITS = {1: (11, 80), 5: (40, 100), 10: (40, 100)}


def route_subtask(num_samples: str = "num_samples", name: str = "name") -> Column:
    """Class of a test list by its seed count; only 5 and 10 seeds split on having a title."""
    n, titled = F.col(num_samples), F.col(name).isNotNull()
    return (
        F.when(n == 0, "v1").when(n == 1, "v2")
        .when((n == 5) & titled, "v3").when(n == 5, "v4")
        .when((n == 10) & titled, "v5").when(n == 10, "v6")
        .when(n == 25, "v7").when(n == 100, "v8")
    )


def filter_length(lists: DataFrame, seeds: int) -> DataFrame:
    """Training lists about as long as the test lists with that many seeds."""
    low, high = LENGTH_LIMITS[seeds]
    return lists.filter(F.col("num_tracks").between(low, high))


def drop_null_lists(lists: DataFrame, columns: list[str]) -> DataFrame:
    return lists.dropna(subset=columns)


def keep_pids(df: DataFrame, pids: DataFrame) -> DataFrame:
    return df.join(pids.select("pid"), "pid", "left_semi")


def drop_pids(df: DataFrame, pids: DataFrame) -> DataFrame:
    return df.join(pids.select("pid"), "pid", "left_anti")


def sample_rows(triplets: DataFrame, ratio: float, users: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Rows kept with the given probability, of the given users when there are any."""
    kept = triplets.filter(hash_below(ratio, *triplets.columns, seed=seed))
    return kept.join(users.select("user"), "user", "left_semi") if users is not None else kept


def ordered_flag(seeds: DataFrame, samples: int) -> DataFrame:
    """1 when the seeds of a list stand in their original order without a gap.

    Looks at lists with exactly `samples` rows (pid, file_pos, pos), so a group is never larger
    than that: in file order pos must not fall, and last - first must be samples - 1."""
    sized = seeds.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == samples)
    rows = seeds.join(sized.select("pid"), "pid", "left_semi")
    by_file = Window.partitionBy("pid").orderBy("file_pos", "pos")
    stepped = rows.withColumn("rises", F.coalesce(F.col("pos") >= F.lag("pos").over(by_file), F.lit(True)))
    return stepped.groupBy("pid").agg(
        (
            F.bool_and("rises")
            & (F.max_by("pos", F.struct("file_pos", "pos")) - F.min_by("pos", F.struct("file_pos", "pos"))
               == samples - 1)
        ).cast("int").alias("ordered")
    )


def lists_with_items(lists: DataFrame, interactions: DataFrame) -> DataFrame:
    return lists.join(interactions, "pid", "left")


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)


def track_freq(interactions: DataFrame) -> DataFrame:
    """Rows per track; repeats inside a list count."""
    return interactions.groupBy("track").agg(F.count(F.lit(1)).alias("freq"))


def track_list_count(interactions: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Distinct lists per track; 0 for items no list holds."""
    cells = interactions.groupBy("pid", "track").agg(F.lit(1).alias("one"))
    counts = cells.groupBy("track").agg(F.count(F.lit(1)).alias("n_lists"))
    if items is None:
        return counts
    return items.select("track").join(counts, "track", "left").fillna(0, subset=["n_lists"])


def rows_per_key(df: DataFrame, key: str, name: str = "n_rows") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def distinct_cells(df: DataFrame, key: str, member: str) -> DataFrame:
    """The set of members of every key, one member per row: a key's set is never gathered."""
    return df.select(key, member).distinct()


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key in the given order."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(first.alias("r")).select(key, "r.*")


CHUNK = 1000  # items in one array


def ordered_items(interactions: DataFrame, max_items: int = CHUNK) -> DataFrame:
    """(pid, chunk, tracks): the tracks of a list in order, in arrays of at most max_items.

    Every list is numbered and cut by the same rule, so no array grows with the data."""
    rows = numbered(interactions.select("pid", "pos", "track"), "pid", ["pos", "track"], "_i")
    packed = F.array_sort(F.collect_list(F.struct("_i", "track")))
    chunk = F.floor(F.col("_i") / max_items).alias("chunk")
    return rows.groupBy("pid", chunk).agg(F.transform(packed, lambda x: x["track"]).alias("tracks"))
