"""Keys that hold too many rows for one task.

Plain equi-joins are left to AQE, which splits big partitions by size.  Size is no help
where a small input expands into a large output (one list with a million items meets every
one of its seeds), nor where the rows of a key must be spread before an aggregation; there
the heavy keys are found first and cut into pieces.

The heavy keys are a written table of (key, pieces): all of them, however many.  Joins with it are plain
joins, so it is broadcast only when Spark sees that it is small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from segue.session import materialize

# Cells of a list in one piece.  Only the list's seed cells are copied to its pieces, so the copies
# are a five-thousandth of the pairs they lead to.
ROWS_PER_PIECE = 5_000
# Rows of a seed or n-gram in one piece, where each of them meets all matches of the key.  The
# matches are copied to the pieces, a five-hundredth of what comes out.
MATCHES_PER_PIECE = 500
COPIES_AT_ONCE = 1_000
# Rows that one task sums up where packs are dealt: its sums stay in memory, whatever the size of the input.
PAIRS_PER_TASK = 1_000_000


def tasks_for(df: DataFrame, rows) -> int:
    """Number of tasks for so many rows, given as a sum over `df`."""
    total = df.agg(F.sum(rows).alias("n")).first()["n"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PAIRS_PER_TASK))


def load_of(df: DataFrame, rows) -> tuple[int, int]:
    """(`tasks_for` so many rows, the greatest number of parts of one key), given as a column of `df`, a row for each key."""
    found = df.agg(F.sum(rows).alias("n"), F.max(parts_of(rows)).alias("parts")).first()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((found["n"] or 0) / PAIRS_PER_TASK)), found["parts"] or 1


def parts_of(rows) -> Column:
    """Parts that a key with so many rows is cut into where packs are dealt."""
    return F.greatest(F.ceil(F.coalesce(rows, F.lit(0)) / PAIRS_PER_TASK), F.lit(1)).cast("int")


def heavy_keys(df: DataFrame, key: str, rows_per_piece: int | None = None) -> DataFrame:
    """(key, pieces) of every key above the row limit."""
    rows_per_piece = rows_per_piece or MATCHES_PER_PIECE
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > rows_per_piece)
    return materialize(counts.select(key, F.ceil(F.col("rows") / rows_per_piece).cast("int").alias("pieces")), "heavy")


def cut(df: DataFrame, key: str, heavy: DataFrame, spread_by: str) -> DataFrame:
    """Give every row a piece number; the rows of a heavy key are spread over its pieces."""
    pieces = F.coalesce("pieces", F.lit(1))
    return (
        df.join(heavy, key, "left")
        .withColumn("piece", F.pmod(F.xxhash64(spread_by), pieces).cast("int"))
        .drop("pieces")
    )


def copy_to_pieces(df: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """The other side of a cut join: rows of a heavy key are repeated once per piece."""
    return numbers_below(df.join(heavy, key, "left"), F.coalesce("pieces", F.lit(1)), "piece").drop("pieces")


def numbers_below(df: DataFrame, n, name: str) -> DataFrame:
    """Each row once for every number from 0 to n - 1, in steps, so that no array grows with n."""
    step = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / COPIES_AT_ONCE).cast("int")))
    low = F.col("_step") * COPIES_AT_ONCE
    stepped = df.withColumn("_n", n.cast("int")).withColumn("_step", step)
    inside = F.explode(F.sequence(low, F.least(low + COPIES_AT_ONCE, F.col("_n")) - 1))
    return stepped.withColumn(name, inside).drop("_n", "_step")
