"""Global order: row numbers, dense ids, first-N, quantiles.

Everything that needs a position in a total order goes through `with_row_index`, which
sorts by range partitions, so no task ever holds the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def with_row_index(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """Add the 0-based position of every row in the given order; rows equal in it are in the order of their
    other columns.

    The sorted rows and their place inside their partition are written once, so the
    partition sizes and the rows always come from the same sort.  Only one offset per
    shuffle partition is broadcast, whatever the number of rows.  The order is a function of the
    rows alone, so a task that runs again deals its rows out as before.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    named = [k for k in order if isinstance(k, str)]
    keys += [F.col(c) for c in df.columns if c not in named]
    staged = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))),
        "row-index",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_part")
        .agg((F.max("_local") + 1).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return staged.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_local")).alias(name)
    )


def numbered(df: DataFrame, key: str, order: list[str | Column], name: str) -> DataFrame:
    """Number the rows of every key from 0 in the given order.

    The number is the position in the sorted table less the key's first position: a key with very many rows is
    spread over the sorted partitions instead of one task."""
    rows = with_row_index(df, [key, *order], "_row")
    first = rows.groupBy(key).agg(F.min("_row").alias("_first")).withColumnRenamed(key, "_key")
    joined = rows.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(*df.columns, (F.col("_row") - F.col("_first")).alias(name))


def dense_ids(*columns: DataFrame) -> DataFrame:
    """(value, id): id is the rank of the value among the sorted distinct values of all inputs."""
    values = columns[0].toDF("value")
    for other in columns[1:]:
        values = values.unionByName(other.toDF("value"))
    return with_row_index(values.dropna().distinct(), ["value"], "id")


def encode(df: DataFrame, ids: DataFrame, column: str, name: str) -> DataFrame:
    """Replace a column by its dense id."""
    pairs = ids.select(F.col("value").alias(column), F.col("id").alias(name))
    joined = df.join(pairs, column, "left")
    return joined.drop(column) if name != column else joined


def decode(df: DataFrame, ids: DataFrame, column: str, name: str) -> DataFrame:
    """Look the original value of a dense id up; an unknown id is null."""
    return df.join(ids.select(F.col("id").alias(column), F.col("value").alias(name)), column, "left")


def head_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an explicit order, without gathering them in one task."""
    return with_row_index(df, order, "_row").filter(F.col("_row") < n).drop("_row")


def popularity_order(freq: DataFrame, item: str = "track", count: str = "freq") -> DataFrame:
    """Items with their 1-based popularity rank; equal counts by item."""
    ranked = with_row_index(freq, [F.col(count).desc(), F.col(item)], "_row")
    return ranked.select(item, count, (F.col("_row") + 1).alias("rank"))


def _running_sum(ordered: DataFrame, value: str, slice_rows: int = 100_000) -> DataFrame:
    """Rows numbered by `i` with the sum of `value` over the rows before, as `from`.

    Summed in slices of bounded size; only one sum per slice meets the others."""
    cut = ordered.withColumn("_slice", F.floor(F.col("i") / slice_rows))
    slices = cut.groupBy("_slice").agg(F.sum(value).alias("_sum"))
    to_here = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select("_slice", F.coalesce(F.sum("_sum").over(to_here), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return cut.withColumn("_own", own).join(before, "_slice").withColumn("from", F.col("_before") + F.col("_own"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles (linear interpolation) and max as one row.

    Equal values are counted first, so a frequent value is one row of the sort."""
    present = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    total = present.agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    counts = with_row_index(present.groupBy("v").agg(F.count(F.lit(1)).alias("n")), ["v"], "i")
    sums = _running_sum(counts, "n")
    # The two neighbours of a quartile position are the values whose run of places holds them.
    n = total.first()["count"]
    spots = [(q, q * max(n - 1, 0)) for q in (0.25, 0.5, 0.75)]

    def value_at(place: int) -> Column:
        return F.max(F.when((F.col("from") <= place) & (F.col("from") + F.col("n") > place), F.col("v")))

    quartiles = sums.agg(*[
        (value_at(int(at)) + (value_at(math.ceil(at)) - value_at(int(at))) * (at - int(at))).alias(name)
        for (_, at), name in zip(spots, ("q25", "q50", "q75"))
    ])
    packed = quartiles.select(F.lit("all").alias("_k"), "*").join(total.select(F.lit("all").alias("_k"), "*"), "_k")
    return packed.select(F.lit(column).alias("column"), "count", "mean", "std", "min", "q25", "q50", "q75", "max")
