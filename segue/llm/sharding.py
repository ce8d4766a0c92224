"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group.  Groups are placed by falling size, each into the shard where the dot product of
its (bytes, tokens, rows) with the shard's residual capacity is highest.  Each partition of groups has its
own share of every shard's capacity, so the placing is spread over the cluster and the shards come out
as even as the sum of many small parts.  A group above a fraction of a shard is cut into parts first; by
counting there are only few of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from segue.session import materialize

SHARDS = 16
PARTS_PER_SHARD = 256  # no unit holds more than this fraction of a shard's bytes or rows
UNITS_PER_PARTITION = 40_000
ROWS_PER_SLICE = 50_000
WEIGHTS = (64.0, 2.0, 1.0)  # bytes, tokens, rows


def greedy(units: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of each unit, placed in the order given; units: one row of (bytes, tokens, rows) each."""
    total = units.sum(axis=0)
    share = units / np.where(total > 0, total, 1)
    left = np.full((shards, units.shape[1]), 1.0 / shards)
    weighted = share * np.asarray(weights)
    out = np.empty(len(units), np.int32)
    for i in range(len(units)):
        out[i] = best = int((left @ weighted[i]).argmax())
        left[best] -= share[i]
    return out


def _place(shards: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)  # bounded by UNITS_PER_PARTITION, as the caller cuts the partitions
        if not held:
            return
        units = pd.concat(held, ignore_index=True).sort_values(
            ["bytes", "tokens", "key", "check", "part"], ascending=[False, False, True, True, True]
        )
        # The shard that takes the last crumb differs from partition to partition.
        turn = int(abs(units["key"].iloc[0])) % shards
        placed = greedy(units[["bytes", "tokens", "rows"]].to_numpy(float), shards)
        yield units[["key", "check", "part"]].assign(shard=((placed + turn) % shards).astype("int32"))

    return run


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    units_per_partition: int = UNITS_PER_PARTITION, parts_per_shard: int = PARTS_PER_SHARD,
) -> DataFrame:
    """(id, size, tokens, text_crc32, shard, slot) for every row of `docs`.

    size: UTF-8 bytes of the text and one; tokens: its blanks and one.  slot numbers the rows of a shard from 0
    without a gap.  A null text counts as no bytes and goes with the empty texts; repeated rows are rows of
    one group; ids may be null or repeat.  Of shards that fit equally well the first
    takes a group.  Very long texts are only measured and hashed.  An empty table gives an empty result.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("check"), F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ), "shard-rows")
    groups = rows.groupBy("key", "check").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    sums = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    most_bytes = max(1, (sums["bytes"] or 0) // (shards * parts_per_shard))
    most_rows = max(1, sums["rows"] // (shards * parts_per_shard))
    # A cut group holds over 1/(shards * parts) of all bytes or rows and has two rows at least, so there are at
    # most 2 * shards * parts_per_shard of them.
    parts = F.least(F.ceil(F.greatest(F.col("bytes") / most_bytes, F.col("rows") / most_rows)), F.col("rows"))
    cut = groups.withColumn("parts", parts.cast("int")).filter(
        (F.col("rows") > 1) & ((F.col("bytes") > most_bytes) & (F.col("bytes") > 4096) | (F.col("rows") > F.lit(max(most_rows, 16))))
    ).select("key", "check", "parts")
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")
    in_units = rows.join(F.broadcast(cut), ["key", "check"], "left").withColumn("part", part).drop("parts")
    units = materialize(in_units.groupBy("key", "check", "part").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
    ), "shard-units")
    n = max(1, -(-units.count() // units_per_partition))
    placed = units.repartition(n, "key", "check", "part").mapInPandas(
        _place(shards), "key long, check long, part int, shard int"
    )
    slices = max(1, -(-sums["rows"] // (shards * ROWS_PER_SLICE)))
    with_shard = materialize(
        in_units.join(placed, ["key", "check", "part"])
        .withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")),
        "shard-placed",
    )
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = with_shard.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")
    )
    inside = Window.partitionBy("shard", "slice").orderBy("row")
    return with_shard.withColumn("at", F.row_number().over(inside)).join(starts, ["shard", "slice"]).select(
        F.col("id").alias(id_col), "size", "tokens", F.col("check").alias("text_crc32"), "shard",
        (F.col("from") + F.col("at") - 1).alias("slot"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict = {}
