"""Helpers to add columns to whole rows from Arrow batches, and the common hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOLD_OUT_REMAINDER = 2


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2.  A null id counts as ''."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == HOLD_OUT_REMAINDER


def with_row(docs: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """The row, or its columns `keep`, as one struct `row`, beside the named columns: no name of the input can
    clash with ours."""
    return docs.select(F.struct(*(keep or ["*"])).alias("row"), *[c.alias(n) for n, c in columns.items()])
