"""Hash-based sampling that gives the same rows however the data is partitioned."""

from pyspark.sql import Column, functions as F


def stable_hash(*cols: Column | str, seed: int = 0) -> Column:
    """Hex digest of the values; evenly spread, the same on every engine that has md5."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_below(ratio: float, *cols: Column | str, seed: int = 0) -> Column:
    """True for the given share of keys."""
    if ratio >= 1:
        return F.lit(True)
    return stable_hash(*cols, seed=seed) < F.lit(format(round(ratio * 2**32), "08x"))
