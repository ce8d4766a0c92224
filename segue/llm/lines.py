"""Lines that many documents of one host share, shared by the line operators.

The lines over a share fit one row of their host: the shares of all lines of a host sum to its mean number of
distinct lines, so at most `mean lines / max_share` lines can lie above `max_share`.  Lines over a count have no
such bound and stay a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from segue.session import materialize


def lines_over(rows: DataFrame, max_share: float, min_rows: int, max_rows: int | None = None) -> DataFrame:
    """(host, line): hashes of the lines in over `max_share` of a host's rows and in `min_rows` at least, or in
    over `max_rows` of them, whatever the share.

    `rows` has host and keys, the distinct line hashes of each row.  Counts are summed before the shuffle,
    and the rows of a host only meet as sums.  A null host has no lines in common with anything.
    """
    known = rows.filter(F.col("host").isNotNull())
    totals = known.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = known.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    least = min_rows if max_rows is None else min(min_rows, max_rows + 1)
    over = (F.col("n") >= min_rows) & (F.col("n") > max_share * F.col("total"))
    if max_rows is not None:
        over |= F.col("n") > max_rows
    return counts.filter(F.col("n") >= least).join(totals, "host").filter(over).select("host", "line")


def frequent_lines(rows: DataFrame, max_share: float, min_rows: int) -> DataFrame:
    """(host, frequent): the lines in over `max_share` of a host's different pages and in `min_rows` of them at least, as
    one row for each host that has any.

    `rows` has host, keys and copies, some names of the page by independent sketches, each of which copies of a page mostly
    share.  Pages of one name count once; of the counts by the sketches the largest holds, as a line that is a page's name itself
    hides the pages that share it.  Lines on fewer rows are left out by plain counts, summed before the
    shuffle; only the others are counted by name."""
    known = rows.filter(F.col("host").isNotNull())
    named = known.select("host", F.posexplode("copies").alias("sketch", "copy"))
    totals = named.groupBy("host", "sketch").agg(F.count_distinct("copy").alias("n")).groupBy("host").agg(F.max("n").alias("total"))
    counts = known.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    able = counts.filter(F.col("n") >= min_rows).join(totals, "host").filter(F.col("n") > max_share * F.col("total"))
    able = materialize(able.select("host", "line", "total"), "able-lines")
    each = known.select("host", "copies", F.explode("keys").alias("line")).join(able, ["host", "line"])
    different = each.select("host", "line", "total", F.posexplode("copies").alias("sketch", "copy")).distinct()
    found = different.groupBy("host", "line", "sketch", "total").agg(F.count(F.lit(1)).alias("n"))
    over = found.groupBy("host", "line", "total").agg(F.max("n").alias("n"))
    over = over.filter((F.col("n") >= min_rows) & (F.col("n") > max_share * F.col("total")))
    # Written, so that the join with the documents knows its size before any text is moved.
    return materialize(over.groupBy("host").agg(F.collect_list("line").alias("frequent")), "frequent-lines")
