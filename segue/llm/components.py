"""Connected components of a table of links, by contraction.

In each round every node takes the smallest id among itself and its neighbours, and then that one's; the links
are drawn between what is left.  A chain halves in each round and a star vanishes in one, so a few rounds are
enough for any table.  Each round is written, and nothing but the question whether links are left
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from segue.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b); component is the smallest id reachable from id."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.filter("a <> b").distinct(), "links")
    rounds = []
    while not edges.isEmpty():
        near = materialize(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        beyond = near.select(F.col("a").alias("p"), F.col("p").alias("root"))
        roots = materialize(near.join(beyond, "p").select(F.col("a").alias("id"), "root"), "roots")
        rounds.append(roots)
        left = edges.join(roots.select(F.col("id").alias("a"), F.col("root").alias("x")), "a")
        left = left.join(roots.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
        edges = materialize(left.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = rounds[0].withColumnRenamed("root", "component")
    for roots in rounds[1:]:
        step = roots.select(F.col("id").alias("component"), "root")
        found = found.join(step, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return found
