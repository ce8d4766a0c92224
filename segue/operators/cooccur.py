"""Co-occurrence of tracks in lists.

A cell is a distinct (list, track) with its multiplicity m.  Work always starts from the
seeds: seed cells meet the other cells of their lists, so only pairs that involve a wanted
seed exist.  The cells of a list meet its seed cells as a pack (see `packs`) and travel to the seed as one;
they are opened where they are summed, in as many tasks as their number asks for.  Long lists are
cut into pieces (see `skew`): their cells are spread over the pieces and only the few seed
cells are copied to each.  A seed with very many pairs is cut into parts by its tracks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.session import materialize
from segue.operators import skew
from segue.operators.packs import by_group, changes, deal_packs, encode, groups_of, opened, order_by, pack_rows, unpacked
from segue.operators.skew import copy_to_pieces, cut, heavy_keys, load_of, parts_of


@dataclass
class Cells:
    """(pid, track, piece, m) and the lists that were cut."""

    rows: DataFrame
    heavy: DataFrame


def cells_of(interactions: DataFrame, counted: bool = False, rows_per_piece: int | None = None) -> Cells:
    """Distinct cells; m is the number of repeats when `counted`.

    The cells are written once: the counts and both sides of the co-occurrence join read them."""
    if counted:
        rows = interactions.groupBy("pid", "track").agg(F.count(F.lit(1)).alias("m"))
    else:
        rows = interactions.select("pid", "track").distinct()
    staged = materialize(rows, "cells")
    heavy = heavy_keys(staged, "pid", rows_per_piece or skew.ROWS_PER_PIECE)
    return Cells(cut(staged, "pid", heavy, "track"), heavy)


def without_lists(cells: Cells, pids: DataFrame) -> Cells:
    """The cells of all other lists, read from the same stage."""
    return Cells(cells.rows.join(pids.select("pid").distinct(), "pid", "left_anti"), cells.heavy)


def of_lists(cells: Cells, pids: DataFrame) -> Cells:
    """The cells of these lists, read from the same stage."""
    return Cells(cells.rows.join(pids.select("pid").distinct(), "pid", "left_semi"), cells.heavy)


def list_counts(cells: Cells) -> DataFrame:
    """n: number of lists per track."""
    return cells.rows.groupBy("track").agg(F.count(F.lit(1)).alias("n"))


def seed_reach(seeds: DataFrame, cells: Cells) -> DataFrame:
    """(seed, reach): the cells of all lists of every distinct seed, an upper bound of its pairs; written once."""
    sizes = cells.rows.groupBy("pid").agg(F.count(F.lit(1)).alias("size"))
    wanted = cells.rows.join(seeds.select("track").distinct(), "track", "left_semi").select("pid", F.col("track").alias("seed"))
    return materialize(wanted.join(sizes, "pid").groupBy("seed").agg(F.sum("size").alias("reach")), "seed-reach")


@dataclass
class Packs:
    """Values of pairs: `rows` has the seed (and `test`, where values differ by it), a `part`, a number `a` of the seed, and a pack of
    tracks with `columns` numbers each; a pair's value is value(a, *numbers)."""

    rows: DataFrame
    by: list[str]
    columns: int
    value: Callable[..., np.ndarray]
    written: bool = False

    def staged(self) -> "Packs":
        return self if self.written else replace(self, rows=materialize(self.rows, "seed-values"), written=True)

    def pairs(self) -> DataFrame:
        """(by, part, track, v)"""
        value = self.value
        return unpacked(
            self.rows.drop("size"), self.columns, "track long, v double",
            lambda rows, row, track, *numbers: [track, value(rows.column("a").to_numpy()[row], *numbers)], drop=("a",),
        )


def plain_value(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return v.astype(np.float64)


def packs_of(pairs: DataFrame | Packs) -> Packs:
    """Rows (seed, track, v) or (test, seed, track, v), with a `part` where a seed is cut, as packs."""
    if isinstance(pairs, Packs):
        return pairs
    by = ["test", "seed"] if "test" in pairs.columns else ["seed"]
    if "part" not in pairs.columns:
        pairs = pairs.withColumn("part", F.lit(0))
    return Packs(pack_rows(pairs, [*by, "part"], ["v"]).withColumn("a", F.lit(0).cast("long")), by, 1, plain_value)


def _meet(starts: DataFrame, cells: Cells, rows: DataFrame, by: list[str], reach: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(by, part, a, size, pack): each of `starts` (pid, by, a, w) meets the cells (track, m, n) of its list; a pack of the key has (track, sum of w times
    m, n).  `by` names the seed; `asked` has a row (seed) for each key, where these are more than the seeds."""
    lists = pack_rows(rows.filter("pid IS NOT NULL"), ["pid", "piece"], ["m", "n"]).drop("size")
    sized = starts.join(reach, "seed").withColumn("parts", parts_of(F.col("reach"))).drop("reach")
    pairs = copy_to_pieces(sized, "pid", cells.heavy).join(lists, ["pid", "piece"]).select(*by, "parts", "a", "w", "pack")
    tasks, parts = load_of(reach if asked is None else asked.join(reach, "seed"), F.col("reach"))
    kinds = dict(pairs.dtypes)

    def step(table: pa.Table, heads: np.ndarray) -> pa.RecordBatch | None:
        row, (track, m, n) = opened(table.column("pack"), 2)
        group = groups_of(heads, table.num_rows)[row]
        order = order_by(group, track)
        group, track = group[order], track[order]
        first = changes(group, track)
        if not len(first):
            return None
        sums = np.add.reduceat(table.column("w").to_numpy()[row[order]] * m[order], first)
        group, track, n = group[first], track[first], n[order][first]
        ends = np.searchsorted(group, np.arange(len(heads) + 1))
        own = np.flatnonzero(np.diff(ends))
        made = [encode(track[low:high], sums[low:high], n[low:high]) for low, high in zip(ends[own], ends[own + 1])]
        keys = [table.column(c).combine_chunks().take(pa.array(heads[own])) for c in (*by, "part", "a")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(ends)[own]), pa.array(made, pa.binary())], [*by, "part", "a", "size", "pack"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["part int, a long, size long, pack binary"])
    return deal_packs(pairs, by, 2, tasks, parts).mapInArrow(by_group([*by, "part"], step), schema)


def cooccurrence_packs(seeds: DataFrame, cells: Cells, counts: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(seed, part, a, size, pack) for every distinct seed: a is its number of lists; the pack has the tracks that share a list with it (itself
    included), in how many lists, and their own numbers of lists."""
    reach = seed_reach(seeds, cells) if reach is None else reach
    sized = cells.rows.join(counts, "track").withColumn("m", F.lit(1).cast("long"))
    starts = sized.join(seeds.select("track").distinct(), "track", "left_semi").select(
        "pid", F.col("track").alias("seed"), F.col("n").alias("a"), F.lit(1).cast("long").alias("w")
    )
    return _meet(starts, cells, sized, ["seed"], reach)


def seed_cooccurrence(seeds: DataFrame, cells: Cells, counts: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(seed, part, track, c, n_seed, n_track): lists that hold both, for every distinct seed and each
    track that shares a list with it (itself included)."""
    packs = cooccurrence_packs(seeds, cells, counts, reach).drop("size").withColumnRenamed("a", "n_seed")
    rows = unpacked(packs, 2, "track long, c long, n_track long", lambda rows, row, track, c, n: [track, c, n])
    return rows.select("seed", "part", "track", "c", "n_seed", "n_track")


def _mark(track: str) -> Column:
    """Two bytes of a track's hash: they tell in a list which tracks may be asked for."""
    return (F.pmod(F.xxhash64(track), F.lit(65_536)) - 32_768).cast("short")


def pair_similarity(pairs: DataFrame, cells: Cells, a: float = 0.1, q: float = 0.5) -> DataFrame:
    """Asymmetric cosine of given pairs (s, u): (c / (n_s^a n_u^(1-a)))^q, 0 without overlap.

    Each pair is looked up in the lists of its rarer track, so a track that most lists hold costs no more than its
    partners.  The partners of a track travel to its lists as an array of two-byte marks; a list gives out those of its tracks
    that have one of the marks, and the join with the pairs leaves the pairs that were asked for."""
    counts = list_counts(cells)
    wanted = (
        pairs.select("s", "u").distinct()
        .join(counts.select(F.col("track").alias("s"), F.col("n").alias("n_s")), "s", "left")
        .join(counts.select(F.col("track").alias("u"), F.col("n").alias("n_u")), "u", "left")
        .fillna(0, subset=["n_s", "n_u"])
    )
    s_rarer = F.col("n_s") <= F.col("n_u")
    probes = wanted.select(
        "s", "u", "n_s", "n_u", F.when(s_rarer, F.col("s")).otherwise(F.col("u")).alias("rare"),
        F.when(s_rarer, F.col("u")).otherwise(F.col("s")).alias("track"),
    )
    probes = materialize(probes, "probes")
    heavy = heavy_keys(probes, "rare")
    asked = cut(probes, "rare", heavy, "track").groupBy("rare", "piece").agg(F.collect_set(_mark("track")).alias("asked"))
    lists = cells.rows.select(F.col("track").alias("rare"), "pid")
    sent = copy_to_pieces(lists, "rare", heavy).join(asked, ["rare", "piece"]).select("pid", "rare", F.col("piece").alias("of"), "asked")
    known = cells.rows.filter("pid IS NOT NULL AND track IS NOT NULL").groupBy("pid", "piece").agg(
        F.collect_list(F.struct("track", _mark("track").alias("mark"))).alias("known")
    )
    met = copy_to_pieces(sent, "pid", cells.heavy).join(known, ["pid", "piece"])
    found = met.select("rare", "of", "asked", F.inline("known")).filter(F.array_contains("asked", F.col("mark")))
    both = found.groupBy("rare", "of", "track").agg(F.count(F.lit(1)).alias("c"))
    scale = F.pow("n_s", F.lit(a)) * F.pow("n_u", F.lit(1 - a))
    sim = F.pow(F.try_divide(F.col("c"), scale), F.lit(q))
    own = cut(probes, "rare", heavy, "track").withColumnRenamed("piece", "of")
    return own.join(both, ["rare", "of", "track"], "left").select("s", "u", F.coalesce(sim, F.lit(0.0)).alias("sim"))


# Fixed values of the counted-matrix features.
ALPHA, BETA, THETA, SMOOTH = 0.9, 0.7, 0.99, 0.1


def row_sums(cells: Cells) -> DataFrame:
    """I of a track: all its rows, repeats included."""
    return cells.rows.groupBy("track").agg(F.sum("m").alias("i_song"))


def list_sums(cells: Cells) -> DataFrame:
    """I of a list: all its rows."""
    return cells.rows.groupBy("pid").agg(F.sum("m").alias("i_list"))


def _scaled(cells: Cells) -> DataFrame:
    """Cells with n, all rows of their track, which scale it as a seed and as a candidate."""
    return cells.rows.join(row_sums(cells).withColumnRenamed("i_song", "n"), "track").select("pid", "piece", "track", "m", "n")


def _scaled_value(alpha: float, a: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A sum scaled by the sizes of its seed and of its track."""
    return s * (SMOOTH + a) ** -alpha * (SMOOTH + n) ** (alpha - 1)


def normalised_packs(seeds: DataFrame, cells: Cells, alpha: float = ALPHA) -> Packs:
    """For every distinct seed the co-occurrence scaled by both tracks' sizes."""
    scaled = _scaled(cells)
    starts = scaled.join(seeds.select("track").distinct(), "track", "left_semi").select(
        "pid", F.col("track").alias("seed"), F.col("n").alias("a"), F.col("m").alias("w")
    )
    return Packs(_meet(starts, cells, scaled, ["seed"], seed_reach(seeds, cells)), ["seed"], 2, partial(_scaled_value, alpha))


def normalised_features(seeds: DataFrame, cells: Cells, alpha: float = ALPHA) -> DataFrame:
    """(seed, part, track, v) of `normalised_packs`."""
    return normalised_packs(seeds, cells, alpha).pairs()


def _seed_cells(seeds: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of every test list's distinct seeds: (test, seed, pid, ...) with the columns of `rows`.

    A popular seed has many test lists and many cells; its test lists are spread over pieces."""
    wanted = seeds.select(F.col("pid").alias("test"), F.col("track").alias("seed")).distinct()
    wanted = materialize(wanted, "wanted")
    heavy = heavy_keys(wanted, "seed")
    left = cut(wanted, "seed", heavy, "test")
    cells = rows.withColumnsRenamed({"track": "seed", "m": "m_seed"}).drop("piece")
    return left.join(copy_to_pieces(cells, "seed", heavy), ["seed", "piece"]).drop("piece")


def _weight(shared: Column, beta: float, theta: float) -> Column:
    """Weight of a training list from its shared rows and its size."""
    return F.pow(shared * F.pow(F.lit(SMOOTH) + F.col("i_list"), F.lit(beta - 1)), F.lit(theta))


def list_weights(seeds: DataFrame, cells: Cells, beta: float = BETA, theta: float = THETA) -> DataFrame:
    """(test, pid, w): how much a training list counts for a test list."""
    hits = _seed_cells(seeds, cells.rows).groupBy("test", "pid").agg(F.sum("m_seed").alias("shared"))
    return hits.join(list_sums(cells), "pid").select("test", "pid", _weight(F.col("shared"), beta, theta).alias("w"))


def weighted_packs(
    seeds: DataFrame, cells: Cells, alpha: float = ALPHA, beta: float = BETA, theta: float = THETA
) -> Packs:
    """As `normalised_packs` for each list and seed, each shared list weighted for the test list."""
    scaled = _scaled(cells)
    hits = _seed_cells(seeds, scaled.join(list_sums(cells), "pid"))
    # Seeds that one training list shares with one test list.
    shared = F.sum("m_seed").over(Window.partitionBy("test", "pid"))
    starts = hits.withColumn("w", _weight(shared, beta, theta)).select(
        "test", "pid", "seed", F.col("n").alias("a"), (F.col("m_seed") * F.col("w")).alias("w")
    )
    reach = seed_reach(seeds, cells)
    asked = seeds.select("pid", F.col("track").alias("seed")).distinct()
    return Packs(_meet(starts, cells, scaled, ["test", "seed"], reach, asked), ["test", "seed"], 2, partial(_scaled_value, alpha))


def weighted_features(
    seeds: DataFrame, cells: Cells, alpha: float = ALPHA, beta: float = BETA, theta: float = THETA
) -> DataFrame:
    """(test, seed, part, track, v) of `weighted_packs`."""
    return weighted_packs(seeds, cells, alpha, beta, theta).pairs()
