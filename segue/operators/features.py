"""Candidate features.  Candidates are (pid, track, cf_prob), at most the retrieval depth per list."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from segue.functions.similarity import edit_similarity
from segue.operators.packs import by_group, encode, groups_of, opened, unpacked
from segue.operators.rank import SCORE_UNITS
from segue.operators.windows import as_arrays, as_table, sum_rows
from segue.session import materialize


def explode_scored(wide: DataFrame) -> DataFrame:
    """(pid, pred[], scores[]) to one row per candidate."""
    zipped = F.arrays_zip(F.col("pred").alias("track"), F.col("scores").alias("cf_prob"))
    return wide.select("pid", F.inline(zipped))


def label_candidates(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """1 for candidates that are in the list's hidden items, else 0."""
    hits = truth.select("pid", "track").distinct().withColumn("label", F.lit(1))
    return candidates.join(hits, ["pid", "track"], "left").fillna(0, subset=["label"])


def group_mean(candidates: DataFrame, score: str = "cf_prob") -> DataFrame:
    return candidates.groupBy("pid").agg(F.avg(score).alias("cf_avg_prob"))


def relative_score(candidates: DataFrame, score: str = "cf_prob") -> DataFrame:
    """Score over the list's mean score."""
    joined = candidates.join(group_mean(candidates, score), "pid")
    return joined.withColumn("cf_rlt_prob", F.try_divide(F.col(score), F.col("cf_avg_prob"))).drop("cf_avg_prob")


def add_popularity(candidates: DataFrame, freq: DataFrame) -> DataFrame:
    return candidates.join(freq.select("track", "freq"), "track", "left")


def add_item_attrs(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Artist, album and the three names; a candidate that is not in the catalogue is an error."""
    joined = candidates.join(items.withColumn("_known", F.lit(True)), "track", "left")
    missing = F.raise_error(F.concat(F.lit("no item for track "), F.col("track").cast("string")))
    kind = dict(candidates.dtypes)["track"]
    track = F.when(F.col("_known"), F.col("track")).otherwise(missing.cast(kind))
    return joined.withColumn("track", track).drop("_known")


def add_title(candidates: DataFrame, lists: DataFrame) -> DataFrame:
    return candidates.join(lists.select("pid", "clean"), "pid", "left")


def name_similarities(named: DataFrame) -> DataFrame:
    """Similarity of the list's title with track, album and artist name."""
    return named.withColumns({
        "name_sim": edit_similarity("track_name", "clean"),
        "album_sim": edit_similarity("album_name", "clean"),
        "artist_sim": edit_similarity("artist_name", "clean"),
    })


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(key, unit) with vectors scaled to length one; zero vectors are left out."""
    cast = vectors.select(vectors.columns[0], F.col("vector").cast("array<double>").alias("v")).toDF("key", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return cast.withColumn("n", norm).filter(F.col("n") > 0).select(
        "key", F.transform("v", lambda x: x / F.col("n")).alias("unit")
    )


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def item_units(embeddings: dict[str, tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """(track, one unit vector per embedding).  `embeddings` maps a name to (vectors, keys); keys maps track to the
    key of the vectors (album, artist), without it the track is the key."""
    table = None
    for name, (vectors, keys) in embeddings.items():
        units = unit_vectors(vectors).withColumnRenamed("unit", name)
        if keys is None:
            own = units.withColumnRenamed("key", "track")
        else:
            own = keys.toDF("track", "key").join(units, "key").drop("key")
        table = own if table is None else table.join(own, "track", "full")
    return table


# Bytes of vectors on one side of a block, candidates of a block, and candidates that are multiplied at once.
SIDE_BYTES, PAIRS_PER_BLOCK, PAIR_CHUNK = 256_000_000, 1_000_000, 20_000


def item_vectors(embeddings: dict[str, tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """(track, one vector per embedding) as `item_units`, in the numbers that the vectors come in: floats stay floats."""
    table = None
    for name, (vectors, keys) in embeddings.items():
        key = vectors.columns[0]
        kind = "array<float>" if dict(vectors.dtypes)["vector"] == "array<float>" else "array<double>"
        norm = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
        own = vectors.filter(norm > 0).select(F.col(key).alias("key"), F.col("vector").cast(kind).alias(name))
        own = own.withColumnRenamed("key", "track") if keys is None else keys.toDF("track", "key").join(own, "key").drop("key")
        table = own if table is None else table.join(own, "track", "full")
    return table


def _units(column, size: int) -> np.ndarray:
    """Arrays as rows of length one."""
    table = as_table(column, size).astype(np.float64)
    return table / np.sqrt(np.einsum("ij,ij->i", table, table))[:, None]


def _unit_sums(size: int):
    """(key, row): the sum of the units of each key of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = (pa.RecordBatch.from_arrays([b.column("key"), as_arrays(_units(b.column("row"), size))], ["key", "row"]) for b in batches)
        yield from sum_rows(size)(units)

    return run


def _similarities(names: list[str], columns: list[str]):
    """The candidates of one block with the products of their list's and their track's vectors; a track that has several
    rows of vectors gives as many rows."""

    def found(asked: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(asked, value_set=known, skip_nulls=True), -1).to_numpy()

    def run(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        out, rows = pairs.select(columns), np.arange(pairs.num_rows)
        if not sent.num_rows:
            for name in names:
                out = out.append_column(name, pa.array(np.zeros(len(rows))))
            return out
        items, lists = sent.filter(pc.is_valid(sent["_track"])), sent.filter(pc.is_valid(sent["_pid"]))
        at, to = np.full(len(rows), -1), found(pairs["pid"], lists["_pid"].combine_chunks())
        if items.num_rows:
            tracks = items["_track"].combine_chunks().dictionary_encode()
            code, own = tracks.indices.to_numpy(), found(pairs["track"], tracks.dictionary)
            copies, order = np.bincount(code), np.argsort(code, kind="stable")
            times = np.where(own >= 0, copies[own], 1)
            rows = np.repeat(rows, times)
            copy = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            own, to = own[rows], to[rows]
            place = np.where(own >= 0, (np.cumsum(copies) - copies)[own] + copy, 0)
            at = np.where(own >= 0, order[place], -1)
            out = out.take(pa.array(rows))
        for name in names:
            value = np.zeros(len(rows))
            has, mean_of = (pc.is_valid(c).to_numpy() for c in (items[name], lists[f"_{name}"]))
            both = np.flatnonzero((at >= 0) & (to >= 0))
            both = both[has[at[both]] & mean_of[to[both]]]
            if len(both):
                means = lists[f"_{name}"].drop_null()
                size = len(means[0])
                units, means = _units(items[name].drop_null(), size), as_table(means, size)
                a, b = (np.cumsum(has) - 1)[at], (np.cumsum(mean_of) - 1)[to]
                for low in range(0, len(both), PAIR_CHUNK):
                    part = both[low : low + PAIR_CHUNK]
                    value[part] = np.einsum("ij,ij->i", units[a[part]], means[b[part]])
            out = out.append_column(name, pa.array(value))
        return out

    return run


def sides(pairs: int, item_bytes: int, list_bytes: int, parallelism: int) -> tuple[int, int]:
    """(sides by track, sides by list) of a grid of blocks: the vectors of a side fit a task, a block has about
    `PAIRS_PER_BLOCK` candidates, and the fewest bytes are sent: an item goes to all sides by list, a list to all by track."""
    blocks = max(parallelism, math.ceil(pairs / PAIRS_PER_BLOCK))
    by_list = max(1, math.ceil(list_bytes / SIDE_BYTES))
    by_item = max(1, math.ceil(item_bytes / SIDE_BYTES), round(math.sqrt(blocks * max(item_bytes, 1) / max(list_bytes, 1))))
    by_item = min(by_item, max(math.ceil(blocks / by_list), math.ceil(item_bytes / SIDE_BYTES), 1))
    return by_item, max(by_list, math.ceil(blocks / by_item))


def add_embeddings(candidates: DataFrame, seeds: DataFrame, embeddings: dict[str, tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """For each embedding the mean cosine between a candidate and the seeds of its list; a missing vector counts 0.

    The mean over seeds of a dot product is the dot product with the mean seed vector, so each
    list is summed to one vector per embedding and no candidate-seed pair is formed.  The candidates lie in a grid of blocks by
    hashes of track and list, and the vectors travel to the blocks that have a candidate of theirs: a vector
    is sent once for each block and not for each candidate, see `sides`."""
    names, columns = list(embeddings), candidates.columns
    items = materialize(item_vectors(embeddings), "item-vectors")
    asked = seeds.select("pid", "track").filter("pid IS NOT NULL")
    copies = items.groupBy("track").agg(F.count(F.lit(1)).alias("_n"))  # a seed counts once for each row of vectors
    profile = asked.join(copies, "track", "left").groupBy("pid").agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_k"))
    rows, floats = asked.join(items, "track"), dict(items.dtypes)
    key = dict(asked.dtypes)["pid"]
    size = {name: (items.filter(F.col(name).isNotNull()).select(F.size(name)).first() or [0])[0] for name in names}
    for name in names:
        own = rows.filter(F.col(name).isNotNull()).select(F.col("pid").alias("key"), F.col(name).alias("row"))
        total = own.repartition("key").sortWithinPartitions("key").mapInArrow(_unit_sums(size[name]), f"key {key}, row array<double>")
        mean = F.transform("row", lambda x: x / F.col("_k"))
        profile = profile.join(total.withColumnRenamed("key", "pid"), "pid", "left").withColumn(f"_{name}", mean).drop("row")
    profile = materialize(profile.drop("_k"), "list-profiles")
    staged = materialize(candidates, "candidates")
    wide = sum(size[name] * (4 if floats[name] == "array<float>" else 8) for name in names)
    by_item, by_list = sides(
        staged.count(), items.count() * wide, profile.count() * 8 * sum(size.values()), staged.sparkSession.sparkContext.defaultParallelism
    )
    item_side = F.pmod(F.xxhash64("track", F.lit(3)), F.lit(by_item)).cast("int")
    block = (item_side * by_list + F.pmod(F.xxhash64("pid", F.lit(3)), F.lit(by_list))).cast("int").alias("_block")
    pairs = staged.select(block, "*")

    def sent(vectors: DataFrame, key: str) -> DataFrame:
        blocks = pairs.select(key, "_block").distinct().groupBy(key).agg(F.collect_set("_block").alias("_blocks"))
        met = vectors.join(blocks, key).withColumn("_block", F.explode("_blocks")).drop("_blocks")
        return met.withColumnRenamed(key, f"_{key}")

    both = sent(items, "track").unionByName(sent(profile, "pid"), allowMissingColumns=True)
    schema = StructType([*staged.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    return pairs.groupBy("_block").cogroup(both.groupBy("_block")).applyInArrow(_similarities(names, columns), schema)


def seed_similarity(candidates: DataFrame, seeds: DataFrame, vectors: DataFrame, name: str,
                    keys: DataFrame | None = None) -> DataFrame:
    """`add_embeddings` with one embedding."""
    return add_embeddings(candidates, seeds, {name: (vectors, keys)})


# Block sizes of the exact nearest-neighbour search: an item is sent to each block of queries, a query and its k rows to and from each
# block of items.  Few queries are in smaller blocks, so that all cores have one.  Scores held at once by a task.
ITEM_BLOCK, QUERY_BLOCK, FEW_QUERIES, SCORES_AT_ONCE = 200_000, 10_000, 1_000, 6_400_000


def query_blocks_for(asked: int, parallelism: int) -> int:
    """Number of blocks of so many queries."""
    return max(1, math.ceil(asked / QUERY_BLOCK), min(math.ceil(asked / FEW_QUERIES), parallelism))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 500) -> DataFrame:
    """(pid, query, track, score, rank): the k items nearest to each list's query item, exactly.

    Items and queries are hashed into blocks of bounded size, in the numbers that they come in; a task multiplies one pair of
    blocks and returns a pack of k tracks per query (see `packs`).  The packs of a query are merged into one, which becomes rows where it
    meets the lists that ask for it."""
    units = materialize(item_vectors({"row": (vectors, None)}).withColumnRenamed("track", "key"), "units")
    at_once, kind = SCORES_AT_ONCE, dict(queries.dtypes)["query"]
    asked = materialize(queries.select(F.col("query").alias("key")).distinct(), "asked")
    item_blocks = max(1, math.ceil(units.count() / ITEM_BLOCK))
    query_blocks = query_blocks_for(asked.count(), units.sparkSession.sparkContext.defaultParallelism)

    def blocks(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("key"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        )

    items = blocks(units, "ib", item_blocks, "qb", query_blocks)
    wanted = blocks(units.join(asked, "key", "left_semi"), "qb", query_blocks, "ib", item_blocks)
    wanted = wanted.select("qb", "ib", F.col("key").alias("query"), F.col("row").alias("query_row"))

    def nearest(q: pa.Table, i: pa.Table) -> pa.Table:
        found, packs = [], []
        if q.num_rows and i.num_rows:
            size = len(i["row"][0])
            matrix, units_asked, asked = _units(i["row"], size), _units(q["query_row"], size), q["query"].to_numpy()
            none = pc.is_null(i["key"]).to_numpy()
            keys, batch = pc.fill_null(i["key"], 0).to_numpy(), max(1, at_once // i.num_rows)
            for start in range(0, len(asked), batch):
                scores = np.floor(units_asked[start:start + batch] @ matrix.T * SCORE_UNITS + 0.5)
                for query, score in zip(asked[start:start + batch], scores):
                    other = np.flatnonzero((keys != query) | none)
                    if len(other) > k:
                        # Everything down to the k-th score, ties with it included.
                        limit = np.partition(score[other], len(other) - k)[len(other) - k]
                        other = other[score[other] >= limit]
                    best = other[np.lexsort((keys[other], -score[other]))[:k]]
                    found.append(query)
                    packs.append(_pack(keys[best], score[best], none[best]))
        return pa.table({"query": pa.array(found, pa.int64()), "pack": pa.array(packs, pa.binary())})

    partial = wanted.groupBy("qb", "ib").cogroup(items.groupBy("qb", "ib")).applyInArrow(nearest, "query bigint, pack binary")

    def merge(table: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        row, (track, score, none) = opened(table.column("pack"), 2)
        group = groups_of(heads, table.num_rows)[row]
        order = np.lexsort((track, 1 - none, -np.where(np.isnan(score), np.inf, score), group))
        place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        order, place = order[place < k], place[place < k]
        ends = np.searchsorted(group[order], np.arange(len(heads) + 1))
        made = [_pack(*(c[order[low:high]] for c in (track, score - SCORE_SHIFT, none)), place[low:high] + 1) for low, high in zip(ends, ends[1:])]
        return pa.RecordBatch.from_arrays([table.column("query").combine_chunks().take(pa.array(heads)), pa.array(made, pa.binary())], ["query", "pack"])

    best = partial.repartition("query").sortWithinPartitions("query").mapInArrow(by_group(["query"], merge), "query bigint, pack binary")
    lists = queries.select("pid", "query").join(best.withColumn("query", F.col("query").cast(kind)), "query")
    return unpacked(lists, 3, "track long, score double, rank int", lambda rows, row, track, score, none, place: [
        pa.array(track, mask=none == 1), (score - SCORE_SHIFT) / SCORE_UNITS, place.astype(np.int32)
    ])


SCORE_SHIFT = 2 * int(SCORE_UNITS)  # cosines in whole units, moved over zero


def _pack(track: np.ndarray, score: np.ndarray, none: np.ndarray, *more: np.ndarray) -> bytes:
    """Tracks with their cosines in units; a row of a null track is marked."""
    order = np.argsort(track, kind="stable")
    moved = score[order] + SCORE_SHIFT
    return encode(track[order], moved if np.isnan(moved).any() else moved.astype(np.int64), none[order].astype(np.int64), *[m[order] for m in more])


def truth_without_query(interactions: DataFrame, queries: DataFrame) -> DataFrame:
    """The hidden items of a nearest-neighbour run: all rows of the asked lists but those of the query track."""
    rows = interactions.select("pid", "pos", "track").join(queries.select("pid", "query"), "pid")
    return rows.filter("track <> query").drop("query")


def first_with_vector(interactions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pid, query): the first track of a list that has a vector."""
    known = interactions.join(vectors.select("track"), "track", "left_semi")
    return known.groupBy("pid").agg(F.min(F.struct("pos", "track"))["track"].alias("query"))


NAME_COLUMNS = ["name_sim", "album_sim", "artist_sim"]


def feature_table(candidates: DataFrame, truth: DataFrame | None, seeds: DataFrame, items: DataFrame,
                  lists: DataFrame, freq: DataFrame | None, embeddings: dict[str, tuple[DataFrame, DataFrame | None]],
                  names: bool = True) -> DataFrame:
    """All features of the candidates (pid, track, cf_prob).

    `embeddings` maps a column name to (vectors, keys); `freq` and `names` are left out for the
    sub-tasks that do not use them.  What hangs on the track is put together on the item side first, and what hangs on the list
    meets the candidates in one place.  They are written first, as their list's mean is taken from them too."""
    rows = relative_score(materialize(candidates.select("pid", "track", "cf_prob"), "retrieved"))
    if names:
        rows = add_title(rows, lists)
    if truth is not None:
        rows = label_candidates(rows, truth)
    if freq is not None:
        items = add_popularity(items, freq).fillna(0, subset=["freq"])
    rows = add_item_attrs(rows, items)
    if names:
        rows = name_similarities(rows).drop("clean")
        rows = rows.select("pid", "track", *[c for c in rows.columns if c not in ("pid", "track")])
    rows = rows.drop("track_name", "album_name", "artist_name")
    return add_embeddings(rows, seeds, embeddings) if embeddings else rows
