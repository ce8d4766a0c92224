"""The list tables as views of the star schema.

A customer is a list, its order lines are the list's rows, parts are the tracks: brand is the
artist, type is the album.  The position is the order number and the line within it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from segue.functions.titles import clean_title
from segue.operators.order import dense_ids, encode, numbered
from segue.session import materialize, stage_path
from segue.operators.splits import first_items, split_lists, split_prefix


@dataclass
class Tables:
    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def interactions(self) -> DataFrame:
        """(pid, pos, track) of every order line."""
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
        lines = self.read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("track"))
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select("pid", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), "track")

    @cached_property
    def orders_as_lists(self) -> DataFrame:
        """(pid, file_pos, pos, track): every order as a short list."""
        line = self.read("lineitem")
        return line.select(
            F.col("l_orderkey").alias("pid"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("file_pos"),
            F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("track"),
        )

    @cached_property
    def lists(self) -> DataFrame:
        """(pid, name, clean): no title below a zero balance, one part below 5000, else two."""
        nation = self.read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        customer = self.read("customer").join(nation, "c_nationkey")
        name = (
            F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
            .when(F.col("c_acctbal") < 5000, F.col("c_mktsegment"))
            .otherwise(F.concat_ws(" ", "c_mktsegment", "n_name"))
        )
        return customer.select(F.col("c_custkey").alias("pid"), name.alias("name")).withColumn(
            "clean", clean_title("name")
        )

    @cached_property
    def sized_lists(self) -> DataFrame:
        """Lists with num_tracks, and the seed count a test list of that length gets."""
        sizes = self.interactions.groupBy("pid").agg(F.count(F.lit(1)).alias("num_tracks"))
        n = F.col("num_tracks")
        samples = (
            F.when(n < 20, 0).when(n < 30, 1).when(n < 40, 5).when(n < 50, 10).when(n < 90, 25).otherwise(100)
        )
        return self.lists.join(sizes, "pid").withColumn("num_samples", samples)

    @cached_property
    def items(self) -> DataFrame:
        part = self.read("part")
        return part.select(
            F.col("p_partkey").alias("track"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"),
            F.col("p_name").alias("track_name"), F.col("p_type").alias("album_name"),
            F.col("p_brand").alias("artist_name"),
        )

    @cached_property
    def encoded_items(self) -> DataFrame:
        """Items with album and artist as dense ids."""
        items = self.items
        for column in ("album", "artist"):
            items = encode(items, dense_ids(items.select(column)), column, f"{column}_id").withColumnRenamed(
                f"{column}_id", column
            )
        return materialize(items, "items")

    @cached_property
    def split(self) -> DataFrame:
        """Interactions with the 80/20 mark of their list."""
        return split_lists(self.interactions)

    @cached_property
    def train(self) -> DataFrame:
        return self.split.filter(~F.col("is_test")).drop("is_test")

    @cached_property
    def test(self) -> DataFrame:
        return self.split.filter("is_test").drop("is_test")

    def holdout(self, t: int = 5) -> tuple[DataFrame, DataFrame]:
        """(seeds, truth) of the test lists."""
        return split_prefix(self.test, t)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("track"), F.col("embedding").alias("vector"))

    @cached_property
    def scored(self) -> DataFrame:
        """(pid, track, cf_prob): every cell as a candidate, scored by its highest price in whole cents."""
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
        lines = self.read("lineitem").select("l_orderkey", F.col("l_partkey").alias("track"), "l_extendedprice")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        cents = F.floor(F.max("l_extendedprice") * 100 + 0.5).cast("double")
        return joined.groupBy("pid", "track").agg(cents.alias("cf_prob"))

    @cached_property
    def returned(self) -> DataFrame:
        """(pid, pos, track) of returned lines: the hidden items of the scored candidates."""
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
        lines = self.read("lineitem").filter("l_returnflag = 'R'").select(
            "l_orderkey", "l_linenumber", F.col("l_partkey").alias("track")
        )
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select("pid", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), "track")

    @cached_property
    def predictions(self) -> DataFrame:
        """(pid, rank, track): all order lines of a list by price, repeats kept."""
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
        lines = self.read("lineitem").select("l_orderkey", F.col("l_partkey").alias("track"), "l_extendedprice")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        ranked = numbered(joined.select("pid", "track", "l_extendedprice"), "pid", [F.desc("l_extendedprice"), "track"], "at")
        return ranked.select("pid", (F.col("at") + 1).alias("rank"), "track")

    @cached_property
    def ranked(self) -> DataFrame:
        """(pid, track, cf_prob, rank): all scored candidates in the order of their score."""
        rows = numbered(self.scored, "pid", [F.desc("cf_prob"), "track"], "at")
        return rows.select("pid", "track", "cf_prob", (F.col("at") + 1).cast("int").alias("rank"))

    @cached_property
    def uris(self) -> DataFrame:
        """(pid, pos, uri): interactions as they look before ids are made dense."""
        uri = F.concat(F.lit("track:"), F.col("track").cast("string"))
        return self.interactions.select("pid", "pos", uri.alias("uri"))

    @cached_property
    def triplets(self) -> DataFrame:
        """(user, song, plays): cells with their repeats, as text keys."""
        cells = self.interactions.groupBy("pid", "track").agg(F.count(F.lit(1)).cast("int").alias("plays"))
        return cells.select(F.col("pid").cast("string").alias("user"),
                            F.concat(F.lit("S"), F.col("track").cast("string")).alias("song"), "plays")

    def marked_lists(self) -> tuple[DataFrame, DataFrame]:
        """(train, test) lists of the 80/20 split."""
        marked = split_lists(self.lists)
        return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")

    def json_test_slices(self) -> str:
        """Folder of JSON slices of incomplete lists: the first two rows of every customer's list, titles as they are."""
        part = self.read("part").select(F.col("p_partkey").alias("track"), "p_name")
        head = first_items(self.interactions, 2).join(part, "track")
        track = F.struct(
            (F.row_number().over(Window.partitionBy("pid").orderBy("pos", "track")) - 1).cast("int").alias("pos"),
            F.concat(F.lit("track:"), F.col("track").cast("string")).alias("track_uri"), F.col("p_name").alias("track_name"),
        )
        shown = head.select("pid", track.alias("t")).groupBy("pid").agg(F.collect_list("t").alias("tracks"))
        lists = self.sized_lists.join(shown, "pid").select(
            F.struct(
                "pid", "name", (F.col("num_tracks") - F.size("tracks")).cast("int").alias("num_holdouts"),
                F.size("tracks").alias("num_samples"), F.col("num_tracks").cast("int").alias("num_tracks"), "tracks",
            ).alias("entry"),
            F.floor(F.col("pid") / 1000).alias("slice"),
        )
        path = stage_path(self.spark, "test-slices")
        lists.groupBy("slice").agg(F.collect_list("entry").alias("playlists")).write.partitionBy("slice").json(path)
        return path

    def json_slices(self) -> str:
        """Folder of JSON slices: every order a list, a thousand order numbers to a slice."""
        part = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
        orders = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
        line = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        rows = line.join(part, "l_partkey").join(orders, "l_orderkey")
        track = F.struct(
            F.col("l_linenumber").alias("pos"),
            F.concat(F.lit("track:"), F.col("l_partkey").cast("string")).alias("track_uri"),
            F.col("p_name").alias("track_name"), F.concat(F.lit("artist:"), "p_brand").alias("artist_uri"),
            F.col("p_brand").alias("artist_name"), F.concat(F.lit("album:"), "p_type").alias("album_uri"),
            F.col("p_type").alias("album_name"), (F.col("l_quantity") * 1000).cast("bigint").alias("duration_ms"),
        )
        lists = rows.groupBy(F.col("l_orderkey").alias("pid"), F.col("o_orderpriority").alias("name")).agg(
            F.count(F.lit(1)).alias("num_tracks"), F.collect_list(track).alias("tracks")
        )
        entry = F.struct("pid", "name", "num_tracks", "tracks")
        slices = lists.withColumn("slice", F.floor(F.col("pid") / 1000)).repartition("slice").groupBy("slice").agg(
            F.collect_list(entry).alias("playlists")
        )
        path = stage_path(self.spark, "slices")
        slices.write.partitionBy("slice").json(path)
        return path
