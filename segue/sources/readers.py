"""Readers for the list formats: JSON slices, gzip CSV, triplets, separator and line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from segue import schemas
from segue.operators.order import with_row_index


def read_json_lists(spark: SparkSession, path: str, schema: T.StructType = schemas.TRAIN_SLICE) -> DataFrame:
    """One row per list, its tracks nested, from a folder of JSON slices."""
    slices = spark.read.schema(schema).option("multiLine", True).json(path)
    return slices.select(F.explode("playlists").alias("list")).select("list.*")


def unnest_tracks(lists: DataFrame) -> DataFrame:
    """One row per (list, track): the track's fields as columns, the list id carried along."""
    return lists.select("pid", F.explode("tracks").alias("t")).select("pid", "t.*")


def read_csv_gz(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header (gzip or plain); only the columns asked for are parsed."""
    table = spark.read.schema(schema).option("header", True).csv(path)
    return table.select(*columns) if columns else table


def read_csv_rows(spark: SparkSession, path: str, schema: T.StructType, order: list[str], skip: int,
                  rows: int | None = None) -> DataFrame:
    """Rows skip .. skip+rows, in an explicit order, of a CSV without a header; its columns are named by the schema."""
    return read_row_range(spark.read.schema(schema).csv(path), order, skip, rows)


def read_row_range(table: DataFrame, order: list[str], skip: int, rows: int | None = None) -> DataFrame:
    """Rows skip .. skip+rows of a table in an explicit order."""
    indexed = with_row_index(table, order, "row_no")
    wanted = F.col("row_no") >= skip
    if rows is not None:
        wanted = wanted & (F.col("row_no") < skip + rows)
    return indexed.filter(wanted).drop("row_no")


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, song, play count."""
    return spark.read.schema(schemas.TRIPLETS).option("sep", "\t").csv(path)


def read_sep_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Lines of four fields set apart by <SEP>: artist id, song id, artist, song."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), "<SEP>").alias("p"))
    names = ["a_id", "s_id", "artist", "song"]
    return parts.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def read_lines(spark: SparkSession, path: str, name: str = "user") -> DataFrame:
    """One value per line, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias(name))


def read_key_value(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated song and index."""
    return spark.read.schema(schemas.SONG_INDEX).option("sep", " ").csv(path)
