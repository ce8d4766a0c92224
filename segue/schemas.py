"""Fixed schemas of the inputs and of the working tables."""

from pyspark.sql import types as T

TRACK_FIELDS = T.StructType([
    T.StructField("artist_uri", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("artist_name", T.StringType()),
    T.StructField("track_uri", T.StringType()),
    T.StructField("track_name", T.StringType()),
    T.StructField("album_uri", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("album_name", T.StringType()),
])

TRAIN_LIST_FIELDS = T.StructType([
    T.StructField("collaborative", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("modified_at", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("num_albums", T.IntegerType()),
    T.StructField("num_artists", T.IntegerType()),
    T.StructField("num_edits", T.IntegerType()),
    T.StructField("num_followers", T.IntegerType()),
    T.StructField("num_tracks", T.IntegerType()),
    T.StructField("pid", T.LongType()),
])

TEST_LIST_FIELDS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("num_holdouts", T.IntegerType()),
    T.StructField("num_samples", T.IntegerType()),
    T.StructField("num_tracks", T.IntegerType()),
    T.StructField("pid", T.LongType()),
])


def slice_schema(list_fields: T.StructType) -> T.StructType:
    """Schema of one JSON slice: an object holding an array of lists with nested tracks."""
    entry = T.StructType(list_fields.fields + [T.StructField("tracks", T.ArrayType(TRACK_FIELDS))])
    return T.StructType([T.StructField("playlists", T.ArrayType(entry))])


TRAIN_SLICE = slice_schema(TRAIN_LIST_FIELDS)
TEST_SLICE = slice_schema(TEST_LIST_FIELDS)

INTERACTIONS = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("track", T.LongType()),
    T.StructField("pid", T.LongType()),
])

TRIPLETS = T.StructType([
    T.StructField("user", T.StringType()),
    T.StructField("song", T.StringType()),
    T.StructField("plays", T.IntegerType()),
])

SONG_INDEX = T.StructType([
    T.StructField("song", T.StringType()),
    T.StructField("idx", T.StringType()),
])
