"""Corner rows that every operator of segue.llm must take, and small helpers."""

from pyspark.sql import types as T

# Names that the operators use inside, as further columns of the input.
CLASHES = ["id", "row", "key", "words", "host", "label", "text_of", "score", "predicted", "component_id", "kept", "__host",
           "__frequent", "sequence_id", "slot", "shard", "lang_pred", "rejected", "n_words", "bucket", "size", "first", "__learn",
           "n", "src", "place", "runs", "collapsed", "copy", "copies", "taken", "frequent", "at"]

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)

LONG = "lorem ipsum dolor sit amet " * 60_000  # 1.6 MB
TEXTS = [
    (0, "the quick brown fox jumps over the lazy dog and runs away from it all day long", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all day long", "en", "a"),  # a copy
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all day long", "en", "a"),  # a repeated row
    (2, None, "en", "a"), (3, "", "en", "b"), (4, "   \n\t \n", None, "b"), (5, "!!! ... 123", "en", None),
    (None, "no id here, released under the MIT License", "en", "a"), (6, LONG, "la", "b"),
    (7, "ein kleiner Hund läuft über die Straße und bellt den ganzen Tag", "de", None),
    (8, "word", "en", "b"), (9, "𝒳 中文 é̀ \x00 \x85   <|endoftext|> x", None, "b"),
    (10, "Mit\nLICENSE apache license, apache-license", None, None),
]


def rows(texts):
    return [(i, t, lang, src, None, *["clash"] * len(CLASHES)) for i, t, lang, src in texts]


def corner_docs(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
