"""Corpus pipeline: quality classifier, language identification, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet and read
again by `run`.  All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from segue.llm import language, line_dedup, minhash, packing, quality
from segue.llm.bpe_codec import vocabulary_path
from segue.session import configure, materialize, remove_stage, stage_path, temporary_stages


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from labelled rows outside the hold-out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = quality.classify_held_out(docs, labels)
    return found.filter("predicted = 1").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or far from every model go."""
    return language.identify_held_out(docs).filter(~F.col("rejected")).select("row.*")


def line_dedup_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that over line_dedup.MAX_SHARE of the different documents of their source share.

    Copies count once, so they come whole to near-dedup; no text becomes empty.  n_chars follows the text."""
    kept = line_dedup.drop_boilerplate(docs, F.col("source"), hold_rows=False)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on shingles of five words: that of the smallest id.

    Rows that share the id of a document that stays, stay with it; so do rows without an id."""
    found = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    dropped = materialize(found.filter("NOT kept").select("doc_id"), "dropped")
    if dropped.count() <= minhash.BROADCAST_IDS:  # else the texts are shuffled by id
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; see packing.pack."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"), keep_ids=False).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("line_dedup", line_dedup_by_source),
    ("minhash_near_dedup", minhash_near_dedup),
    ("packing", pack_sequences),
]

#: Two stages score with trained models and the last one tokenizes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage wrote on its way, and its input, are deleted once its result is written."""
    configure(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = stage_path(spark, name)
        with temporary_stages(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_stage(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
