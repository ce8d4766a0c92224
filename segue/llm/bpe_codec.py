"""BPE encoding and decoding of whole texts, each partition with its own pair occurrence index (bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from segue.llm.arrays import bounded_batches, frugal
from segue.llm.bpe import Encoder, Vocabulary, gather


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(data: bytes, bounds: np.ndarray) -> pa.Array:
    """A binary column of the runs of `data` between the bounds."""
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)]
    )


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or Encoder(path)
            ids, bounds = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(bounds)), _cut(ids.astype("<u4").tobytes(), bounds * 4)],
                names=["id", "n_tokens", "ids"],
            )

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if flat is None:
                tokens = Vocabulary(path).token_bytes
                flat = np.frombuffer(b"".join(tokens), np.uint8)
                offs = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
            texts = []
            for ids in batch.column("ids").to_pylist():
                found, _ = gather(flat, offs, np.frombuffer(ids or b"", "<u4").astype(np.int64))
                texts.append(found.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "n_tokens", "ids")), pa.array(texts, pa.string())],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for every row; ids: little-endian unsigned 32-bit numbers, one behind the other.

    Whole texts are encoded; a null text is an empty one, which has no ids.  Repeated rows and ids are encoded
    each by itself.  Of pairs of one rank the left one merges first.  A very long text is a batch of its own; an
    empty table gives an empty result.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(frugal(_encode(path)), "id long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """`encode`'s columns and decoded, the text of the ids; bytes that are no UTF-8 become replacement signs."""
    bounded_batches(encoded.sparkSession)
    source = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids")
    out = source.mapInArrow(frugal(_decode(path)), "id long, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("byte_bpe_50k.json")
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict = {}
