"""Session settings and stage files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan in this package is written for.  The join split of AQE
# is forced because most of our joins feed an aggregation on the join key, where AQE
# would otherwise keep a hot partition whole to save one exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small inputs expand a lot here: do not merge them into a handful of tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Shuffle files go when the job that made them is done: what a later one reads is written as a stage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

_local_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("segue")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for stage files: the shared one the cluster names, else (local mode only) a temp folder."""
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="segue-")
    return _local_scratch


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Share an input out evenly before heavy work on each row; Spark chooses the number of tasks by size.

    A file with one row group is one task otherwise, however large the cluster."""
    return df.hint("rebalance")


_open: list[list[str]] = []  # stage folders written inside each open `temporary_stages`


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """The stages that `materialize` writes inside are deleted at the end; what is still wanted of them must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove_stage(spark, path)


def remove_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage folder, wherever it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a stage as parquet and read it back.

    The result does not depend on executor-local blocks, is computed once however many
    branches use it, and carries real file sizes into join planning.
    """
    path = stage_path(df.sparkSession, label)
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


STEPS_AT_ONCE = 4


def together(spark: SparkSession, steps: list[Callable[[], Any]]) -> list[Any]:
    """The results of steps that do not need one another, run at the same time: the tasks of one fill the cores that the last
    tasks and small jobs of another leave idle."""
    if not steps:
        return []
    with ThreadPoolExecutor(min(STEPS_AT_ONCE, len(steps))) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]
