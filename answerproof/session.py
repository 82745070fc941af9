"""Session settings the jobs are tuned for."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # oracle engines know no session time zone
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # per-partition pruning of row_number() <= k also for audit sets beyond 1,000 rows
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # collecting Python call sites for error messages doubles the time it takes to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("answerproof")
    shuffle = cores if isinstance(cores, int) else os.cpu_count()
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.driver.memory": "8g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="answerproof-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores.

    Labelling costs far more than reading, and a small file is a single split. Inputs with a split
    per core, which is any large table, are left alone.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside the block are removed when it ends.

    Save the result inside the block: DataFrames are lazy, and one that is read later would miss them.
    """
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no later plan reads."""
    for df in tables:
        folders = {os.path.dirname(f) for f in df.inputFiles()}
        for folder in folders:
            if re.search(r"/[\w-]+-[0-9a-f]{32}$", folder):
                _remove(df.sparkSession, folder)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table once into the shared checkpoint folder and read it back.

    For results that several passes read: later plans are short, scan only the columns they need, and
    survive lost executors without redoing the work. Within ``scratch`` the table goes when the block
    ends; otherwise it stays.
    """
    folder = f"{_scratch.get() or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
