"""What the operators of this folder share: batches, row identity, word rules and hashing."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python: whichever of the two limits comes first ends a batch, so a run of
#: very long texts does not fill a worker. No row is ever split or left out.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 * 1024 * 1024

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"\w+")


PACKAGES = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def bounded_batches(spark: SparkSession) -> None:
    """Session settings of all operators here that run Python in tasks."""
    # workers of a single machine find this package wherever the driver was started; a cluster has it
    # installed or gets it with --py-files
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGES not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [PACKAGES, *paths]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; NULL for a missing id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def text_key(text: Column) -> Column:
    """128-bit name of a text; a document is the pair (id, text key)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def texts_of(series: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in series]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a well-spread 64-bit value for each 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x
