"""Prompts and generations stored by their keys, so that joining them moves no row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

KEYS = ("run", "source", "id")


def save_keyed(
    df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Write a table bucketed and sorted by its keys, register it under a name, and read it.

    Rows are dealt out by the same hash the buckets use, so every bucket is one sorted file. A hot run is
    no hot bucket, as the id is one of the keys. Tables that are to be joined need the same keys, of the
    same types, and the same number of buckets: about the size of the larger table in units of 128 MB.
    """
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"keys that are no columns: {missing}")
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def register_keyed(spark: SparkSession, table: str, path: str, columns: str, buckets: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Name a table again that an earlier session saved; ``columns`` as in a CREATE TABLE."""
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet LOCATION '{path}' "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS"
    )
    return spark.table(table)
