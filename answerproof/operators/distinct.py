"""Exact distinct counts per group and in total, out of bitmaps that are merged.

Keys get dense numbers, a bit each, and a bucket of 32,768 numbers is one bitmap. Groups hold bitmaps
instead of rows for each key, so a roll-up merges them and nothing is expanded or counted once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerproof.operators.ranking import join_on, number_rows
from answerproof.operators.small import settle


def group_bitmaps(df: DataFrame, by: Sequence[str], digest: str) -> DataFrame:
    """``by``, bucket, bits: which numbers of the digests of 32 hexadecimal digits occur in each group.

    A missing digest is none. Numbers follow the digests, so buckets are even whatever the keys are.
    Groups and keys are settled when this is called; each bucket is made by one task, from one row at
    most for each group and number.
    """
    pairs = settle(df.filter(F.col(digest).isNotNull()).select(*by, digest).distinct())
    numbers = number_rows(pairs.select(digest).distinct(), [], digest, "__no", hashed=True)
    numbered = pairs.join(numbers, digest).withColumn("bucket", F.bitmap_bucket_number("__no"))
    # the rows of a bucket lie together, so a bitmap is complete before anything else is shuffled
    return (
        numbered.repartition("bucket")
        .groupBy(*by, "bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__no")).alias("bits"))
    )


def distinct_counts(bitmaps: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Keys of each group of ``by``, some of the columns the bitmaps are grouped by; of all if none."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(out))


def with_total(
    df: DataFrame, by: str, digests: dict[str, str], plain: dict[str, str], total: str
) -> DataFrame:
    """``group``, sums and distinct counts for each value of ``by`` and, named ``total``, for all rows.

    ``plain`` maps summed columns to their names, ``digests`` columns of digests to the name of their
    number of distinct values.
    """
    sums = settle(df.groupBy(by).agg(*[F.sum(c).alias(name) for c, name in plain.items()]))
    # one row per group from here on
    each = sums
    whole = sums.agg(*[F.sum(name).alias(name) for name in plain.values()])
    for column, name in digests.items():
        bits = settle(group_bitmaps(df, [by], column))
        each = join_on(each, distinct_counts(bits, [by], name), [by], "left")
        whole = whole.withColumn(name, F.lit(distinct_counts(bits, [], name).first()[0]))
    names = [*plain.values(), *digests.values()]
    filled = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names]
    return each.select(F.col(by).alias("group"), *filled).unionByName(
        whole.select(F.lit(total).alias("group"), *filled)
    )
