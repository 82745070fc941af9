"""Numbering and picking rows when one group may hold most of the table.

A plain ``row_number() over (partition by group order by ...)`` sorts a whole group in one task.
These helpers cut every group into blocks first: blocks are counted with ordinary partial
aggregation, running totals over the (few) blocks give each block its offset, and only rows of one
block are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerproof.operators.small import settle

BLOCK_ROWS_LOG2 = 20  # about a million consecutive positions per block
NUMBERING_DIGITS = 5  # about a million blocks when numbering by a hash
CUT_DIGITS = 3  # 4,096 blocks per group at each step of the search for a cut
SORTED_ROWS = 1_000_000  # a longer block is cut more finely before it is sorted


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match, as they do in a GROUP BY; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def _block_offsets(df: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """Rows before each block within its group: one small row per (group, block)."""
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("__n"))
    before = (
        Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("__n").over(before), F.lit(0))
    return counts.withColumn("__offset", offset)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    hashed: bool = False,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Dense 1..n per group in the order of one column.

    ``order`` is a bigint position, or with ``hashed`` a hexadecimal hash. Positions need not be
    dense; at most 2^20 distinct ones share a block.
    """
    # rows without a position come first, in a block of their own
    block = (
        F.coalesce(F.substring(order, 1, NUMBERING_DIGITS), F.lit(""))
        if hashed
        else F.coalesce(F.shiftright(F.col(order).cast("bigint"), BLOCK_ROWS_LOG2), F.lit(-(2**62)))
    )
    # as one struct the keys match when missing, and window and join share a single shuffle
    place = ["__group", "__block"] if keys else ["__block"]
    blocked = df.withColumn("__block", block)
    if keys:
        blocked = blocked.withColumn("__group", F.struct(*keys))
    offsets = _block_offsets(blocked, place[:-1], "__block").drop("__n")
    within = Window.partitionBy(*place).orderBy(order, *ties)
    numbered = blocked.withColumn("__within", F.row_number().over(within))
    joined = numbered.join(offsets, place)
    return joined.withColumn(out, F.col("__offset") + F.col("__within")).drop(
        *place, "__within", "__offset"
    )


def _cuts(df: DataFrame, keys: Sequence[str], quota: str, order: str, digits: int) -> DataFrame:
    """Per group: the hash block its quota ends in, rows still wanted from it, rows in it.

    ``df`` has the quota of its group on every row.
    """
    blocked = df.select(*keys, F.substring(order, 1, digits).alias("__block"), quota)
    counts = blocked.groupBy(*keys, "__block").agg(
        F.count(F.lit(1)).alias("__n"), F.max(quota).alias(quota)
    )
    before = (
        Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    at_cut = F.struct("__block", (F.col(quota) - F.col("__offset")).alias("left"), "__n")
    last = (
        placed.filter(F.col("__offset") < F.col(quota))
        .groupBy(*keys)
        .agg(F.max_by(at_cut, "__block").alias("c"))
    )
    return last.select(
        *keys,
        F.col("c.__block").alias("__cut"),
        F.col("c.left").alias("__left"),
        F.col("c.__n").alias("__size"),
    )


def take_by_hash(
    df: DataFrame, keys: Sequence[str], quotas: DataFrame, quota: str, order: str
) -> DataFrame:
    """The first ``quota`` rows of each group in hash order; ``quotas`` holds one row per group.

    Whole hash blocks below the cut are kept by a filter, and only the block the quota ends in is
    sorted: nothing but that block and the sample itself is shuffled. The cuts (one row per group)
    are looked for when this is called, each time in blocks 4,096 times finer, until the blocks to
    be sorted are short, however many groups there are. Groups without a quota are dropped.
    Hash a unique key: equal hashes are taken in arbitrary order.
    """
    digits = CUT_DIGITS
    wanted = join_on(df, quotas.select(*keys, quota), keys)
    cut = settle(_cuts(wanted, keys, quota, order, digits))
    while digits < 30 and (cut.agg(F.max("__size")).first()[0] or 0) > SORTED_ROWS:
        inside = join_on(df, cut, keys).filter(F.substring(order, 1, digits) == F.col("__cut"))
        digits += CUT_DIGITS
        cut = settle(_cuts(inside, keys, "__left", order, digits))
    blocked = join_on(df.withColumn("__block", F.substring(order, 1, digits)), cut, keys)
    whole = blocked.filter(F.col("__block") < F.col("__cut"))
    within = Window.partitionBy(*keys, "__block").orderBy(order)
    partial = (
        blocked.filter(F.col("__block") == F.col("__cut"))
        .withColumn("__rn", F.row_number().over(within))
        .filter(F.col("__rn") <= F.col("__left"))
        .drop("__rn")
    )
    return whole.unionByName(partial).drop("__block", "__cut", "__left", "__size")


def take_first(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows of the whole table in hash order, for any n; no task sorts the table."""
    whole = df.withColumn("__all", F.lit(0))
    quota = df.sparkSession.range(1).select(F.lit(0).alias("__all"), F.lit(n).alias("__quota"))
    return take_by_hash(whole, ["__all"], F.broadcast(quota), "__quota", order).drop("__all")


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, fan_in: int = 256
) -> DataFrame:
    """The first k rows of each group for a small, fixed k, merged as a tree.

    Each input partition keeps k rows per group (Spark prunes before the shuffle), then up to
    ``fan_in`` tasks per group, then one; no task sees more than k rows from each of its inputs.
    """
    salted = df.withColumn("__salt", F.spark_partition_id() % fan_in)
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    pruned = salted.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= k)
    return (
        pruned.drop("__rn", "__salt")
        .withColumn("__rn", F.row_number().over(last))
        .filter(F.col("__rn") <= k)
        .drop("__rn")
    )
