"""Interleaving sources to target weights by Pfair scheduling.

Rows of a source form blocks of ``block_rows``. Of every round of slots, a source with the integer
share w out of W gets w; its block i (0, 1, ...) is released at slot floor(i * W / w) and due by
ceil((i + 1) * W / w). Earliest deadline first among the released blocks meets every deadline, so at
any slot a source is less than one block away from its exact share. At the end of a round nothing is
owed, hence one round is the whole schedule: the position of any block follows by arithmetic.

A source that runs out gives what it still has to its last round and is then left out; the others
share the slots in proportion to their weights. No row is dropped or repeated. A round is made by a
fold over its slots; there are at most two different rounds for each source.

Only DataFrame and SQL functions. Block numbers come from counts of hash ranges, so no task sorts a
source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerproof.llm import common

BLOCK_ROWS = 100
#: Sum of all shares, which is the length of a round.
MAX_SLOTS = 50_000
RANGE_ROWS = 2_000  # rows of a hash range, on average
_HASH = 8  # hexadecimal digits that choose a range


def source_name(source: Column) -> Column:
    """Missing sources are a source of their own, apart from an empty name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def number_in_source(docs: DataFrame) -> DataFrame:
    """The whole ``row`` with ``name`` (of the source) and ``nr`` (0, 1, ... within it) by md5 of the id.

    Missing ids come first. The ranges a source is cut into grow in number with the table, so each
    stays short whatever share of the rows a source holds.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        "doc_id",
        source_name(F.col("source")).alias("name"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    total = docs.count()
    ranges = max(1, -(-total // RANGE_ROWS))
    cut = F.floor(F.conv(F.substring("h", 1, _HASH), 16, 10).cast("bigint") * F.lit(ranges) / F.lit(16**_HASH))
    rows = rows.withColumn("part", cut)
    counts = rows.groupBy("name", "part").agg(F.count("*").alias("n"))
    # ranges before this one, added up over groups of ranges first: neither window is long
    wide = max(1, int(ranges**0.5))
    counts = counts.withColumn("zone", F.floor(F.col("part") / wide))
    zones = counts.groupBy("name", "zone").agg(F.sum("n").alias("zn"))
    ahead = Window.partitionBy("name").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)
    zones = zones.select("name", "zone", F.coalesce(F.sum("zn").over(ahead), F.lit(0)).alias("base"))
    before = Window.partitionBy("name", "zone").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_zone", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = counts.join(zones, ["name", "zone"]).select(
        F.col("name").alias("o_name"), F.col("part").alias("o_part"), (F.col("base") + F.col("in_zone")).alias("offset")
    )
    within = Window.partitionBy("name", "part").orderBy("h", "doc_id")
    numbered = rows.withColumn("in_part", F.row_number().over(within) - 1)
    on = (F.col("name") == F.col("o_name")) & (F.col("part") == F.col("o_part"))
    return numbered.join(offsets, on).select(
        "row", "name", (F.col("offset") + F.col("in_part")).alias("nr")
    )


def shares(sizes: DataFrame, weights: Mapping[str | None, int], default: int) -> DataFrame:
    """``sizes`` (name, rows) with the integer share w of each source."""
    told = {("-" if k is None else f"={k}"): int(w) for k, w in weights.items()}
    if default < 1 or any(w < 1 for w in told.values()):
        raise ValueError("shares are whole numbers from 1")
    w = F.lit(default)
    for name, share in sorted(told.items()):
        w = F.when(F.col("name") == name, share).otherwise(w)
    return sizes.withColumn("w", w.cast("bigint"))


#: Source (number from 0) of each slot of a round, from the array ``c`` of slots each source gets.
#: State: blocks done by each source, and the slots so far.
ROUND = """
aggregate(
  sequence(0, cast(aggregate(c, 0L, (a, x) -> a + x) as int) - 1),
  named_struct('done', transform(c, x -> 0L), 'slots', cast(array() as array<int>)),
  (s, t) -> transform(
    array(array_min(filter(
      transform(c, (x, i) -> named_struct(
        'due', case when s.done[i] < x and floor(s.done[i] * total / x) <= t
                    then ceil((s.done[i] + 1) * total / x) end,
        'i', i)),
      y -> y.due is not null)).i),
    i -> named_struct('done', transform(s.done, (d, j) -> if(j = i, d + 1, d)),
                      'slots', concat(s.slots, array(i))))[0],
  s -> s.slots)
"""


def schedule(sizes: DataFrame) -> DataFrame:
    """The rounds: one row per source and kind of round, from one row per source (name, blocks, w).

    name, w, first_round, last_round, first_slot, total (slots of such a round) and ``slots``: where
    in the round the source's blocks go. Bounded by the sum of the shares, which is checked.
    """
    listed = sizes.filter("blocks > 0").agg(
        F.sort_array(F.collect_list(F.struct("name", "blocks", "w"))).alias("all")
    )
    # rounds change when a source starts its last, possibly short, round and when it has ended
    edges = F.array_sort(
        F.array_distinct(
            F.flatten(
                F.array(
                    F.array(F.lit(0).cast("bigint")),
                    F.expr("transform(all, s -> cast(floor(s.blocks / s.w) as bigint))"),
                    F.expr("transform(all, s -> cast(ceil(s.blocks / s.w) as bigint))"),
                )
            )
        )
    )
    kinds = (
        listed.withColumn("edges", edges)
        .select("all", "edges", F.posexplode("edges").alias("e", "first_round"))
        .withColumn("next_round", F.expr("get(edges, e + 1)"))
        .filter("next_round is not null")
        .withColumn("c", F.expr("transform(all, s -> greatest(0L, least(s.w, s.blocks - first_round * s.w)))"))
        .withColumn("total", F.expr("aggregate(c, 0L, (a, x) -> a + x)"))
        .filter("total > 0")
    )
    made = kinds.withColumn("round", F.expr(ROUND))
    length = (F.col("next_round") - F.col("first_round")) * F.col("total")
    every = F.collect_list(F.struct("first_round", length.alias("length"))).over(Window.partitionBy(F.lit(0)))
    # at most two kinds for each source
    made = made.withColumn("every", every).withColumn(
        "first_slot",
        F.expr("aggregate(filter(every, x -> x.first_round < first_round), 0L, (a, x) -> a + x.length)"),
    )
    by_source = made.select(
        "first_round", (F.col("next_round") - 1).alias("last_round"), "first_slot", "total", "round", "c",
        F.posexplode("all").alias("i", "s"),
    )
    return by_source.select(
        "s.name", "s.w", "first_round", "last_round", "first_slot", "total",
        F.expr("get(c, i)").alias("share"),
        F.expr("filter(transform(round, (x, t) -> if(x = i, t, null)), t -> t is not null)").alias("slots"),
    )


def mix(
    docs: DataFrame, weights: Mapping[str | None, int], default: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The columns of ``docs`` (doc_id, source and any others) and block (number within its source),
    slot, release and deadline (slots), position. Names that are taken get a trailing underscore.

    ``weights``: whole-number shares by source; sources not listed have ``default``. ``position`` is
    the place of the row in the mix, 0 to n - 1 without gaps. One row for each row of ``docs``; rows
    equal in id come in any order among themselves. An empty table gives an empty one. Raises if the
    shares add up to more than ``MAX_SLOTS``.
    """
    names = {c: common.free_name(docs, c) for c in ("block", "slot", "release", "deadline", "position")}
    sizes = docs.groupBy(source_name(F.col("source")).alias("name")).agg(F.count("*").alias("rows"))
    sizes = shares(sizes, weights, default)
    slots = sizes.agg(F.sum("w")).first()[0] or 0
    if slots > MAX_SLOTS:
        raise ValueError(f"a round of {slots} slots; at most {MAX_SLOTS} shares")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("bigint"))
    plan = schedule(sizes)
    of_source = plan.groupBy("name", "w").agg(
        F.sort_array(
            F.collect_list(F.struct("first_round", "last_round", "first_slot", "total", "share", "slots"))
        ).alias("rounds")
    )
    of_source = of_source.join(sizes.select("name", "rows", "blocks"), "name")

    def kind(block: str) -> str:
        return f"filter(rounds, r -> floor({block} / w) between r.first_round and r.last_round)[0]"

    def slot(block: str) -> str:
        return (
            f"{kind(block)}.first_slot + (floor({block} / w) - {kind(block)}.first_round) * {kind(block)}.total"
            f" + {kind(block)}.slots[cast({block} % w as int)]"
        )

    # the last block of a source may be short; positions after it move up
    of_source = of_source.withColumn("last_slot", F.expr(slot("(blocks - 1)"))).withColumn(
        "missing", F.col("blocks") * block_rows - F.col("rows")
    )
    all_sources = Window.partitionBy(F.lit(0))
    of_source = of_source.withColumn("short", F.collect_list(F.struct("last_slot", "missing")).over(all_sources))
    # one row per source: bounded by MAX_SLOTS
    placed = (
        number_in_source(docs)
        .join(F.broadcast(of_source), "name")
        .withColumn("block", F.floor(F.col("nr") / block_rows))
        .withColumn("r", F.expr(kind("block")))
        .withColumn("in_round", F.expr("floor(block / w) - r.first_round"))
        .withColumn("i", F.expr("block % w"))
        .withColumn("base", F.expr("r.first_slot + in_round * r.total"))
        .withColumn("slot", F.expr("base + r.slots[cast(i as int)]"))
    )
    gone = "aggregate(filter(short, x -> x.last_slot < slot), 0L, (a, x) -> a + x.missing)"
    return placed.select(
        "row.*",
        F.col("block").cast("bigint").alias(names["block"]),
        F.col("slot").cast("bigint").alias(names["slot"]),
        F.expr("cast(base + floor(i * r.total / r.share) as bigint)").alias(names["release"]),
        F.expr("cast(base + ceil((i + 1) * r.total / r.share) as bigint)").alias(names["deadline"]),
        F.expr(f"cast(slot * {block_rows} + nr % {block_rows} - {gone} as bigint)").alias(names["position"]),
    )
