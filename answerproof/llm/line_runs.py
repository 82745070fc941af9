"""Removal of repeated runs of lines, by a suffix array over line numbers.

Lines get order-preserving numbers; prefix doubling then ranks, level by level, the runs of
2, 4, 8, ... lines that begin at each position. As usual, positions whose prefix occurs once leave
the race, so only repeated material is ever sorted. Equal ranks at level k are an interval of the
suffix array whose common prefix has 2^k lines at least, and the interval at any depth n in between
is named by two overlapping ranks, those of the first and of the last 2^k lines.

A run counts if it has ``min_words`` words, few enough that single lines count: boilerplate stands alone
between unique lines. Below that, lines repeat by chance ("Yes.", "}"). From every position the shortest such prefix is taken,
and to every position the shortest such run that ends there: together they cover each maximal
repeated run completely, and none is longer than ``min_words`` lines, which bounds the levels.
Members of an interval other than the earliest are later copies.

Only DataFrame functions. No window spans more than one document; runs that half the corpus shares
meet in aggregates with partial results and in joins with one row per interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerproof.llm import common
from answerproof.session import written

MIN_WORDS = 4
BLANK = " \t\x0b\f\r"
BLANKS = "[ \\t\\x0B\\f\\r]+"


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line with a word: d, k (the document), pos (1, 2, ...), line (number from 0 in
    the text), h1, h2 (digest of the trimmed line), words."""
    pieces = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(i.alias("line"), F.btrim(line, F.lit(BLANK)).alias("t")),
    )
    filled = F.filter(pieces, lambda x: x["t"] != "")
    # computed beside posexplode, the key of the text would be taken anew for every line; the outer form
    # spares a filter that would split the text again
    named = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("d"), common.text_key(F.col("text")).alias("k"), filled.alias("lines")
    )
    rows = named.select("d", "k", F.posexplode_outer("lines").alias("pos", "x")).filter("x is not null")
    return rows.select(
        "d",
        "k",
        (F.col("pos") + 1).alias("pos"),
        "x.line",
        F.xxhash64("x.t").alias("h1"),
        F.xxhash64(F.lit(1), "x.t").alias("h2"),  # the constant first: behind the text it would hash h1 only
        F.size(F.split("x.t", BLANKS)).alias("words"),
    )


def _ranked(classes: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Numbers that rise with the keys. A sorted table is numbered by partition and row; it is written
    so that a lost executor cannot bring other numbers."""
    ordered = classes.orderBy(*keys).withColumn(rank, F.monotonically_increasing_id())
    return written(ordered, "line-ranks")


def suffix_ranks(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, int]:
    """Positions whose line occurs twice or more, with the ranks r0, r1, ... of the runs of 1, 2, 4,
    ... lines that begin there (NULL: occurs once). ``isle`` marks stretches of such lines."""
    lines = lines_of(docs)
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    numbered = _ranked(repeated, ["h1", "h2"], "r0")
    # rows equal in id and text are one document
    active = lines.join(numbered, ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["d", "k", "pos"])
    doc = Window.partitionBy("d", "k").orderBy("pos")
    active = active.withColumn("isle", F.col("pos") - F.row_number().over(doc))
    levels = max(1, min_words).bit_length()
    stretch = Window.partitionBy("d", "k", "isle").orderBy("pos")
    active = written(active, "line-positions")
    for level in range(1, levels):
        rank = f"r{level - 1}"
        shifted = active.withColumn("then", F.lead(rank, 2 ** (level - 1)).over(stretch))
        pairs = shifted.filter(F.col(rank).isNotNull() & F.col("then").isNotNull())
        pairs = pairs.groupBy(rank, "then").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        names = _ranked(pairs, [rank, "then"], f"r{level}")
        active = written(shifted.join(names, [rank, "then"], "left").drop("then"), "line-positions")
    return active, levels


def _windows(active: DataFrame, levels: int, min_words: int) -> DataFrame:
    """Shortest runs of ``min_words`` words that begin or end at a position: d, k, start, lines, and
    the name of their interval (n, a, b)."""
    stretch = Window.partitionBy("d", "k", "isle").orderBy("pos")
    here = F.struct("pos", "line", "words", *[f"r{i}" for i in range(levels)])
    reach = max(1, min_words) - 1
    ahead = F.collect_list(here).over(stretch.rowsBetween(0, reach))
    behind = F.collect_list(here).over(stretch.rowsBetween(-reach, 0))
    both = active.select("d", "k", ahead.alias("ahead"), behind.alias("behind"))

    def shortest(array: str):
        count = lambda acc, x: F.when(
            acc["w"] < min_words, F.struct((acc["w"] + x["words"]).alias("w"), (acc["n"] + 1).alias("n"))
        ).otherwise(acc)
        first = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
        return F.aggregate(array, first, count, lambda acc: F.when(acc["w"] >= min_words, acc["n"]))

    forward = both.select("d", "k", F.col("ahead").alias("run"), shortest("ahead").alias("n"))
    back = both.withColumn("turned", F.reverse("behind")).withColumn("n", shortest("turned"))
    back = back.select("d", "k", F.reverse(F.slice("turned", 1, F.coalesce("n", F.lit(0)))).alias("run"), "n")
    runs = forward.unionByName(back).filter("n is not null").withColumn("run", F.slice("run", 1, F.col("n")))
    a = b = F.lit(None).cast("bigint")
    for level in range(levels):
        fits = (F.col("n") >= 2**level) & (F.col("n") < 2 ** (level + 1))
        a = F.when(fits, F.element_at("run", 1)[f"r{level}"]).otherwise(a)
        # -> last 2^level lines of the run; the index is only used where it lies inside
        at = F.greatest(F.col("n") - 2**level, F.lit(0)).cast("int")
        b = F.when(fits, F.get("run", at)[f"r{level}"]).otherwise(b)
    return (
        runs.select(
            "d",
            "k",
            F.element_at("run", 1)["pos"].alias("start"),
            "n",
            a.alias("a"),
            b.alias("b"),
            F.col("run.line").alias("lines"),
        )
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, k, lines: per document the lines (numbers from 0, ascending) that later copies cover.

    Earliest means smallest (id, text key, position), missing ids first. A copy that overlaps its own
    original within a document gives up only what lies past the original.
    """
    active, levels = suffix_ranks(docs, min_words)
    runs = _windows(active, levels, min_words)
    place = F.struct("d", "k", "start")
    earliest = runs.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # a table of its own: the join can then split an interval that very many documents share
    earliest = written(earliest.filter(F.col("first") != F.col("last")).drop("last"), "intervals")
    copies = runs.join(earliest, ["n", "a", "b"]).filter(place != F.col("first"))
    inside = common.same(F.col("d"), F.col("first.d")) & (F.col("k") == F.col("first.k"))
    skip = F.when(
        inside, F.greatest(F.lit(0), F.col("first.start") + F.col("n") - F.col("start"))
    ).otherwise(F.lit(0))
    left = F.expr("slice(lines, cast(skip as int) + 1, greatest(n - cast(skip as int), 0))")
    covered = copies.withColumn("skip", skip).select("d", "k", F.explode(left).alias("line"))
    return covered.groupBy("d", "k").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with two more: ``kept_text`` and ``removed`` (line numbers).

    Names that are taken get a trailing underscore. Missing texts stay missing, texts without a
    repeated run stay as they are, and an empty table gives an empty one. Rows equal in doc_id and
    text are one document and share its fate.
    """
    text, removed = common.free_name(docs, "kept_text"), common.free_name(docs, "removed")
    d, k, gone = (common.free_name(docs, name) for name in ("__d", "__k", "__lines"))
    found = later_copies(docs.select("doc_id", "text"), min_words)
    found = found.select(F.col("d").alias(d), F.col("k").alias(k), F.col("lines").alias(gone))
    on = common.same(F.col("doc_id"), F.col(d)) & (common.text_key(F.col("text")) == F.col(k))
    rest = F.filter(
        F.split("text", "\n", -1), lambda line, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False))
    )
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    joined = docs.join(found, on, "left")
    return joined.withColumns(
        {text: kept, removed: F.coalesce(gone, F.array().cast("array<int>"))}
    ).drop(d, k, gone)
