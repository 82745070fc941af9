"""Questions and answers out of stored generations, and the checks on a finished prompt set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerproof.functions.text import BLANKS, LINE_BREAK, strip, text_or_empty
from answerproof.operators.ranking import top_k_per_group

# How generations mark code, and lines that are only leftovers of a list.
FENCED = r"(?isU)```(?:json|javascript|js|python)?\s*(.*?)```"
LEFTOVER_LINES = ("```", "```json", "```javascript", "```js", "[", "]", ",")
ONLY_BRACKETS = r"^[\[\]{}(),]+$"
NUMBERING = r"^\d+[.)]\s*"

_BLANK_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS) + "]+"


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _BLANK_RUN, " "))


def unfence(c: Column) -> Column:
    """Content of the first fenced block, or the whole text."""
    return F.when(c.rlike(FENCED), F.regexp_extract(c, FENCED, 1)).otherwise(c)


def first_balanced_array(c: Column) -> Column:
    """Text from the first ``[`` to the ``]`` that closes it; NULL if there is none.

    The text is cut at each ``]``. The depth after the i-th piece is the number of opening brackets
    so far minus i, and the array ends where it first reaches zero.
    """
    start = F.instr(c, "[")
    pieces = F.split(F.substring(c, start, F.length(c)), "\\]")

    def opens(piece: Column) -> Column:
        return F.length(piece) - F.length(F.replace(piece, F.lit("["), F.lit("")))

    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pieces"), F.lit(False).alias("closed"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + opens(piece) - 1
        moved = F.struct(
            depth.alias("depth"),
            (acc["pieces"] + 1).alias("pieces"),
            (depth == 0).alias("closed"),
        )
        return F.when(acc["closed"], acc).otherwise(moved)

    # the last piece has no "]" after it
    closing = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    end = F.aggregate(closing, begin, step)
    joined = F.concat(F.array_join(F.slice(pieces, F.lit(1), end["pieces"]), "]"), F.lit("]"))
    return F.when((start > 0) & end["closed"], joined)


def json_strings(c: Column) -> Column:
    """Non-blank strings of a JSON array, squeezed; NULL unless the text is an array."""
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    texts = F.transform(
        F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"),
        lambda x: F.variant_get(x, "$", "string"),
    )
    is_array = F.schema_of_variant(F.try_parse_json(c)).startswith("ARRAY")
    return F.when(is_array, F.filter(F.transform(texts, squeeze), lambda x: x != ""))


def question_lines(c: Column) -> Column:
    """One question per line, without numbering, trailing commas and list leftovers."""
    lines = F.transform(
        F.split(c, LINE_BREAK),
        lambda x: strip(F.regexp_replace(squeeze(F.rtrim(x, F.lit(","))), NUMBERING, "")),
    )
    return F.filter(
        lines, lambda x: (x != "") & ~x.isin(*LEFTOVER_LINES) & ~x.rlike(ONLY_BRACKETS)
    )


def questions(generation: Column | str) -> Column:
    """All questions in a generation: as JSON, else as the first JSON array in it, else by line."""
    body = unfence(text_or_empty(generation))
    return F.coalesce(
        json_strings(body), json_strings(first_balanced_array(body)), question_lines(body)
    )


def harvest_questions(
    df: DataFrame, generation: str = "generation", out: str = "question"
) -> DataFrame:
    """One row per question with its index in the generation; a row without any gives none."""
    rest = [c for c in df.columns if c != generation]
    return df.select(*rest, F.posexplode(questions(generation)).alias("question_no", out))


def dedupe_questions(
    df: DataFrame,
    count: int,
    seed: str = "seed",
    question: str = "question",
    position: str = "position",
) -> DataFrame:
    """First-seen distinct questions of each seed, at most ``count``, in the order they came.

    Repeats collapse in a partially combined aggregation, so a question asked a million times is one
    row before the shuffle.
    """
    firsts = (
        df.withColumn(question, strip(question))
        .filter(F.col(question) != "")
        .groupBy(seed, question)
        .agg(F.min(position).alias(position))
    )
    kept = top_k_per_group(firsts, [seed], [position, question], count)
    # at most ``count`` rows per seed are left
    order = Window.partitionBy(seed).orderBy(position, question)
    return kept.withColumn("question_no", F.row_number().over(order))


def normalize_answer(c: Column | str) -> Column:
    """First line, single spaces, no trailing full stops, lower case."""
    first = F.get(F.split(strip(text_or_empty(c)), LINE_BREAK), F.lit(0))
    return F.lower(F.rtrim(squeeze(first), F.lit("." + BLANKS)))


def majority_vote(
    df: DataFrame, question: str = "question", answer: str = "answer", vote_no: str = "vote_no"
) -> DataFrame:
    """Most common non-blank answer to each question; of equally common ones, the first given."""
    votes = df.withColumn("__a", normalize_answer(answer)).filter(F.col("__a") != "")
    counted = votes.groupBy(question, "__a").agg(
        F.count(F.lit(1)).alias("__n"), F.min(vote_no).alias("__first")
    )
    # an aggregate rather than a window: combined before the shuffle, no group is sorted
    best = F.max_by("__a", F.struct(F.col("__n"), -F.col("__first")))
    return counted.groupBy(question).agg(
        best.alias("answer"), F.max("__n").alias("votes"), F.sum("__n").alias("ballots")
    )


def incomplete_seeds(
    df: DataFrame, count: int, seed: str = "seed", question: str = "question"
) -> DataFrame:
    """Seeds with fewer than ``count`` distinct questions; blank ones do not count, nor outer blanks.

    More are no fault: a harvest stops at ``count``.
    """
    asked = strip(text_or_empty(question))
    distinct = df.groupBy(seed).agg(F.count_distinct(F.when(asked != "", asked)).alias("found"))
    return distinct.filter(F.col("found") < count).withColumn("expected", F.lit(count))


def blank_answers(df: DataFrame, answer: str = "correct_answer") -> DataFrame:
    """Rows of a prompt set without a reference answer."""
    return df.filter(strip(text_or_empty(answer)) == "")
