"""Wording cues: negated answers, claims of non-existence, short answers that name another thing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerproof.config import Thresholds
from answerproof.functions.text import (
    as_col,
    content_tokens,
    quoted_alternatives,
    shared_content_count,
    strip,
    text_or_empty,
    token_count,
)

# Words that negate what follows, and verbs that link an answer to "not" or "no".
NEGATORS = ("not", "isn't", "isnt", "no")
LINKING_VERBS = ("is", "was", "are", "were")


def negation_cue(resp_can: Column | str, gold_can: Column | str) -> Column:
    """``not <gold>`` or ``<gold> is not``, word boundaries on both sides.

    The gold text makes the pattern differ per row, and compiling one is the costly part; plain
    substring tests let through only the rows where it can match.
    """
    resp, gold = as_col(resp_can), as_col(gold_can)
    possible = F.lit(False)
    for word in NEGATORS:
        possible = possible | resp.contains(F.concat(F.lit(f"{word} "), gold))
    for verb in LINKING_VERBS:
        possible = possible | resp.contains(F.concat(gold, F.lit(f" {verb} no")))
    quoted = F.concat(F.lit("\\Q"), gold, F.lit("\\E"))
    pattern = F.concat(
        F.lit(f"(?U)\\b(?:{'|'.join(NEGATORS)}) "), quoted, F.lit("\\b|\\b"), quoted,
        F.lit(f" (?:{'|'.join(LINKING_VERBS)}) (?:not|no)\\b"),
    )
    return F.when(
        (gold != "") & (resp != "") & possible, F.call_function("rlike", resp, pattern)
    ).otherwise(F.lit(False))


def unavailability_cue(resp_can: Column | str, th: Thresholds) -> Column:
    padded = F.concat(F.lit(" "), as_col(resp_can), F.lit(" "))
    if not th.unavailability_cues:
        return F.lit(False)
    return padded.rlike(f" (?:{quoted_alternatives(th.unavailability_cues)}) ")


def atomic_gold(
    gold_raw: Column | str, gold_can: Column | str, th: Thresholds
) -> Column:
    """A short name or code rather than a phrase."""
    raw, can = text_or_empty(gold_raw), as_col(gold_can)
    count = token_count(can)
    short = (
        (can != "")
        & (F.length(can) <= th.atomic_gold_max_chars)
        & (count <= th.atomic_gold_max_tokens)
    )
    return short & (
        ~strip(raw).contains(" ") | (F.size(content_tokens(can)) == count)
    )


def atomic_mismatch(
    is_atomic: Column, agrees: Column, resp_can: Column, gold_can: Column, th: Thresholds
) -> Column:
    """A short response to an atomic gold answer that shares no content token with it."""
    return (
        is_atomic
        & ~agrees
        & (token_count(resp_can) <= th.atomic_resp_max_tokens)
        & (shared_content_count(resp_can, gold_can) == 0)
    )
