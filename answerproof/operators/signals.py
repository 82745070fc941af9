"""Signal columns over a table of (response, reference answer) pairs.

Row-local expressions only: no shuffle, no Python worker. They are added in layers (canonical
text, then parsed values, then comparisons) so that each expensive expression is evaluated once and
Catalyst drops whatever the caller does not select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerproof.config import Thresholds
from answerproof.functions import cues, numeric, text

# Working columns start with this; drop_working() removes them.
WORK = "__"
NO_NUMBERS = "array<double>"


def w(name: str) -> Column:
    return F.col(WORK + name)


def drop_working(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(WORK)])


def add_canonical(
    df: DataFrame, response: str = "model_response", gold: str = "correct_answer"
) -> DataFrame:
    """Raw and canonical text of both sides."""
    return df.withColumns(
        {
            WORK + "resp_raw": text.text_or_empty(response),
            WORK + "gold_raw": text.text_or_empty(gold),
            WORK + "resp": text.canonical(response),
            WORK + "gold": text.canonical(gold),
        }
    )


def add_lexical(df: DataFrame, th: Thresholds) -> DataFrame:
    """Tokens, equality, containment and overlap (needs add_canonical)."""
    df = df.withColumns(
        {WORK + "resp_toks": text.tokens(w("resp")), WORK + "gold_toks": text.tokens(w("gold"))}
    )
    return df.withColumns(
        {
            WORK + "exact": w("resp") == w("gold"),
            WORK + "substring": text.contains_canonical(w("resp"), w("gold")),
            WORK + "jaccard": text.jaccard(w("resp_toks"), w("gold_toks")),
            WORK + "subsequence": text.token_subsequence(
                w("resp"), w("gold"), w("resp_toks"), w("gold_toks"), th
            ),
        }
    )


def add_parsed_numbers(df: DataFrame) -> DataFrame:
    """Numbers and coordinates. Responses are parsed only where the gold answer is a number."""
    df = df.withColumn(WORK + "gold_ascii", numeric.ascii_digits(w("gold")))
    df = df.withColumns(
        {
            WORK + "gold_coord": numeric.coordinate(w("gold_ascii")),
            WORK + "gold_numeric": numeric.looks_numeric(w("gold_ascii")),
        }
    )
    df = df.withColumn(WORK + "has_target", w("gold_coord").isNotNull() | w("gold_numeric"))
    df = df.withColumns(
        {
            WORK + "gold_numtext": F.when(
                w("gold_coord").isNull() & w("gold_numeric"),
                numeric.number_text(w("gold_raw"), w("gold")),
            ),
            WORK + "resp_numtext": F.when(
                w("has_target"), numeric.number_text(w("resp_raw"), w("resp"))
            ),
            WORK + "resp_ascii": F.when(
                w("gold_coord").isNotNull(), numeric.ascii_digits(w("resp"))
            ),
        }
    )
    df = df.withColumns(
        {
            WORK + "gold_sci": numeric.scientific(w("gold_numtext")),
            WORK + "resp_sci": numeric.scientific(w("resp_numtext")),
        }
    )
    gold_nums = numeric.numbers(w("gold_numtext"), w("gold_sci"))
    resp_nums = numeric.numbers(w("resp_numtext"), w("resp_sci"))
    return df.withColumns(
        {
            WORK + "gold_num": F.get(gold_nums, F.lit(0)),
            WORK + "resp_nums": F.when(w("has_target"), resp_nums).otherwise(
                F.array().cast(NO_NUMBERS)
            ),
            WORK + "resp_coord": numeric.coordinate(w("resp_ascii")),
        }
    )


def add_numeric(df: DataFrame, th: Thresholds) -> DataFrame:
    """Numeric match, conflict and hedged alternatives (needs add_parsed_numbers)."""
    gold_coord, gold_num, nums = w("gold_coord"), w("gold_num"), w("resp_nums")
    target = F.coalesce(gold_coord, gold_num)
    hedged = (
        target.isNotNull() & (F.size(nums) >= 2) & numeric.offers_alternatives(w("resp"), th)
    )
    df = df.withColumns(
        {
            WORK + "numeric_match": numeric.numeric_match(
                w("resp_coord"), gold_coord, nums, gold_num, th
            ),
            WORK + "numeric_conflict": numeric.numeric_conflict(gold_coord, nums, gold_num, th),
            WORK + "alternatives": F.when(
                hedged, numeric.differing_numbers(nums, target, th)
            ).otherwise(F.array().cast(NO_NUMBERS)),
        }
    )
    return df.withColumn(WORK + "alternative_conflict", F.size(w("alternatives")) > 0)


def add_cues(df: DataFrame, th: Thresholds) -> DataFrame:
    """Negation, unavailability and atomic mismatch (needs the lexical and numeric columns)."""
    agrees = w("exact") | w("substring") | w("numeric_match")
    df = df.withColumns(
        {
            WORK + "negated": cues.negation_cue(w("resp"), w("gold")),
            WORK + "unavailable": cues.unavailability_cue(w("resp"), th),
            WORK + "atomic_gold": cues.atomic_gold(w("gold_raw"), w("gold"), th),
        }
    )
    return df.withColumns(
        {
            WORK + "unavailability_conflict": w("unavailable") & ~agrees,
            WORK + "atomic_mismatch": cues.atomic_mismatch(
                w("atomic_gold"), agrees, w("resp"), w("gold"), th
            ),
        }
    )


def add_signals(
    df: DataFrame,
    th: Thresholds,
    response: str = "model_response",
    gold: str = "correct_answer",
) -> DataFrame:
    """All deterministic signals."""
    df = add_lexical(add_canonical(df, response, gold), th)
    return add_cues(add_numeric(add_parsed_numbers(df), th), th)


def numeric_diagnostics(th: Thresholds) -> dict[str, Column]:
    """The three numeric checks as structs of fixed shape; NULL fields where a check was unused."""
    coord, num, nums = w("gold_coord"), w("gold_num"), w("resp_nums")
    first = F.get(nums, F.lit(0))
    target = F.coalesce(coord, num)
    match_mode = (
        F.when(coord.isNotNull() & w("resp_coord").isNotNull(), "coord")
        .when(coord.isNotNull() & first.isNotNull(), "coord_vs_num")
        .when(coord.isNotNull(), "coord_missing_resp_number")
        .when(num.isNotNull() & first.isNotNull(), "numeric")
    )
    conflict_mode = (
        F.when(coord.isNotNull() & first.isNull(), "coord_no_resp_numbers")
        .when(coord.isNotNull(), "coord_numbers_present")
        .when(num.isNotNull() & first.isNull(), "no_response_numbers")
        .when(num.isNotNull(), "numbers_present")
    )
    return {
        "numeric": F.struct(
            match_mode.isNotNull().alias("used"),
            match_mode.alias("mode"),
            F.when(match_mode.isNotNull(), target).alias("gold"),
            F.when(match_mode == "coord", w("resp_coord"))
            .when(match_mode.isNotNull(), first)
            .alias("resp"),
            w("numeric_match").alias("matched"),
        ),
        "numeric_conflict_if_present": F.struct(
            w("numeric_conflict").alias("flag"),
            conflict_mode.isNotNull().alias("used"),
            conflict_mode.alias("mode"),
            F.when(conflict_mode.isNotNull(), target).alias("gold"),
            F.when(conflict_mode.isNotNull(), nums).alias("resp_numbers"),
            F.when(
                conflict_mode.endswith("numbers_present"), ~w("numeric_conflict")
            ).alias("any_match"),
        ),
        "numeric_alternative_conflict": F.struct(
            w("alternative_conflict").alias("flag"),
            F.when(w("alternative_conflict"), target).alias("gold"),
            F.when(w("alternative_conflict"), w("alternatives")).alias("diff_alternatives"),
        ),
    }
