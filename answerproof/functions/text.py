"""Text columns: canonical form, tokens and lexical overlap.

Every function takes and returns columns, so the result stays inside the JVM. Patterns are written
for *canonical* text (single spaces, lower case, no marks), which is what the rules compare.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerproof.config import ANSWER_STOPWORDS, Thresholds

ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"

# Everything Python's str.strip() and str.isspace() treat as blank.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Where str.splitlines() breaks a line.
LINE_BREAK = "\\r\\n|[\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"

# Fixed value: punctuation a canonical text keeps. Anything but it, letters, digits and "_" separates
# tokens.
KEPT_PUNCTUATION = "-./^+:="
_DROPPED_ASCII = "".join(
    chr(p) for p in range(128) if not (chr(p).isalnum() or chr(p) in KEPT_PUNCTUATION + "_ ")
)
_DROPPED = r"[^\p{L}\p{N}_\-./^+:= ]+"

# A token Python's float() accepts: digits may be grouped by single underscores.
_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
NUMERIC_TOKEN = (
    rf"[+-]?(?:nan|inf|infinity|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)"
)
# Tokens without content: stop words, numbers, single characters. Whole tokens only.
EMPTY_TOKEN = rf"(?<![^ ])(?:{'|'.join(ANSWER_STOPWORDS)}|{NUMERIC_TOKEN}|[^ ])(?![^ ])"


@functools.cache
def combining_class_pattern() -> str:
    """Character class of all code points with a non-zero combining class, as ranges.

    They are all marks, and asking for that first spares other characters the search.
    """
    ranges: list[list[int]] = []
    for point in range(0x300, 0x1F000):
        if unicodedata.combining(chr(point)):
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    return "[\\p{M}&&[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]]+"


@functools.cache
def foreign_digits() -> tuple[str, str]:
    """Decimal digits outside ASCII and, position by position, the ASCII digit each stands for."""
    points = [p for p in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(p)) == "Nd"]
    chars = "".join(map(chr, points))
    return chars, "".join(str(unicodedata.decimal(c)) for c in chars)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Both ends, all blanks (Spark's plain trim removes U+0020 only)."""
    return F.trim(as_col(c), F.lit(BLANKS))


def is_ascii(c: Column) -> Column:
    """As many bytes as characters. Far cheaper than a regular expression."""
    return F.octet_length(c) == F.char_length(c)


def _icu(method: str, c: Column) -> Column:
    return F.reflect(F.lit(ICU_NORMALIZER), F.lit(method), c, F.lit(True))


def canonical(c: Column | str) -> Column:
    """Comparable form: compatibility-normalised, lower case, no accents, little punctuation.

    Kept punctuation: ``- . / ^ + : =`` (codes, dates and scientific notation). ASCII rows, the
    usual case, skip Unicode normalisation. Materialise the result as a column of its own before
    using it twice: the Unicode branch is opaque to the optimiser.
    """
    raw = text_or_empty(c)
    plain = F.translate(F.lower(raw), _DROPPED_ASCII, " " * len(_DROPPED_ASCII))
    composed = F.translate(_icu("compose", raw), "×−–—", "x---")
    bare = F.regexp_replace(
        _icu("decompose", F.lower(composed)), combining_class_pattern(), ""
    )
    unicode_form = F.regexp_replace(bare, _DROPPED, " ")
    spaced = F.when(is_ascii(raw), plain).otherwise(unicode_form)
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def tokens(can: Column | str) -> Column:
    can = as_col(can)
    return F.when(can == "", F.array().cast("array<string>")).otherwise(F.split(can, " "))


def token_count(can: Column | str) -> Column:
    """Number of tokens, without building the array."""
    can = as_col(can)
    spaces = F.length(can) - F.length(F.replace(can, F.lit(" "), F.lit("")))
    return F.when(can == "", F.lit(0)).otherwise(spaces + 1)


def content_tokens(can: Column | str) -> Column:
    """Tokens that carry meaning: no stop words, no numbers, no single characters."""
    return F.array_remove(F.split(F.regexp_replace(as_col(can), EMPTY_TOKEN, ""), " "), "")


def shared_content_count(resp_can: Column | str, gold_can: Column | str) -> Column:
    """Distinct content tokens both sides have."""
    return F.size(F.array_intersect(content_tokens(resp_can), content_tokens(gold_can)))


def jaccard(a_toks: Column | str, b_toks: Column | str) -> Column:
    a, b = as_col(a_toks), as_col(b_toks)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(both / F.size(F.array_union(a, b)))
    )


def contains_canonical(resp_can: Column | str, gold_can: Column | str) -> Column:
    resp, gold = as_col(resp_can), as_col(gold_can)
    return (resp != "") & (gold != "") & resp.contains(gold)


def token_subsequence(
    resp_can: Column | str,
    gold_can: Column | str,
    resp_toks: Column | str,
    gold_toks: Column | str,
    th: Thresholds,
) -> Column:
    """Gold tokens appear in the response in order, gaps allowed.

    The walk over the response runs only if its first and last gold token occur at all.
    """
    resp, gold = as_col(resp_can), as_col(gold_can)
    rt, gt = as_col(resp_toks), as_col(gold_toks)
    if not th.allow_token_subsequence:
        return F.lit(False)
    walked = F.aggregate(
        rt, F.lit(0), lambda j, t: F.when(t == F.get(gt, j), j + 1).otherwise(j)
    )
    possible = (
        (F.length(gold) >= th.subseq_min_gold_chars)
        & (F.length(resp) <= th.subseq_max_answer_chars)
        & (F.size(gt) > 0)
        & (F.size(rt) >= F.size(gt))
        & F.array_contains(rt, F.get(gt, F.lit(0)))
        & F.array_contains(rt, F.get(gt, F.size(gt) - 1))
    )
    return F.when(possible, walked == F.size(gt)).otherwise(F.lit(False))


def quoted_alternatives(phrases: tuple[str, ...]) -> str:
    return "|".join(re.escape(p) for p in phrases)
