"""Numbers, powers of ten and coordinates in canonical text, and how they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerproof.config import Thresholds
from answerproof.functions.text import (
    as_col,
    canonical,
    foreign_digits,
    is_ascii,
    text_or_empty,
)

# Superscript characters and the plain characters they stand for.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻"
SUPERSCRIPTS_PLAIN = "0123456789+-"

# The number formats. Canonical text has single spaces and neither brackets nor "*",
# so the patterns need not allow for them.
PLAIN_NUMBER = r"(?U)(?<!\w)([+-]?[0-9]+(?:\.[0-9]+)?)(?!\w)"
E_NOTATION = r"(?U)\b[+-]?[0-9]+(?:\.[0-9]+)? ?e ?[+-]?[0-9]+\b"
TIMES_POWER = r"(?U)\b[+-]?[0-9]+(?:\.[0-9]+)? ?x ?10 ?\^ ?[+-]?[0-9]+\b"
BARE_POWER = r"(?U)\b10 ?\^ ?[+-]?[0-9]+\b"
COORDINATE = (
    r"(?U)\b([+-]?[0-9]+(?:\.[0-9]+)?) ?(?:deg(?:rees?)?)? ?"
    r"(n|s|e|w|north|south|east|west)\b"
)
IMPLICIT_POWER = r"(?U)\b10([+-]?\d{1,4})\b"

INTEGER_EPS = 1e-9
INFINITY = float("inf")


def ascii_digits(can: Column) -> Column:
    """Digits of any script as 0-9, so that they can be cast."""
    foreign, plain = foreign_digits()
    return F.when(is_ascii(can), can).otherwise(F.translate(can, foreign, plain))


def number_text(raw: Column | str, can: Column | str) -> Column:
    """The text numbers are read from, with ASCII digits.

    It is the canonical text, unless the raw text has superscripts: then powers written like
    10⁻²¹ are first spelled out with a caret, which needs a second canonical form.
    """
    raw, can = text_or_empty(raw), as_col(can)
    spelled = F.translate(raw, SUPERSCRIPTS + "×−–—", SUPERSCRIPTS_PLAIN + "x---")
    rewritten = canonical(F.regexp_replace(spelled, IMPLICIT_POWER, "10^$1"))
    superscripts = ~is_ascii(raw) & raw.rlike(f"[{SUPERSCRIPTS}]")
    return F.when(superscripts, ascii_digits(rewritten)).otherwise(ascii_digits(can))


def _double(text: Column) -> Column:
    """Cast of a matched number; NULL for the empty string regexp_extract gives on no match."""
    return F.nullif(F.replace(text, F.lit(" "), F.lit("")), F.lit("")).cast("double")


def _power(exponent: Column) -> Column:
    """10 to the exponent; NULL beyond the range of a double."""
    value = F.pow(F.lit(10.0), exponent)
    return F.when(value < INFINITY, value)


def scientific(numtext: Column | str) -> Column:
    """Value of the first power-of-ten notation found: 1e-21, else 1.2x10^-3, else 10^-21."""
    t = as_col(numtext)
    e_hit = F.regexp_extract(t, E_NOTATION, 0)
    times_hit = F.regexp_extract(t, TIMES_POWER, 0)
    power_hit = F.regexp_extract(t, BARE_POWER, 0)
    e_value = _double(F.substring_index(e_hit, "e", 1)) * _power(
        _double(F.substring_index(e_hit, "e", -1))
    )
    times_value = _double(F.substring_index(times_hit, "x", 1)) * _power(
        _double(F.substring_index(times_hit, "^", -1))
    )
    power_value = _power(_double(F.substring_index(power_hit, "^", -1)))
    with_caret = F.when(times_hit != "", times_value).otherwise(power_value)
    return F.when(t.rlike(r"[0-9] ?e ?[+-]?[0-9]") & (e_hit != ""), e_value).when(
        t.contains("^"), with_caret
    )


def numbers(numtext: Column | str, sci: Column | str) -> Column:
    """The scientific value first, if any, then every plain number in order."""
    t, sci = as_col(numtext), as_col(sci)
    plain = F.regexp_extract_all(t, F.lit(PLAIN_NUMBER), F.lit(1)).cast("array<double>")
    return F.when(sci.isNull(), plain).otherwise(F.concat(F.array(sci), plain))


def coordinate(can: Column | str) -> Column:
    """Degrees north or east; south and west are negative. NULL if no direction follows a number.

    Takes canonical text with ASCII digits, as does looks_numeric.
    """
    t = as_col(can)
    size = F.abs(_double(F.regexp_extract(t, COORDINATE, 1)))
    direction = F.regexp_extract(t, COORDINATE, 2)
    value = F.when(direction.isin("s", "south", "w", "west"), -size).otherwise(size)
    # the patterns above cannot match without this much, which most texts lack
    return F.when(t.rlike("[0-9] ?[dnsew]"), value)


def looks_numeric(can: Column | str) -> Column:
    """Has a digit and nothing but digits, spaces, ``. - + ^ /`` and the letter e."""
    t = as_col(can)
    return t.rlike("[0-9]") & ~t.rlike(r"[^0-9 .\-+^/e]")


def _integerish(x: Column) -> Column:
    return (F.abs(x) < INFINITY) & (F.abs(x - F.rint(x)) <= INTEGER_EPS)


def _both_strict_integers(x: Column, g: Column) -> Column:
    large = (F.abs(F.rint(x)) >= 100) | (F.abs(F.rint(g)) >= 100)
    return _integerish(x) & _integerish(g) & large


def close(x: Column, g: Column, th: Thresholds) -> Column:
    """Symmetric tolerance, relative or absolute, whichever is wider."""
    gap = F.abs(x - g)
    allowed = F.greatest(
        F.lit(th.numeric_rel_tol) * F.greatest(F.abs(x), F.abs(g)), F.lit(th.numeric_abs_tol)
    )
    return (x == g) | ((gap < INFINITY) & (gap <= allowed))


def same_number(x: Column, g: Column, th: Thresholds) -> Column:
    """Equal as integers once either reaches 100 (years, identifiers), else within tolerance."""
    return F.when(_both_strict_integers(x, g), F.rint(x) == F.rint(g)).otherwise(close(x, g, th))


def numeric_match(
    resp_coord: Column, gold_coord: Column, resp_nums: Column, gold_num: Column, th: Thresholds
) -> Column:
    """Does the *first* number of the response equal the gold number?

    ``gold_num`` must be NULL unless the gold answer is numeric; ``gold_coord`` wins if set.
    """
    first = F.slice(resp_nums, 1, 1)
    return F.coalesce(
        F.when(
            gold_coord.isNotNull(), F.coalesce(resp_coord, F.get(first, F.lit(0))) == gold_coord
        ).when(gold_num.isNotNull(), F.exists(first, lambda x: same_number(x, gold_num, th))),
        F.lit(False),
    )


def numeric_conflict(
    gold_coord: Column, resp_nums: Column, gold_num: Column, th: Thresholds
) -> Column:
    """The response gives numbers and *none* of them is the gold number."""
    agrees = F.when(
        gold_coord.isNotNull(), F.exists(resp_nums, lambda x: x == gold_coord)
    ).otherwise(F.exists(resp_nums, lambda x: same_number(x, gold_num, th)))
    has_target = gold_coord.isNotNull() | gold_num.isNotNull()
    return F.when(has_target & (F.size(resp_nums) > 0), ~agrees).otherwise(F.lit(False))


def differing_numbers(resp_nums: Column, target: Column, th: Thresholds) -> Column:
    """Numbers that differ from the target; coordinates are compared with tolerance here."""
    return F.filter(resp_nums, lambda x: ~same_number(x, target, th))


def offers_alternatives(resp_can: Column | str, th: Thresholds) -> Column:
    padded = F.concat(F.lit(" "), as_col(resp_can), F.lit(" "))
    hit = F.lit(False)
    for marker in th.numeric_alt_markers:
        hit = hit | padded.contains(f" {marker} ")
    return hit
