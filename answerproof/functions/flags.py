"""Labels as booleans, and reproducible randomness from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from answerproof.config import TRUE_WORDS
from answerproof.functions.text import as_col, strip


def as_bool(c: Column | str) -> Column:
    """true, 1, yes and y in any case are true; everything else, NULL included, is false."""
    return F.coalesce(F.lower(strip(as_col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def flag_of(df: DataFrame, name: str) -> Column:
    """A label column as a boolean; one that is boolean already is left to the optimiser as it is."""
    if isinstance(df.schema[name].dataType, BooleanType):
        return F.coalesce(F.col(name), F.lit(False))
    return as_bool(name)


def share(flag: Column | str) -> Column:
    """Share of true rows; NULL for no rows."""
    return F.avg(as_col(flag).cast("double"))


def key_text(seed: int, *parts: Column | str) -> Column:
    """Seed and key as one text. Different keys stay different: separators within a part are escaped, a
    missing part is marked."""

    def part(c: Column | str) -> Column:
        text = as_col(c).cast("string")
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws("|", F.lit(str(seed)), *[part(p) for p in parts])


def hash_key(seed: int, *parts: Column | str) -> Column:
    """Sampling order: the same rows in the same order on any cluster and in any SQL engine."""
    return F.md5(key_text(seed, *parts))


def uniform_of(digest: Column, first: int = 1) -> Column:
    """Uniform number in [0, 1) out of 13 hexadecimal digits of a hash, 52 random bits."""
    return F.conv(F.substring(digest, first, 13), 16, 10).cast("double") / F.lit(float(2**52))


def hash_uniform(seed: int, *parts: Column | str) -> Column:
    """Uniform number in [0, 1) with 52 random bits."""
    return uniform_of(hash_key(seed, *parts))


def cosine(u: Column | str, v: Column | str) -> Column:
    """Cosine in double precision; 0 for missing, empty, unequal or zero vectors."""
    u = as_col(u).cast("array<double>")
    v = as_col(v).cast("array<double>")

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    norm_u, norm_v = dot(u, u), dot(v, v)
    usable = (F.size(u) > 0) & (F.size(u) == F.size(v)) & (norm_u > 0) & (norm_v > 0)
    return F.when(usable, dot(u, v) / (F.sqrt(norm_u) * F.sqrt(norm_v))).otherwise(F.lit(0.0))
