"""Evaluate an expression once for a row, however often a lambda uses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use(struct of the values)``.

    A column named in the body of a lambda is replaced by its expression when projections are merged, and
    is then evaluated for every element. As a lambda variable it has its value by then, and nothing can be
    merged into it.
    """
    held = F.struct(*[c.alias(name) for name, c in values.items()])
    return F.get(F.transform(F.array(held), use), F.lit(0))
