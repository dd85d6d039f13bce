"""Small column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    A column expression used twice is evaluated twice when the optimizer merges projections;
    a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, as the scoring rules expect."""
    return F.bround(value, digits)
