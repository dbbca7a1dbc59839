"""What an argument of a column function may be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column, a column's name, or a number as a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an outer expression is evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
