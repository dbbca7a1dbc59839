"""Number rules that every other module shares, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarframe.functions.columns import col


def half_up(x) -> Column:
    """Nearest integer, halves towards plus infinity (-2.5 gives -2)."""
    return F.floor(col(x) + F.lit(0.5))


def clamp(x, low, high) -> Column:
    return F.greatest(col(low), F.least(col(high), col(x)))


def positive_or_null(x) -> Column:
    """``x`` if it is a finite number above 0."""
    x = col(x).cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def step_at(sorted_array, share: float, of_last: bool) -> Column:
    """Element of a sorted array at ``floor(n * share)``, or ``floor((n - 1) * share)`` if ``of_last``; both rules are in use."""
    a = col(sorted_array)
    n = F.size(a)
    at = F.floor((n - 1 if of_last else n) * F.lit(share)).cast("int")
    return F.get(a, F.greatest(F.lit(0), F.least(n - 1, at)))


def modulo(x, n) -> Column:
    """Remainder with the sign of ``n``."""
    return F.pmod(col(x), col(n))


def next_power_of_two(n) -> Column:
    return F.when(col(n) <= 1, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(col(n))))).cast("long")


def wrap_phase(x) -> Column:
    """To [-pi, pi)."""
    x = col(x)
    turn = 2 * F.pi()
    return x - turn * F.floor((x + F.pi()) / turn)
