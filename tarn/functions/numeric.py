"""Rounding, division, sums and bins as pandas users expect them, on nulls too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 20


def half_even(x: Column, digits: int = 0) -> Column:
    """``x`` rounded half to even (2.5 gives 2, 0.125 gives 0.12)."""
    return F.bround(x.cast("double"), digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def total(x: Column) -> Column:
    """A sum that skips nulls and is 0 over nulls only."""
    return F.coalesce(F.sum(x), F.lit(0))


def bin_of(x: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """The bin, from 1, of equal-width bins over [low, high]; the last one is closed.

    If low equals high the range is widened by half a unit each way, as numpy does.
    """
    flat = low == high
    lo = F.when(flat, low - 0.5).otherwise(low.cast("double"))
    hi = F.when(flat, high + 0.5).otherwise(high.cast("double"))
    return F.least(F.floor((x - lo) * bins / (hi - lo)).cast("int") + 1, F.lit(bins))


def bin_edge(k: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """The lower edge of bin ``k`` (the upper one of k - 1)."""
    flat = low == high
    lo = F.when(flat, low - 0.5).otherwise(low.cast("double"))
    hi = F.when(flat, high + 0.5).otherwise(high.cast("double"))
    return lo + (k - 1) * (hi - lo) / bins


def percent_change(x: Column, before: Column) -> Column:
    """x / before - 1; null without a previous value."""
    return ratio(x, before) - 1


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def percent_label(x: Column) -> Column:
    """0.125 as 12%: rounded half to even before it is printed. A small loss is -0%: bround would drop the sign of a zero."""
    return F.format_string("%.0f%%", F.rint(x * 100))
