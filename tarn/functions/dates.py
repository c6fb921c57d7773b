"""Parts of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(dt: Column, after: str, before: str) -> Column:
    """Strictly between two dates taken as midnights."""
    return (dt > F.lit(after).cast("timestamp_ntz")) & (dt < F.lit(before).cast("timestamp_ntz"))


def month_day(dt: Column) -> Column:
    return F.date_format(dt, "MM-dd")


def month_label(month: Column) -> Column:
    """1 as Jan."""
    return F.date_format(F.make_date(F.lit(2001), month, F.lit(1)), "MMM")


def wall_clock(text: Column) -> Column:
    """The local time of a text such as 2015-02-24 11:35:52 -0800; its offset is left out."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def part_of_day(hour: Column) -> Column:
    """morning from 5, afternoon from 12, night from 19; all else, null too, is dawn."""
    return F.when(hour.between(5, 11), "morning").when(hour.between(12, 18), "afternoon").when(hour.between(19, 24), "night").otherwise("dawn")


PARTS = ["morning", "afternoon", "night", "dawn"]


def part_order(part: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PARTS)), part).cast("int")
