"""Monthly traffic by year and by season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.dates import month_day, within
from tarn.functions.numeric import half_even, percent_change, ratio, total
from tarn.functions.spline import curve_through, grid

SIDES = ("domestic", "international")
DAYS = 365


def whole_years(df: DataFrame, after: str, before: str) -> DataFrame:
    """Rows strictly between two midnights, and their year."""
    return df.where(within(F.col("dt"), after, before)).withColumn("year", F.year("dt"))


def sums_by_year(df: DataFrame, *columns: str) -> DataFrame:
    known = df.where(F.col("year").isNotNull())
    return known.groupBy("year").agg(*(total(F.col(c)).alias(c) for c in columns))


def _averages(df: DataFrame) -> DataFrame:
    for side, short in zip(SIDES, ("dom", "int"), strict=True):
        df = df.withColumn(f"avg_pas_flight_{short}", half_even(ratio(F.col(f"passengers_{side}"), F.col(f"flights_{side}")), 2))
    return df


def passengers_per_flight(df: DataFrame) -> DataFrame:
    """Yearly sums of both sides and their ratios, in one aggregate."""
    return _averages(sums_by_year(df, *(f"{m}_{s}" for s in SIDES for m in ("flights", "passengers"))))


def passengers_per_flight_joined(df: DataFrame) -> DataFrame:
    """The same as two aggregates side by side: a full outer join on the year."""
    one, two = (sums_by_year(df, f"flights_{s}", f"passengers_{s}") for s in SIDES)
    return _averages(one.join(two, "year", "full_outer"))


def lollipop(df: DataFrame) -> DataFrame:
    """Ratios by year, the last year first, with positions from 1."""
    made = passengers_per_flight(df).select("year", "avg_pas_flight_dom", "avg_pas_flight_int")
    return made.withColumn("position", F.row_number().over(Window.orderBy(F.desc("year")))).orderBy("position")


def with_totals(df: DataFrame, *measures: str) -> DataFrame:
    """``total_<measure>``: both sides added in each row; null if either is."""
    return df.withColumns({f"total_{m}": F.col(f"{m}_domestic") + F.col(f"{m}_international") for m in measures})


def daily_averages(df: DataFrame) -> DataFrame:
    sums = sums_by_year(with_totals(df, "flights", "passengers"), "total_flights", "total_passengers")
    return sums.withColumns({f"avr_daily_{m}": half_even(F.col(f"total_{m}") / DAYS, 2) for m in ("flights", "passengers")})


def masked_segments(df: DataFrame, at: int = 6) -> DataFrame:
    """Daily averages split at a row position: ``early`` up to it and ``late`` from it, which both share.

    Where a segment does not reach, its year and values are null.
    """
    placed = daily_averages(df).withColumn("position", F.row_number().over(Window.orderBy("year")) - 1)
    columns = ("year", "avr_daily_flights", "avr_daily_passengers")
    late = {f"{c}_late": F.when(~(F.col("position") < at), F.col(c)) for c in columns}
    early = {f"{c}_early": F.when(~(F.col("position") > at), F.col(c)) for c in columns}
    return placed.withColumns(late | early).select("position", *late, *early)


def season_extremes(df: DataFrame, by: str | None = None) -> DataFrame:
    """The largest and smallest monthly passengers by (``by`` and) month and day, in one aggregate."""
    keys = [by] if by else []
    made = with_totals(df, "passengers").select(*keys, month_day(F.col("dt")).alias("month_day"), "total_passengers")
    return made.where("month_day is not null").groupBy(*keys, "month_day").agg(F.max("total_passengers").alias("max_passengers"), F.min("total_passengers").alias("min_passengers"))


def season_band(df: DataFrame, by: str | None = None, points: Sequence[float] = tuple(grid().tolist())) -> DataFrame:
    """The extremes in millions, smoothed by a spline over the months: (by,) k, x, smooth_max, smooth_min.

    A curve for each value of ``by``, and one row for each of ``points``. The knots are the months
    that have passengers: others are interpolated over, and before the first and after the last one
    the curve is null. Several days of a month are one knot, by their largest and smallest value.
    """
    keys = [by] if by else []
    months = season_extremes(df, by).withColumn("month", F.substring("month_day", 1, 2).cast("double"))
    ends = {"max": F.max("max_passengers"), "min": F.min("min_passengers")}
    knots = months.groupBy(*keys, "month").agg(*(made.alias(end) for end, made in ends.items())).where("max is not null")
    curves = knots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", *ends))).alias("knots"))  # twelve at most
    through = curve_through(tuple(map(float, points)))
    curves = curves.where(F.size("knots") > 0).select(*keys, *(through("knots.month", F.transform(f"knots.{end}", lambda v: v / 1e6)).alias(end) for end in ends))
    each = curves.select(*keys, F.posexplode(F.arrays_zip(*ends)).alias("k", "at"))
    x = F.get(F.lit([float(p) for p in points]), F.col("k"))
    return each.select(*keys, "k", x.alias("x"), *(F.col(f"at.{end}").alias(f"smooth_{end}") for end in ends))


def filled_changes(df: DataFrame, order: str, *columns: str, by: str | None = None) -> DataFrame:
    """``filled_<column>`` and ``pct_change_<column>`` of rows in the order of ``order`` (within ``by``).

    A null takes the last value before it, and the change is that of the filled values: 1, null, 2
    changes by null, 0, 1. Nulls before the first value stay. Rows with a null ``by`` are a group.
    """
    window = Window.partitionBy(by).orderBy(order) if by else Window.orderBy(order)
    filled = df.withColumns({f"filled_{c}": F.last(c, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in columns})
    return filled.withColumns({f"pct_change_{c}": percent_change(F.col(f"filled_{c}"), F.lag(f"filled_{c}").over(window)) for c in columns})


def with_gaps(df: DataFrame, by: str, year: str) -> DataFrame:
    """``df`` and a row of nulls for each year that a value of ``by`` lacks between the first and the last of all years."""
    span = df.agg(F.min(year).alias("low"), F.max(year).alias("high"))
    years = df.select(by).distinct().crossJoin(F.broadcast(span)).select(by, F.explode(F.sequence("low", "high")).alias(year))
    return years.join(df, [by, year], "left")


def yearly_changes(df: DataFrame) -> DataFrame:
    """Yearly seat and revenue miles and their change on the year before; the first year has none."""
    sums = sums_by_year(with_totals(df, "asm", "rpm"), "total_asm", "total_rpm")
    by_year = Window.orderBy("year")
    changes = {f"pct_change_{m}": percent_change(F.col(f"total_{m}"), F.lag(f"total_{m}").over(by_year)) for m in ("asm", "rpm")}
    placed = sums.withColumns(changes).withColumn("position", F.row_number().over(by_year) - 2)
    return placed.where("position >= 0").withColumn("position_right", F.col("position") + F.lit(0.3))
