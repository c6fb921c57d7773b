"""Traffic queries over the shipping months of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.dates import month_label
from tarn.functions.numeric import percent_label, thousands
from tarn.functions.spline import grid, knot_weights, weights
from tarn.operators import traffic as T
from tarn.sources import readers

#: Points of the curves by year, four a month; their SQL knows years of so many first months at least.
QUARTER_MONTHS, MONTHS_LEAST = tuple(grid(points=45).tolist()), 10
AFTER, FIRST, BEFORE, SPLIT = "1994-12-31", "1995-01-01", "2001-01-01", 3


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.whole_years(readers.traffic(spark, sf_dir, FIRST, BEFORE), AFTER, BEFORE)


def traffic_ratio_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.passengers_per_flight(_months(spark, sf_dir)).orderBy("year")


def traffic_outer_join_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.passengers_per_flight_joined(_months(spark, sf_dir)).orderBy("year")


def traffic_lollipop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lollipop(_months(spark, sf_dir))


def traffic_daily_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.daily_averages(_months(spark, sf_dir)).orderBy("year")


def traffic_masked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.masked_segments(_months(spark, sf_dir), SPLIT)


def traffic_season_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.season_extremes(_months(spark, sf_dir)).orderBy("month_day")


def traffic_season_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.season_band(_months(spark, sf_dir))
    return made.select("k", F.round("x", 6).alias("x"), F.round("smooth_max", 6).alias("smooth_max"), F.round("smooth_min", 6).alias("smooth_min")).orderBy("k")


def traffic_season_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seasonal curve a year, the last year with the months that it has."""
    months = T.whole_years(readers.traffic(spark, sf_dir, FIRST), AFTER, "2100-01-01")
    made = T.season_band(months, "year", QUARTER_MONTHS)
    return made.withColumns({c: F.round(c, 6) for c in ("smooth_max", "smooth_min")}).orderBy("year", "k")


def traffic_yoy_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order value by year and its change, over years without orders."""
    orders = readers.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100, 0).cast("long").alias("cents"))
    sums = orders.groupBy("customer", "year").agg(F.sum("cents").alias("cents"))
    made = T.filled_changes(T.with_gaps(sums, "customer", "year"), "year", "cents", by="customer")
    return made.withColumn("pct_change_cents", F.round("pct_change_cents", 8))


def traffic_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.yearly_changes(_months(spark, sf_dir))
    return made.withColumns({c: F.round(c, 8) for c in ("pct_change_asm", "pct_change_rpm")})


def traffic_axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.yearly_changes(_months(spark, sf_dir)).withColumn("month", (F.col("position") + 1).cast("int"))
    return made.select("position", thousands(F.col("total_asm")).alias("asm_label"), percent_label(F.col("pct_change_asm")).alias("change_label"), month_label(F.col("month")).alias("month_label"))


_MONTHS = f"""months AS ({readers.TRAFFIC_SQL}),
t AS (SELECT *, CAST(year(dt) AS INTEGER) AS year FROM months WHERE dt > TIMESTAMP '{AFTER} 00:00:00' AND dt < TIMESTAMP '{BEFORE} 00:00:00')"""


def _sums(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


_FLOWS = [f"{m}_{s}" for s in T.SIDES for m in ("flights", "passengers")]
_AVERAGES = ", ".join(f"round_even(CAST(passengers_{s} AS DOUBLE) / nullif(flights_{s}, 0), 2) AS avg_pas_flight_{n}" for s, n in zip(T.SIDES, ("dom", "int"), strict=True))
_RATIO = f"WITH {_MONTHS}, y AS (SELECT year, {_sums(*_FLOWS)} FROM t GROUP BY year) SELECT *, {_AVERAGES} FROM y"
_DAILY = f"""WITH {_MONTHS},
u AS (SELECT year, CAST(sum(flights_domestic + flights_international) AS BIGINT) AS total_flights, CAST(sum(passengers_domestic + passengers_international) AS BIGINT) AS total_passengers FROM t GROUP BY year),
d AS (SELECT *, round_even(total_flights / 365, 2) AS avr_daily_flights, round_even(total_passengers / 365, 2) AS avr_daily_passengers FROM u)"""
_YEARLY = f"""WITH {_MONTHS},
u AS (SELECT year, CAST(sum(asm_domestic + asm_international) AS BIGINT) AS total_asm, CAST(sum(rpm_domestic + rpm_international) AS BIGINT) AS total_rpm FROM t GROUP BY year),
c AS (SELECT *, CAST(total_asm AS DOUBLE) / lag(total_asm) OVER (ORDER BY year) - 1 AS pa, CAST(total_rpm AS DOUBLE) / lag(total_rpm) OVER (ORDER BY year) - 1 AS pr, CAST(row_number() OVER (ORDER BY year) - 2 AS INTEGER) AS position FROM u)"""
_SEASON = f"""WITH {_MONTHS},
s AS (SELECT strftime(dt, '%m-%d') AS month_day, max(passengers_domestic + passengers_international) AS max_passengers, min(passengers_domestic + passengers_international) AS min_passengers FROM t GROUP BY 1)"""
_COLUMNS = ("year", "avr_daily_flights", "avr_daily_passengers")


def _spline_sql() -> str:
    lines = ", ".join(f"({k}, {float(x)!r}::DOUBLE, [{', '.join(f'{float(w)!r}::DOUBLE' for w in line)}])" for k, (x, line) in enumerate(zip(grid(), weights(), strict=True)))
    sums = ", ".join(f"round(sum(w[CAST(substr(month_day, 1, 2) AS INTEGER)] * {e}_passengers / 1e6), 6) AS smooth_{e}" for e in ("max", "min"))
    return f"{_SEASON}, g(k, x, w) AS (VALUES {lines}) SELECT k, round(x, 6) AS x, {sums} FROM g, s GROUP BY k, x"


def _by_year_sql() -> str:
    """The curves of years whose months are the first ones, four at least."""
    lines = ", ".join(
        f"({n}, {k}, {p!r}::DOUBLE, [{', '.join('NULL::DOUBLE' if w != w else f'{float(w)!r}::DOUBLE' for w in line)}])"
        for n in range(MONTHS_LEAST, 13)
        for k, (p, line) in enumerate(zip(QUARTER_MONTHS, knot_weights(tuple(map(float, range(1, n + 1))), QUARTER_MONTHS), strict=True))
    )
    months = f"m AS ({readers.TRAFFIC_SQL}), t AS (SELECT CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month, passengers_domestic + passengers_international AS p FROM m)"
    each = "s AS (SELECT year, month, max(p) AS hi, min(p) AS lo FROM t GROUP BY 1, 2), c AS (SELECT year, CAST(count(*) AS INTEGER) AS n FROM s GROUP BY 1)"
    sums = ", ".join(f"round(sum(w[month] * {v} / 1e6), 6) AS smooth_{e}" for e, v in (("max", "hi"), ("min", "lo")))
    return f"WITH {months}, {each}, g(n, k, x, w) AS (VALUES {lines}) SELECT s.year, k, x, {sums} FROM s JOIN c ON c.year = s.year JOIN g ON g.n = c.n GROUP BY s.year, k, x"


QUERIES = {f.__name__: f for f in (traffic_ratio_by_year, traffic_outer_join_by_year, traffic_lollipop, traffic_daily_avg, traffic_masked_segments, traffic_season_minmax, traffic_season_spline, traffic_season_by_year, traffic_yoy, traffic_yoy_filled, traffic_axis_labels)}
SQL = {
    "traffic_ratio_by_year": _RATIO,
    "traffic_outer_join_by_year": f"""WITH {_MONTHS},
a AS (SELECT year, {_sums('flights_domestic', 'passengers_domestic')} FROM t GROUP BY year),
b AS (SELECT year, {_sums('flights_international', 'passengers_international')} FROM t GROUP BY year)
SELECT *, {_AVERAGES} FROM a FULL OUTER JOIN b USING (year)""",
    "traffic_lollipop": f"SELECT year, avg_pas_flight_dom, avg_pas_flight_int, CAST(row_number() OVER (ORDER BY year DESC) AS INTEGER) AS position FROM ({_RATIO}) q",
    "traffic_daily_avg": f"{_DAILY} SELECT * FROM d",
    "traffic_masked_segments": f"{_DAILY}, p AS (SELECT *, CAST(row_number() OVER (ORDER BY year) - 1 AS INTEGER) AS position FROM d) SELECT position, "
    + ", ".join([f"CASE WHEN position >= {SPLIT} THEN {c} END AS {c}_late" for c in _COLUMNS] + [f"CASE WHEN position <= {SPLIT} THEN {c} END AS {c}_early" for c in _COLUMNS])
    + " FROM p",
    "traffic_season_minmax": f"{_SEASON} SELECT * FROM s",
    "traffic_season_spline": _spline_sql(),
    "traffic_season_by_year": _by_year_sql(),
    "traffic_yoy_filled": """WITH s AS (SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(round(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2),
y AS (SELECT CAST(unnest(range((SELECT min(year) FROM s), (SELECT max(year) FROM s) + 1)) AS INTEGER) AS year),
g AS (SELECT c.customer, y.year, s.cents FROM (SELECT DISTINCT customer FROM s) c CROSS JOIN y LEFT JOIN s ON s.customer = c.customer AND s.year = y.year),
f AS (SELECT *, last_value(cents IGNORE NULLS) OVER (PARTITION BY customer ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_cents FROM g)
SELECT *, round(CAST(filled_cents AS DOUBLE) / lag(filled_cents) OVER (PARTITION BY customer ORDER BY year) - 1, 8) AS pct_change_cents FROM f""",
    "traffic_yoy": f"{_YEARLY} SELECT year, total_asm, total_rpm, round(pa, 8) AS pct_change_asm, round(pr, 8) AS pct_change_rpm, position, position + CAST(0.3 AS DOUBLE) AS position_right FROM c WHERE position >= 0",
    "traffic_axis_labels": f"{_YEARLY} SELECT position, format('{{:,}}', total_asm) AS asm_label, printf('%.0f%%', round_even(pa * 100, 0)) AS change_label, strftime(make_date(2001, position + 1, 1), '%b') AS month_label FROM c WHERE position >= 0",
}
