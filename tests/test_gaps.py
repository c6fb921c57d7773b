"""Curves over missing months, changes over gaps, exact quantiles, stems as expressions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import spline, stem
from tarn.functions import text as X
from tarn.operators import profile, traffic


def not_a_knot(x, y, at):
    """All coefficients of the pieces from one system: values, slopes, bends, and equal third derivatives at the ends."""
    n, rows, right = len(x) - 1, [], []

    def term(i, t, order):
        row = np.zeros(4 * n)
        for p in range(order, 4):
            row[4 * i + p] = np.prod(range(p - order + 1, p + 1)) * t ** (p - order)
        return row

    for i in range(n):
        h = x[i + 1] - x[i]
        rows += [term(i, 0, 0), term(i, h, 0)]
        right += [y[i], y[i + 1]]
        if i < n - 1:
            rows += [term(i, h, order) - term(i + 1, 0, order) for order in (1, 2)]
            right += [0, 0]
    rows += [term(0, 0, 3) - term(1, 0, 3), term(n - 2, 0, 3) - term(n - 1, 0, 3)]
    c = np.linalg.solve(np.array(rows), np.array([*right, 0, 0])).reshape(n, 4)
    out = []
    for a in at:
        i = min(max(int(np.searchsorted(x, a, side="right")) - 1, 0), n - 1)
        out.append(float(np.polyval(c[i][::-1], a - x[i])) if x[0] <= a <= x[-1] else None)
    return out


def months(spark, values):
    """values: (year, month, day, passengers)"""
    rows = [(dt.datetime(y, m, d), y, p, 0) for y, m, d, p in values]
    return spark.createDataFrame(rows, "dt timestamp_ntz, year int, passengers_domestic long, passengers_international long")


@pytest.mark.parametrize("gone", [(), (6,), (1, 2), (12,), (3, 4, 9)])
def test_missing_months_are_interpolated_over(spark, gone):
    draw = random.Random(len(gone))
    values = [(y, m, 1, draw.randint(10**6, 10**8)) for y in (2003, 2004) for m in range(1, 13) if m not in gone]
    points = tuple(np.linspace(1, 12, 30).tolist())
    made = {r.k: r for r in traffic.season_band(months(spark, values), points=points).collect()}
    knots = [m for m in range(1, 13) if m not in gone]
    for end, pick in (("smooth_max", max), ("smooth_min", min)):
        y = [pick(p for _, m, _, p in values if m == k) / 1e6 for k in knots]
        want = not_a_knot(np.array(knots, float), y, points)
        assert [made[k].x for k in range(30)] == list(points)
        for k, w in enumerate(want):
            assert (made[k][end] is None) == (w is None) and (w is None or abs(made[k][end] - w) < 1e-8)


def test_days_of_a_month_are_one_knot_and_curves_stand_by_year(spark):
    one = [(2003, m, 1, 1_000_000 * m) for m in range(1, 13)]
    more = [(2003, 5, 20, 9_000_000), (2004, 3, 1, 4_000_000), (2004, 6, 1, 7_000_000), (2005, 8, 1, None)]
    made = traffic.season_band(months(spark, [*one, *more]), "year", (1.0, 3.0, 4.5, 5.0, 6.0, 12.0)).collect()
    got = {(r.year, r.x): (r.smooth_max, r.smooth_min) for r in made}
    assert got[2003, 5.0] == pytest.approx((9.0, 5.0)) and got[2003, 12.0] == pytest.approx((12.0, 12.0))
    assert got[2004, 4.5] == pytest.approx((5.5, 5.5)) and got[2004, 1.0] == (None, None) == got[2004, 12.0]
    assert {y for y, _ in got} == {2003, 2004}  # a year of nulls has no curve
    assert traffic.season_band(months(spark, [])).collect() == []


def test_splines_of_uneven_knots():
    x = (1.0, 2.0, 5.0, 6.5, 9.0, 12.0)
    points = tuple(np.linspace(0, 13, 50).tolist())
    for p in range(4):
        for a, v in zip(points, spline.curve(x, np.array(x) ** p, points), strict=True):
            assert v is None if a < 1 or a > 12 else abs(v - a**p) < 1e-8


def test_changes_over_gaps(spark):
    rows = [("a", 1, 1), ("a", 2, None), ("a", 3, 2), ("b", 1, None), ("b", 2, 4), ("b", 3, 4), ("b", 4, 0), ("b", 5, 3), (None, 1, 1), (None, 2, 3)]
    df = spark.createDataFrame(rows, "k string, year int, v long")
    made = {(r.k, r.year): (r.filled_v, r.pct_change_v) for r in traffic.filled_changes(df, "year", "v", by="k").collect()}
    assert [made["a", y] for y in (1, 2, 3)] == [(1, None), (1, 0.0), (2, 1.0)]
    assert [made["b", y] for y in (1, 2, 3, 4, 5)] == [(None, None), (4, None), (4, 0.0), (0, -1.0), (3, None)]
    assert made[None, 2] == (3, 2.0)
    alone = traffic.filled_changes(df.where("k = 'a'"), "year", "v").orderBy("year").collect()
    assert [r.pct_change_v for r in alone] == [None, 0.0, 1.0]
    gaps = traffic.with_gaps(df.where("k is not null and v is not null"), "k", "year").collect()
    assert len(gaps) == 10 and sum(r.v is None for r in gaps) == 4


@pytest.mark.parametrize("kind", ["ties", "spread", "few"])
def test_quantiles_of_doubles(spark, kind):
    draw = random.Random(5)
    values = {"ties": [draw.choice([0.1, 0.2, 0.2, 7.5]) for _ in range(999)], "spread": [draw.choice([-1, 1]) * 10 ** draw.uniform(-200, 200) for _ in range(2000)], "few": [3.5, -1.0]}[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "x double").repartition(6)
    shares = {f"q{k}": k / 100 for k in (0, 1, 25, 33, 50, 75, 99, 100)}
    made = profile.quantiles(df, "x", shares).first().asDict()
    for name, share in shares.items():
        assert made[name] == pytest.approx(float(np.quantile(values, share)), rel=1e-12)


def test_summary_has_no_buffer_of_values(spark):
    df = spark.createDataFrame([(float(v % 7),) for v in range(100)], "x double")
    r = profile.summary(df, "x").first()
    values = [float(v % 7) for v in range(100)]
    assert (r.n, r.min, r["max"], r.median) == (100, 0.0, 6.0, 3.0)
    assert r["mean"] == pytest.approx(np.mean(values)) and r["std"] == pytest.approx(np.std(values, ddof=1))
    assert "ObjectHashAggregate" not in profile.summary(df, "x")._jdf.queryExecution().executedPlan().toString()
    empty = profile.summary(df.limit(0), "x").first()
    assert empty.n == 0 and empty.median is None and empty["std"] is None
    assert profile.summary(df.limit(1), "x").first()["std"] is None


def test_words_and_tokens_in_one_split(spark):
    draw = random.Random(8)
    parts = [*"abcDEF##  @@é🙂\n\t1.,_", "the ", "With ", "flight ", "####", "#The", " @united ", "@a"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None, " ", "#### ab", "x" * 50_000]], "t string")
    tidy = X.long_words(X.letters_only(X.without_handles(F.col("t"))))
    made = df.select(X.tidy(F.col("t")).alias("a"), tidy.alias("b"), X.tidy_tokens(F.col("t")).alias("c"), X.tokens(tidy).alias("d"), X.tidy_tokens(F.col("t"), []).alias("e"), X.tokens(tidy, []).alias("f")).collect()
    assert all((r.a, r.c, r.e) == (r.b, r.d, r.f) for r in made)


def test_stems_as_expressions_equal_the_function(spark):
    draw = random.Random(3)
    ends = [*stem.STEP_2, *stem.STEP_3, *stem.STEP_4, "s", "ies", "sses", "ed", "ing", "eed", "y", "e", "ll", "yyed", "ying", ""]
    words = ["".join(draw.choice("bcdlmstyaeiouwxzYé") for _ in range(draw.randint(0, 6))) + draw.choice(ends) + draw.choice(["", "s", "ed", "ing", "y", "E"]) for _ in range(5000)]
    df = spark.createDataFrame([([*words, None],), ([],), (None,)], "t array<string>")
    made = [r.s for r in df.select(stem.stemmed(F.col("t")).alias("s")).collect()]
    assert made == [[stem.stem(w) for w in [*words, None]], [], None]
    assert "Python" not in df.select(stem.stemmed(F.col("t")))._jdf.queryExecution().executedPlan().toString()
