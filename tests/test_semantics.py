"""The traps in which Spark's defaults differ from what the operators promise."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import dates, numeric, spline, stem
from tarn.functions import text as X
from tarn.operators import features, profile, share, traffic
from tarn.plans import traffic as plans
from tarn.sources import readers, schemas


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def of(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_rounding_division_and_sums(spark):
    assert of(spark, [(2.5,), (3.5,), (None,)], "a double", numeric.half_even(F.col("a"))) == [2.0, 4.0, None]
    assert one(spark, numeric.half_even(F.lit(0.125), 2)) == 0.12
    assert of(spark, [(1, 0), (0, 0), (1, 4), (None, 2)], "a int, b int", numeric.ratio(F.col("a"), F.col("b"))) == [None, None, 0.25, None]
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, "b", 4)], "year int, k string, v long")
    assert [tuple(r) for r in traffic.sums_by_year(rows, "v").collect()] == [(1, 0)]
    assert one(spark, numeric.percent_label(F.lit(0.125))) == "12%" and one(spark, numeric.thousands(F.lit(1234567))) == "1,234,567"


def test_a_small_loss_keeps_its_sign_in_the_label(spark, tmp_path):
    shares = [(-0.002,), (-0.005,), (0.002,), (0.0,), (-0.025,), (-0.015,), (None,)]
    assert of(spark, shares, "a double", numeric.percent_label(F.col("a")))[:6] == ["-0%", "-0%", "0%", "0%", "-2%", "-2%"]
    rows = [("O", "N", 1.0, float(price), dt.datetime(year, 6, 1)) for year, price in ((1995, 1000), (1996, 997), (1997, 1000))]
    spark.createDataFrame(rows, "l_linestatus string, l_returnflag string, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = duckdb.connect()
    made.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = made.sql(plans.SQL["traffic_axis_labels"]).fetchall()
    assert [tuple(r) for r in plans.traffic_axis_labels(spark, str(tmp_path)).collect()] == want == [(0, "99,700", "-0%", "Jan"), (1, "100,000", "0%", "Feb")]


def test_date_range_is_open_at_midnights(spark):
    times = ["2002-12-31 00:00", "2002-12-31 12:00", "2003-01-01 00:00", "2016-12-31 23:59", "2017-01-01 00:00"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(F.col("s").cast("timestamp_ntz").alias("dt"))
    assert [r["dt"].strftime("%Y-%m-%d %H:%M") for r in traffic.whole_years(df, "2002-12-31", "2017-01-01").orderBy("dt").collect()] == times[1:4]


def test_clock_and_parts_of_the_day(spark):
    texts = [("2015-02-24 11:35:52 -0800",), ("bad",), (None,)]
    assert of(spark, texts, "s string", dates.wall_clock(F.col("s"))) == [dt.datetime(2015, 2, 24, 11, 35, 52), None, None]
    hours = [(h,) for h in (0, 4, 5, 11, 12, 18, 19, 23, None)]
    parts = of(spark, hours, "h int", dates.part_of_day(F.col("h")))
    assert parts == ["dawn", "dawn", "morning", "morning", "afternoon", "afternoon", "night", "night", "dawn"]
    assert one(spark, dates.part_order(F.lit("dawn"))) == 4 and one(spark, dates.month_label(F.lit(7))) == "Jul"


@pytest.mark.parametrize(
    ("text", "left"),
    [("@a hi @abc there", " hi bc there"), ("@ @united x", " united x"), ("x @Virgin @VirginAmerica y", "x  America y"), ("é @élan ok", "é  ok"), ("a@b.com @é", "a.com "), ("no handle", "no handle"), ("", ""), (None, None)],
)
def test_handles_are_removed_in_the_order_found(spark, text, left):
    assert of(spark, [(text,)], "t string", X.without_handles(F.col("t"))) == [left]


def test_cleaning_steps(spark):
    assert of(spark, [("  ab  c ",), ("",), (None,)], "t string", X.words(F.col("t"))) == [["ab", "c"], [], None]
    assert one(spark, X.letters_only(F.lit("a1b 🙂#é"))) == "a b  # "
    assert one(spark, X.long_words(F.lit(" the #abc long words  "))) == "#abc long words"
    assert one(spark, X.tokens(F.lit("#The WITH Flight flight #"))) == ["Flight", "flight"]
    assert one(spark, X.without_stop_words(F.array(F.lit("the")), [])) == ["the"]


def test_stems(spark):
    words = "really aggressive blast obnoxious entertain guest face little recourse".split()
    assert [stem.stem(w) for w in words] == "realli aggress blast obnoxi entertain guest face littl recours".split()
    more = "caresses ponies ties cats feed agreed plastered motoring conflated hopping falling filing happy sky relational conditional vietnamization triplicate formalize hopeful revival adoption controlling rate cease roll a is"
    want = "caress poni ti cat feed agre plaster motor conflat hop fall file happi sky relat condit vietnam triplic formal hope reviv adopt control rate ceas roll a is"
    assert [stem.stem(w) for w in more.split()] == want.split()
    df = spark.createDataFrame([(1, ["Cats", "cats", "Running"]), (2, []), (3, None)], "k int, t array<string>")
    assert {r["k"]: (r["stems"], r["stemmed"]) for r in features.stems(df, "k", "t").collect()} == {1: (["cat", "cat", "run"], "cat cat run"), 2: ([], ""), 3: ([], "")}


def test_summary_and_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, None)], "v int")
    r = profile.summary(df, "v").first()
    assert (r["n"], r["q25"], r["median"], r["q75"]) == (4, 1.75, 2.5, 3.25)
    bins = lambda values: {r["bin"]: r["n"] for r in profile.histogram(spark.createDataFrame([(v,) for v in values], "v int"), "v").collect() if r["n"]}
    assert bins([1, 5, 9, 20, 41]) == {1: 1, 3: 1, 5: 1, 10: 1, 20: 1}
    assert bins([5, 5, 5]) == {11: 3} and bins([]) == {}
    by = spark.createDataFrame([("a", 1), ("a", 41), ("b", 5), (None, 9)], "k string, v int")
    made = profile.histogram(by, "v", "k").collect()
    assert len(made) == 40 and {(r["k"], r["bin"]) for r in made if r["n"]} == {("a", 1), ("a", 20), ("b", 11)}


def test_profile_drops_null_keys(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", None), ("x", 3.0), (None, 9.0)], "k string, v double")
    assert [tuple(r) for r in profile.frequencies(df, "k").collect()] == [("x", 2), ("y", 1)]
    assert sorted(tuple(r) for r in profile.means(df, "k").collect()) == [("x", 2.0), ("y", None)]
    assert tuple(profile.null_counts(df).first()) == (1, 1)
    shares = share.share_of_label(spark.createDataFrame([("p", "a")] * 1 + [("q", "a")] * 7 + [(None, "a"), ("p", None)], "k string, l string"), "k", "l")
    assert sorted((r["k"], r["n"], r["percentage"]) for r in shares.collect()) == [("p", 1, 12.0), ("q", 7, 88.0)]


def test_masks_share_a_row(spark):
    rows = [(y, 365 * y, 0, 365, 365) for y in range(2003, 2017)]
    df = spark.createDataFrame(rows, "year int, flights_domestic long, flights_international long, passengers_domestic long, passengers_international long")
    made = {r["position"]: r for r in traffic.masked_segments(df).collect()}
    assert [p for p, r in made.items() if r["year_late"] and r["year_early"]] == [6]
    assert sum(r["year_late"] is not None for r in made.values()) == 8 and made[6]["avr_daily_flights_late"] == 2009.0


def test_first_year_has_no_change(spark):
    df = spark.createDataFrame([(2003 + k, 100 * (k + 1), 0, 0, 0) for k in range(14)], "year int, asm_domestic long, asm_international long, rpm_domestic long, rpm_international long")
    made = traffic.yearly_changes(df).orderBy("year").collect()
    assert len(made) == 13 and made[0]["year"] == 2004 and made[0]["pct_change_asm"] == 1.0 and made[0]["pct_change_rpm"] is None
    assert traffic.with_totals(spark.createDataFrame([(1, None)], "asm_domestic int, asm_international int"), "asm").first()["total_asm"] is None


def test_spline_reproduces_cubics():
    x, w, knots = spline.grid(), spline.weights(), np.arange(1, 13)
    for p in range(4):
        assert np.allclose(w @ knots.astype(float) ** p, x**p, rtol=0, atol=1e-8)
    assert not np.allclose(w @ knots.astype(float) ** 4, x**4, atol=1e-3)


def test_features(spark):
    df = spark.createDataFrame([(1, "cat dog dog"), (2, "dog Eel a"), (3, ""), (4, None)], "k int, t string")
    bag = features.bag_of_words(df, "k", "t")
    assert {(r["k"], r["term"]): r["tf"] for r in bag.collect()} == {(1, "cat"): 1, (1, "dog"): 2, (2, "dog"): 1, (2, "eel"): 1}
    vocab = features.vocabulary(bag)
    assert {r["term"]: r["term_id"] for r in vocab.collect()} == {"cat": 0, "dog": 1, "eel": 2}
    assert tuple(features.matrix_shape(df, bag, "k").first()) == (4, 3, 4)
    weights = {(r["k"], r["term"]): r["tfidf"] for r in features.tfidf(df, bag, "k").collect()}
    cat, dog = np.log(5 / 2) + 1, 2 * (np.log(5 / 3) + 1)
    assert np.isclose(weights[1, "cat"], cat / np.hypot(cat, dog)) and np.isclose(weights[1, "dog"], dog / np.hypot(cat, dog))
    unseen = spark.createDataFrame([(9, "dog yak dog")], "k int, t string")
    assert [(r["term"], r["term_id"], r["tf"]) for r in features.transform(unseen, "k", "t", vocab).collect()] == [("dog", 1, 2)]
    codes = features.recoded(spark.createDataFrame([("negative",), ("odd",), (None,)], "s string"), "s", {"negative": 1}, "c")
    assert [r["c"] for r in codes.collect()] == [1, None, None]


def test_word_frequencies_break_ties_by_word(spark):
    df = spark.createDataFrame([("p", ["b", "a", "b"]), ("p", ["a", "c"]), (None, ["z"])], "l string, t array<string>")
    made = features.word_frequencies(df, "l", "t", 2).orderBy("place").collect()
    assert [(r["word"], r["n"], r["weight"]) for r in made] == [("a", 2, 1.0), ("b", 2, 1.0)]


def test_csv_with_quoted_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('tweet_id,text,airline,airline_sentiment,airline_sentiment_confidence,negativereason,retweet_count,tweet_created\n1,"a ""b""\nc",x,negative,0.5,,0,2015-02-24 11:35:52 -0800\n2,d,y,,,,,\n')
    rows = readers.csv(spark, str(tmp_path / "t.csv"), schemas.TWEETS)
    assert [(r["tweet_id"], r["text"], r["negativereason"]) for r in rows.collect()] == [(1, 'a "b"\nc', None), (2, "d", None)]
    assert [r["row"] for r in readers.with_row_number(rows).orderBy("row").collect()] == [0, 1]
    assert [r["tweet_id"] for r in profile.enumerated(rows, "tweet_id", 1).collect()] == [1]
    many = readers.with_row_number(spark.range(1000, numPartitions=7).where("id % 3 > 0"))
    assert [(r["row"], r["id"]) for r in many.collect()] == list(enumerate(i for i in range(1000) if i % 3))
    assert readers.with_row_number(rows.limit(0)).collect() == []


def test_date_filter_and_columns_reach_the_scan(spark):
    from tests.conftest import DATA

    df = traffic.sums_by_year(traffic.whole_years(readers.traffic(spark, f"{DATA}/sf0.001", "1995-01-01", "1996-01-01"), "1994-12-31", "1996-01-01"), "flights_domestic")
    scan = df._jdf.queryExecution().toString().split("PushedFilters")[-1]
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
    assert "l_linestatus" in scan.split("ReadSchema")[-1] and "l_extendedprice" not in scan.split("ReadSchema")[-1]


def test_views_of_tweets_join_what_they_use(spark):
    from tarn.plans import tweets
    from tests.conftest import DATA

    def joins(name):
        return tweets.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert {n: joins(n) for n in ("tweets_count", "tweets_longest", "tweets_hist", "tweets_label_counts", "tweets_head")} == {"tweets_count": 0, "tweets_longest": 0, "tweets_hist": 2, "tweets_label_counts": 1, "tweets_head": 2}
    plan = tweets.text_word_freq(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and "event_id" not in plan


def test_ordered_results(spark):
    from tarn.plans import traffic as plans
    from tarn.plans import tweets
    from tests.conftest import DATA

    sf = f"{DATA}/sf0.001"
    for name, key in (("traffic_ratio_by_year", "year"), ("traffic_daily_avg", "year"), ("traffic_season_minmax", "month_day"), ("traffic_season_spline", "k")):
        keys = [r[key] for r in plans.QUERIES[name](spark, sf).collect()]
        assert keys == sorted(keys) and len(keys) > 1
    parts = [r["part_of_day"] for r in tweets.tweets_part_of_day_share(spark, sf).collect()]
    assert list(dict.fromkeys(parts)) == [p for p in dates.PARTS if p in parts]


def test_top_words_of_each_label_are_whole_when_parts_are_full(spark):
    rows = [("p", [f"w{i:03d}"] * (1 + i % 9)) for i in range(900)]
    made = features.word_frequencies(spark.createDataFrame(rows, "l string, t array<string>"), "l", "t", 150).orderBy("place").collect()
    want = sorted(((-(1 + i % 9), f"w{i:03d}") for i in range(900)))[:150]
    assert [(-r["n"], r["word"]) for r in made] == want
