"""Looking at a table: heads, counts, nulls, frequencies, means, summaries, histograms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.numeric import BINS, bin_edge, bin_of
from tarn.sources.readers import kept


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def enumerated(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key`` and their ordinal from 0; only these rows are numbered."""
    return head(df, key, n).withColumn("ordinal", F.row_number().over(Window.orderBy(key)) - 1)


def row_at(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: for every column its number of nulls."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Values that are not null with their counts, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column)


def means(df: DataFrame, by: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The means of all numeric columns by a key that is not null."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (by, *skip)]
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*(F.avg(c).alias(f"mean_{c}") for c in numeric))


def _counted(df: DataFrame, column: str) -> DataFrame:
    """(v, c, range): the values that are not null with their counts, in ranges of values, written once."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    return kept(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id()))


def _quantiles(values: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    ranges = values.groupBy("range").agg(F.sum("c").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("range")) - F.col("rows")  # a row a range
    placed = ranges.select("range", before.alias("before"), "rows")
    place = (F.col("n") - 1) * F.col("q.share")
    wanted = ranges.agg(F.sum("rows").alias("n")).select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(s)).alias("share")) for k, s in shares.items()))).alias("q"))
    ranks = wanted.select("q.name", (place - F.floor(place)).alias("part"), F.floor(place).alias("low"), F.ceil(place).alias("high"))
    ends = ranks.select("name", "part", F.explode(F.array(F.struct(F.lit(0).alias("upper"), F.col("low").alias("rank")), F.struct(F.lit(1).alias("upper"), F.col("high").alias("rank")))).alias("e")).select("name", "part", "e.*")
    chosen = ends.join(placed, (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("rows")))
    inside = values.join(F.broadcast(placed.join(chosen.select("range").distinct(), "range")), "range")
    upto = F.sum("c").over(Window.partitionBy("range").orderBy("v")) + F.col("before")
    sorted_ = inside.select(F.col("range").alias("in"), "v", "c", upto.alias("upto"))
    found = sorted_.join(F.broadcast(chosen), (F.col("in") == F.col("range")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    pairs = found.groupBy("name").agg(F.max("part").alias("part"), *(F.max(F.when(F.col("upper") == k, F.col("v"))).cast("double").alias(end) for k, end in enumerate(("low", "high"))))
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    at = pairs.select("name", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(value).alias("value"))
    return at.agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in shares))


def quantiles(df: DataFrame, column: str, shares: Mapping[str, float]) -> DataFrame:
    """One row: under each name of ``shares`` the exact quantile at its share, interpolated between values.

    Values are counted and dealt in ranges; the counts of the ranges tell which range holds a rank,
    and only such ranges are sorted. No task holds all values. Nulls do not count; without values
    all are null.
    """
    return _quantiles(_counted(df, column), shares)


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact interpolated quartiles, from the counts of the values."""
    values = _counted(df, column)
    v = F.col("v").cast("double")
    sums = values.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.sum(v * F.col("c")) / F.sum("c")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    off = values.crossJoin(F.broadcast(sums.select("mean", "n"))).agg(F.sum((v - F.col("mean")) * (v - F.col("mean")) * F.col("c")).alias("off"))
    quarters = _quantiles(values, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    met = sums.crossJoin(F.broadcast(off)).crossJoin(F.broadcast(quarters))
    return met.select("n", "mean", F.sqrt(F.try_divide("off", F.col("n") - 1)).alias("std"), "min", "q25", "median", "q75", "max")


def histogram(df: DataFrame, column: str, by: str | None = None, bins: int = BINS) -> DataFrame:
    """(by,) bin, lo, hi and n for all equal-width bins over each group's own range.

    Values are first counted, so only distinct values are joined to their group's range. Null
    values and null groups are left out; a bin without values has a count of 0.
    """
    keys = [by] if by else []
    known = df.where(F.col(column).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True)))
    values = known.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranges = values.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    placed = values.join(ranges, keys) if keys else values.crossJoin(F.broadcast(ranges))
    counts = placed.groupBy(*keys, bin_of(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.sum("c").alias("n"))
    all_bins = ranges.where("low is not null").withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    edges = all_bins.select(*keys, "bin", bin_edge(F.col("bin"), F.col("low"), F.col("high"), bins).alias("lo"), bin_edge(F.col("bin") + 1, F.col("low"), F.col("high"), bins).alias("hi"))
    return edges.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
