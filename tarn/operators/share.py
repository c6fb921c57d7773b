"""Shares of a label's total by another key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.dates import part_of_day, part_order
from tarn.functions.numeric import half_even


def share_of_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Counts by key and label, and the percentage of all rows with the label, rounded half to even.

    Combinations that do not occur have no row; null keys and labels are left out.
    """
    counts = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    all_of = F.sum("n").over(Window.partitionBy(label))
    return counts.withColumn("percentage", half_even(F.lit(100.0) * F.col("n") / all_of, 0))


def part_of_day_share(df: DataFrame, time: str, label: str) -> DataFrame:
    made = share_of_label(df.withColumn("part_of_day", part_of_day(F.hour(time))), "part_of_day", label)
    return made.withColumn("part_order", part_order(F.col("part_of_day")))
