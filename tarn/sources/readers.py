"""CSV and Parquet readers, and the stand-in views over the test tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, schema: T.StructType, line_ends: bool = True) -> DataFrame:
    """A CSV file with a header and doubled quotes; no inference pass.

    ``line_ends``: quoted values may hold line ends, so a file cannot be split and is one task.
    Without them large files are read in splits.
    """
    return spark.read.schema(schema).csv(path, header=True, multiLine=line_ends, escape='"')


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, which only a local master may lack."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tarn-scratch-")
    return f"{root.rstrip('/')}/tarn-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder and read back."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def offsets(rows: DataFrame, piece: Sequence[Column], at: Column) -> DataFrame:
    """(p0, p1, ..., shift) for each piece: what turns ``at`` into a number over all pieces in their order.

    One row a piece (a range, or a split of a file) is summed up in one window: their number is
    that of tasks, not of rows.
    """
    names = [f"p{k}" for k in range(len(piece))]
    sizes = rows.select(*(c.alias(n) for c, n in zip(piece, names, strict=True)), at.alias("at")).groupBy(*names).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    return sizes.select(*names, (F.sum("n").over(Window.orderBy(*names)) - F.col("n") - F.col("first")).alias("shift"))


def with_row_number(df: DataFrame, name: str = "row") -> DataFrame:
    """Dense numbers from 0 in the order the rows are read.

    The rows of each partition are counted first; a row's number is its place in its partition
    and what the partitions before hold, a table of one row a partition.
    """
    piece, at = F.shiftright("__at", 33), F.col("__at")
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    return placed.join(F.broadcast(offsets(placed, [piece], at)), piece == F.col("p0")).select(*(F.col(f"`{c}`") for c in df.columns if c != name), (at + F.col("shift")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traffic(spark: SparkSession, sf_dir: str, first: str | None = None, before: str | None = None) -> DataFrame:
    """One row per month of shipping: counts and integer measures, so sums have no order.

    ``first`` and ``before`` bound the days read; they reach the scan, which a bound on the month,
    a function of the day, does not.
    """
    items = table(spark, sf_dir, "lineitem")
    if first:
        items = items.where(F.col("l_shipdate") >= F.lit(first).cast("timestamp_ntz"))
    if before:
        items = items.where(F.col("l_shipdate") < F.lit(before).cast("timestamp_ntz"))
    quantity = F.col("l_quantity").cast("long")
    price = F.round(F.col("l_extendedprice") * 100, 0).cast("long")
    sums = []
    for side, status in (("domestic", "F"), ("international", "O")):
        mine = F.col("l_linestatus") == status
        sums += [
            F.sum(F.when(mine, 1).otherwise(0)).alias(f"flights_{side}"),
            F.sum(F.when(mine, quantity).otherwise(0)).alias(f"passengers_{side}"),
            F.sum(F.when(mine, price).otherwise(0)).alias(f"asm_{side}"),
            F.sum(F.when(mine & (F.col("l_returnflag") != "R"), price).otherwise(0)).alias(f"rpm_{side}"),
        ]
    return items.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("dt")).agg(*sums)


TRAFFIC_SQL = """
SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS dt, {sums}
FROM lineitem GROUP BY 1
""".format(
    sums=", ".join(
        f"CAST(sum(CASE WHEN l_linestatus = '{status}'{more} THEN {value} ELSE 0 END) AS BIGINT) AS {name}_{side}"
        for side, status in (("domestic", "F"), ("international", "O"))
        for name, value, more in (
            ("flights", "1", ""),
            ("passengers", "CAST(l_quantity AS BIGINT)", ""),
            ("asm", "CAST(round(l_extendedprice * 100, 0) AS BIGINT)", ""),
            ("rpm", "CAST(round(l_extendedprice * 100, 0) AS BIGINT)", " AND l_returnflag <> 'R'"),
        )
    )
)


_TOXIC = "toxic = 1"
#: The columns of ``tweets`` and the tables besides documents that each needs.
TWEET_COLUMNS = {
    "tweet_id": ("doc_id", ()),
    "text": ("text", ()),
    "airline": ("source", ()),
    "airline_sentiment": (f"CASE WHEN {_TOXIC} THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END", ("labels",)),
    "negativereason": (f"CASE WHEN {_TOXIC} THEN event_type END", ("labels", "events")),
    "airline_sentiment_confidence": ("value", ("events",)),
    "retweet_count": ("user_id", ("events",)),
    "tweet_created": ("ts", ("events",)),
}


def tweets(spark: SparkSession, sf_dir: str, *columns: str, labelled: bool = False) -> DataFrame:
    """One row per document with a sentiment from its labels and a time from its event.

    Only the tables that ``columns`` need are joined: ids of labels and events are unique, so a
    left join that gives no column would change nothing. ``labelled``: documents with labels only.
    """
    columns = columns or tuple(TWEET_COLUMNS)
    needed = {t for c in columns for t in TWEET_COLUMNS[c][1]}
    joined = table(spark, sf_dir, "documents")
    if "labels" in needed or labelled:
        joined = joined.join(table(spark, sf_dir, "labels"), "doc_id", "inner" if labelled else "left")
    if "events" in needed:
        joined = joined.join(table(spark, sf_dir, "events").withColumnRenamed("event_id", "doc_id"), "doc_id", "left")
    return joined.select(*(F.expr(TWEET_COLUMNS[c][0]).alias(c) for c in columns))


TWEETS_SQL = """
SELECT d.doc_id AS tweet_id, d.text, d.source AS airline,
       CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'neutral' END AS airline_sentiment,
       CASE WHEN l.toxic = 1 THEN e.event_type END AS negativereason,
       e.value AS airline_sentiment_confidence, e.user_id AS retweet_count, e.ts AS tweet_created
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id
"""
