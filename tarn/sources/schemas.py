"""Schemas of the two kinds of input the library is made for."""

from __future__ import annotations

from pyspark.sql import types as T

TRAFFIC = T.StructType(
    [T.StructField("dt", T.TimestampNTZType())]
    + [T.StructField(f"{measure}_{side}", T.LongType()) for measure in ("flights", "passengers", "asm", "rpm") for side in ("domestic", "international")]
)

TWEETS = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("airline", T.StringType()),
        T.StructField("airline_sentiment", T.StringType()),
        T.StructField("airline_sentiment_confidence", T.DoubleType()),
        T.StructField("negativereason", T.StringType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("tweet_created", T.StringType()),
    ]
)
