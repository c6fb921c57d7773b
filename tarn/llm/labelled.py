"""Bounded samples of labelled rows, for the operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of a class that a classifier is fitted on, at most.
ROWS_PER_CLASS = 6_000


def sample(labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id", rows: int = ROWS_PER_CLASS) -> DataFrame:
    """(id, label, weight): at most ``rows`` rows of each class for which ``learn`` holds.

    Rows are taken in the order of a hash of the id, so the same table gives the same sample.
    Null ids and labels other than 0 and 1 are no labels; of an id's labels the largest counts.
    ``weight`` is the labelled rows of the class for each sampled one, so weighted rows have the
    classes' own shares. The result has 2 * ``rows`` rows at most and is safe to broadcast.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(id_col).agg(F.max(label).alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [
        known.where(F.col("label") == k).orderBy(F.xxhash64(id_col), id_col).limit(rows).withColumn("weight", F.lit(max(1.0, total.get(k, 0) / rows)))
        for k in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, weight and text of the sampled ids; the sample, bounded, is sent to the documents.

    Of an id's texts the first in order is taken, so that repeated rows do not pass the bound; an
    id with null texts only has an empty one.
    """
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col)
    return texts.groupBy(id_col, "label", "weight").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
