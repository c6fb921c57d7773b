"""A text model that is fitted once, stored, and weighs other documents; and sparse rows of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators.features import bag_of_words, smooth_idf
from tarn.sources.ordinals import in_order
from tarn.sources.readers import kept


@dataclass(frozen=True)
class TextModel:
    """(term, term_id, df, idf) of the documents it was fitted on, and how many documents and terms those were."""

    terms: DataFrame
    n_docs: int
    n_terms: int

    def save(self, path: str) -> None:
        """Writes the model to a new folder; the numbers last, so that a folder that has them is whole."""
        self.terms.write.parquet(f"{path}/terms")
        spark = self.terms.sparkSession
        spark.createDataFrame([(self.n_docs, self.n_terms)], "n_docs long, n_terms long").coalesce(1).write.parquet(f"{path}/numbers")


def load(spark: SparkSession, path: str) -> TextModel:
    numbers = spark.read.parquet(f"{path}/numbers").first()
    return TextModel(spark.read.parquet(f"{path}/terms"), numbers.n_docs, numbers.n_terms)


def fit(df: DataFrame, key: str, text: str) -> TextModel:
    """The vocabulary of the texts, ids from 0 in alphabetical order, and its smooth inverse document frequencies.

    Documents are distinct keys; those without terms count too. The bag of words is counted once.
    """
    n_docs = df.select(key).distinct().count()
    frequency = kept(bag_of_words(df, key, text).groupBy("term").agg(F.count("*").alias("df")))
    terms = in_order(frequency, ["term"], "term_id").select("term", "term_id", "df", smooth_idf(F.lit(n_docs), F.col("df")).alias("idf"))
    return TextModel(kept(terms), n_docs, frequency.count())


def weigh(model: TextModel, df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, term_id, tf, tfidf) of documents by a fitted model; each document's weights have length 1.

    Terms that the model does not know are left out before the length is taken, so a document of
    such terms only has no cells. Nothing is fitted again. Cells pass by a hash of their task's
    terms, so they are not sorted by term.
    """
    known = bag_of_words(df, key, text).join(model.terms.hint("shuffle_hash"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return known.select(key, "term", "term_id", "tf", (F.col("w") / length).alias("tfidf"))


def sparse_rows(df: DataFrame, cells: DataFrame, key: str, n_terms: int, value: str = "tf") -> DataFrame:
    """(key, size, indices, values): one row for each key of ``df``, its cells by ascending term_id.

    ``cells``: (key, term_id, value), one a key and term. ``size`` is the vocabulary's. A document
    without cells has empty arrays; a row is as long as its document has terms.
    """
    pairs = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term_id", F.col(value).alias("value")))).alias("cells"))
    none = F.array().cast(pairs.schema["cells"].dataType)
    met = df.select(key).distinct().join(pairs, key, "left").withColumn("cells", F.coalesce("cells", none))
    return met.select(key, F.lit(n_terms).cast("long").alias("size"), F.col("cells.term_id").alias("indices"), F.col("cells.value").alias("values"))
