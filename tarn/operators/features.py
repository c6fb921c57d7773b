"""From clean texts to words, vocabulary, bags of words and TF-IDF, as long tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.functions.stem import stemmed
from tarn.sources.ordinals import in_order
from tarn.sources.readers import kept

#: Parts of a label's words that are ranked on their own.
PARTS = 64
#: Rows of a table of keys or terms that are broadcast at most, once they have been counted.
BROADCAST_ROWS = 500_000
#: Texts of a repeated key that are joined into one at most.
JOINED_ROWS = 1_000


def word_frequencies(df: DataFrame, label: str, tokens: str, top: int = 200) -> DataFrame:
    """The ``top`` words of each label, with counts and their weight against the label's top word.

    Ties go by the word. Counts are pre-aggregated. A label's words are first ranked in PARTS parts,
    of which ``top`` each can count at most; only these are put in one order.
    """
    # explode() would have Spark filter on the size of the tokens first, and so make them twice
    found = df.where(F.col(label).isNotNull()).select(label, F.explode_outer(tokens).alias("word")).where("word is not null")
    counts = found.groupBy(label, "word").agg(F.count("*").alias("n"))
    return ranked(counts, label, top)


def ranked(counts: DataFrame, label: str, top: int) -> DataFrame:
    """The ``top`` rows of each label by n, ties by the word, with place and weight against the label's largest n."""
    by_rank = (F.desc("n"), "word")
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS))
    few = counts.withColumn("place", F.row_number().over(Window.partitionBy(label, part).orderBy(*by_rank))).where(F.col("place") <= top)
    first = F.max("n").over(Window.partitionBy(label))
    return few.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(*by_rank))).withColumn("weight", F.col("n") / first).where(F.col("place") <= top)


def stems(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key``, stems (array) and stemmed (joined by spaces); no tokens give no stems.

    Tokens stay in their rows: a shuffle of all tokens to stem each once in the whole table
    would cost more than the expressions that stem it wherever it stands.
    """
    made = df.select(key, stemmed(F.coalesce(F.col(tokens), F.array().cast("array<string>"))).alias("stems"))
    return made.withColumn("stemmed", F.array_join("stems", " "))


def counted(values: Column) -> Column:
    """(term, tf) of each distinct value of an array: equal ones are neighbours once it is sorted."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: (k == 0) | (F.get(ordered, k) != F.get(ordered, k - 1)))
        cells = lambda first: F.transform(first, lambda at, k: F.struct(F.get(ordered, at).alias("term"), (F.coalesce(F.get(first, k + 1), F.size(ordered)) - at).cast("long").alias("tf")))
        return F.flatten(F.transform(F.array(starts), cells))

    # arrays of one array bind what is used more than once
    return F.flatten(F.transform(F.filter(F.array(F.sort_array(values)), lambda v: F.size(v) > 0), runs))


def bag_of_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of lower-case terms of two characters or more.

    Terms are counted in the row of their text, so texts cross no network and no task holds the
    cells of more than a document. Keys that occur in several rows are found before, from the keys
    alone: their texts are joined into one, or their cells summed up if the rows are many.
    """
    again = kept(df.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n_rows")).where("n_rows > 1"))
    n_again, most = again.agg(F.count("*"), F.max("n_rows")).first()
    if not n_again:
        return _cells(df, key, text)
    met = df.join(F.broadcast(again) if n_again <= BROADCAST_ROWS else again, F.col(key).eqNullSafe(F.col("again")), "left")
    few = met.where(F.col("n_rows") <= JOINED_ROWS).groupBy(key).agg(F.array_join(F.collect_list(text), "\n").alias(text))
    cells = _cells(met.where("n_rows is null").select(key, text).unionByName(few), key, text)
    if most <= JOINED_ROWS:
        return cells
    many = _cells(met.where(F.col("n_rows") > JOINED_ROWS), key, text).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return cells.unionByName(many)


def _cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of each row by itself."""
    found = df.select(key, F.explode_outer(counted(X.terms(F.col(text)))).alias("cell"))
    return found.where("cell is not null").select(key, "cell.term", "cell.tf")


def vocabulary(bag: DataFrame) -> DataFrame:
    """(term, term_id): ids from 0 in alphabetical order; ranges of terms are numbered, no task orders all of them."""
    return in_order(bag.select("term").distinct(), ["term"], "term_id")


def transform(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, term, term_id, tf) of documents by a known vocabulary; other terms are ignored."""
    return bag_of_words(df, key, text).join(vocab, "term").select(key, "term", "term_id", "tf")


def matrix_shape(df: DataFrame, bag: DataFrame, key: str) -> DataFrame:
    """Documents (empty ones too), terms and cells that are not zero."""
    docs = df.agg(F.countDistinct(key).alias("n_docs"))
    cells = bag.agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_nonzero"))
    return docs.crossJoin(F.broadcast(cells))


def smooth_idf(n: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1 of a term in ``df`` of ``n`` documents."""
    return F.log((1 + n) / (1 + df)) + 1


def tfidf(df: DataFrame, bag: DataFrame, key: str) -> DataFrame:
    """(key, term, tfidf): tf * idf, each document's row scaled to length 1.

    n counts documents without terms too. Document frequencies come from the bag's rows, which
    are one per document and term; the bag is counted once and written. Cells pass by a hash of
    their task's terms, so they are not sorted by term.
    """
    bag = kept(bag)
    n = df.agg(F.countDistinct(key).alias("n_docs"))
    frequency = bag.groupBy("term").agg(F.count("*").alias("df"))
    idf = frequency.crossJoin(F.broadcast(n)).select("term", smooth_idf(F.col("n_docs"), F.col("df")).alias("idf"))
    weighed = bag.join(idf.hint("shuffle_hash"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighed.select(key, "term", (F.col("w") / length).alias("tfidf"))


def recoded(df: DataFrame, column: str, codes: Mapping[str, int], name: str) -> DataFrame:
    """``name``: the code of the column's value; null where there is none."""
    pairs = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return df.withColumn(name, F.try_element_at(pairs, F.col(column)))
