"""Counts for a word cloud: cases and plurals folded, and pairs of words that go together as terms of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.features import ranked
from tarn.sources.readers import kept

# The words that clouds leave out beside the stop words of the tokens.
CLOUD_STOP_WORDS = "also cannot com could else ever get hence however http just k like ought otherwise r shall since therefore would www".split()
#: A pair is a term if its log-likelihood ratio is above this.
THRESHOLD = 30.0


def likelihood_ratio(both: Column, first: Column, second: Column, words: Column) -> Column:
    """Dunning's log-likelihood ratio of two words that stand together ``both`` times.

    ``first`` and ``second`` are their own counts among ``words``: twice the logarithm of how much
    likelier the counts are if the second word depends on the first one. Null without other words.
    """

    def log_odds(hits: Column, of: Column, share: Column) -> Column:
        tiny = F.lit(1e-10)
        return hits * F.log(F.greatest(share, tiny)) + (of - hits) * F.log(F.greatest(1 - share, tiny))

    k, a, b, n = (x.cast("double") for x in (both, first, second, words))
    overall, after, elsewhere = F.try_divide(b, n), F.try_divide(k, a), F.try_divide(b - k, n - a)
    return 2 * (log_odds(k, a, after) + log_odds(b - k, n - a, elsewhere) - log_odds(k, a, overall) - log_odds(b - k, n - a, overall))


def stem_of(word: Column) -> Column:
    """``word`` in lower case and without the s of a plural; a word that ends in ss keeps it."""
    low = F.lower(word)
    return F.when(low.endswith("s") & ~low.endswith("ss"), F.left(low, F.length(low) - 1)).otherwise(low)


def folded(counts: DataFrame, label: str) -> DataFrame:
    """(label, stem, word, n) of (label, word, n): cases are one word, and a plural is its singular if that occurs.

    The word is written as most often, of equals as first in code-point order. All steps work on
    one exchange by label and stem, and on one sort: a plural stands beside its singular.
    """
    same = Window.partitionBy(label, "stem")
    plural = F.lower("word") != F.col("stem")
    placed = counts.select(label, "word", "n", stem_of(F.col("word")).alias("stem"))
    beside = placed.withColumn("base", F.when(plural, F.left("word", F.length("word") - 1)).otherwise(F.col("word")))
    both = beside.repartition(label, "stem").withColumn("both_n", F.sum("n").over(Window.partitionBy(label, "stem", "base")))
    found = both.withColumn("has", F.max(~plural).over(same))
    # without a singular every plural is a form of its own; with one, the rows of a base are a form and tell its sum
    form = F.struct((-F.when(F.col("has"), F.col("both_n")).otherwise(F.col("n"))).alias("n"), F.when(F.col("has"), F.col("base")).otherwise(F.col("word")).alias("word"))
    return found.groupBy(label, "stem").agg(F.min(form).alias("best"), F.sum("n").alias("n")).select(label, "stem", F.col("best.word").alias("word"), "n")


def cloud_words(df: DataFrame, label: str, tokens: str, top: int = 200, threshold: float = THRESHOLD, stop_words: Sequence[str] = CLOUD_STOP_WORDS) -> DataFrame:
    """The ``top`` terms of each label: label, word, n, score, place and weight against the label's top term.

    Terms are words and pairs of neighbours in a text, both folded, without pairs that hold a stop
    word. A pair counts if its score, the log-likelihood ratio, is above ``threshold``; its
    occurrences are then taken from both of its words, and words with none left go. Single words
    have no score. Null labels and texts without tokens give nothing, ties go by the word. Pairs do
    not reach from one text into the next, whose order says nothing.

    One pass over the texts counts (label, word, next word); all else works on these counts, which
    are written once. No task holds the words of a label, and only their ``top`` in each of a number
    of parts are put in one order.
    """
    stop = F.lower("word").isin(*stop_words) if stop_words else F.lit(False)
    then = F.when(~F.lower("next").isin(*stop_words), F.col("next")) if stop_words else F.col("next")
    neighbours = F.transform(tokens, lambda word, k: F.struct(word.alias("word"), F.get(tokens, k + 1).alias("next")))
    each = df.where(F.col(label).isNotNull()).select(label, F.explode_outer(neighbours).alias("t")).select(label, "t.word", "t.next")
    pairs = kept(each.where(F.col("word").isNotNull() & ~stop).groupBy(label, "word", then.alias("next")).agg(F.count("*").alias("n")))

    words = kept(folded(pairs.groupBy(label, "word").agg(F.sum("n").alias("n")), label))
    two = folded(pairs.where("next is not null").select(label, F.concat_ws(" ", "word", "next").alias("word"), "n"), label)
    totals = words.groupBy(F.col(label).alias("of")).agg(F.sum("n").alias("words"))
    part = F.split("word", " ")
    parted = two.select(label, "word", "n", stem_of(part[0]).alias("one"), stem_of(part[1]).alias("two")).join(totals, F.col(label) == F.col("of"))
    for side in ("one", "two"):
        own = words.select(F.col(label).alias(f"{side}_of"), F.col("stem").alias(f"{side}_stem"), F.col("n").alias(f"{side}_n"))
        parted = parted.join(own, (F.col(label) == F.col(f"{side}_of")) & (F.col(side) == F.col(f"{side}_stem")))
    score = likelihood_ratio(F.col("n"), F.col("one_n"), F.col("two_n"), F.col("words"))
    terms = kept(parted.select(label, "word", "n", "one", "two", score.alias("score")).where(F.col("score") > threshold))

    taken = terms.select(label, F.explode(F.array("one", "two")).alias("stem"), "n").groupBy(F.col(label).alias("of"), F.col("stem").alias("taken_stem")).agg(F.sum("n").alias("taken"))
    left = words.join(taken, (F.col(label) == F.col("of")) & (F.col("stem") == F.col("taken_stem")), "left").withColumn("n", F.col("n") - F.coalesce("taken", F.lit(0)))
    singles = left.where("n > 0").select(label, "word", "n", F.lit(None).cast("double").alias("score"))
    return ranked(singles.unionByName(terms.select(label, "word", "n", "score")), label, top)
