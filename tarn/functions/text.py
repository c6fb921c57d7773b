"""Cleaning and tokenizing short texts. All functions give null for a null text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, and the English stop words of the NLTK corpora, cut at apostrophes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same
so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn
hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()


def without_handles(text: Column) -> Column:
    """``text`` without its @handles: each one found is deleted everywhere, in the order found.

    So a short handle also leaves a longer one that starts with it, and a bare @ leaves every @.
    """
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"((?U)@\w*)"), F.lit(1)), text, lambda t, h: F.replace(t, h, F.lit("")))


def letters_only(text: Column) -> Column:
    """Every character but a-z, A-Z and # becomes a space."""
    return F.regexp_replace(text, "[^a-zA-Z#]", " ")


def words(text: Column) -> Column:
    """The parts between white space; no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)


def long_words(text: Column, longer_than: int = 3) -> Column:
    """Words of more than so many characters, joined by single spaces."""
    return F.array_join(F.filter(words(text), lambda w: F.length(w) > longer_than), " ")


def without_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def without_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens that are, in lower case, no stop word; their own case and their repeats stay."""
    return F.filter(tokens, lambda w: ~F.lower(w).isin(*stop_words)) if stop_words else tokens


def tidy_words(text: Column, longer_than: int = 3) -> Column:
    """The words that are left of a text without handles, other characters and short words.

    What is no letter and no # parts words, so they are its runs of letters and # that are long enough.
    """
    return F.regexp_extract_all(without_handles(text), F.lit(f"[a-zA-Z#]{{{longer_than + 1},}}"), F.lit(0))


def tidy(text: Column) -> Column:
    """Handles, other characters and short words removed."""
    return F.array_join(tidy_words(text), " ")


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The tokens of a tidy text."""
    return without_stop_words(words(without_punctuation(text)), stop_words)


def tidy_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The tokens of the tidy text of ``text``, without joining and splitting it again."""
    bare = F.transform(tidy_words(text), without_punctuation)
    kept = (lambda w: (w != "") & ~F.lower(w).isin(*stop_words)) if stop_words else (lambda w: w != "")
    return F.filter(bare, kept)


def terms(text: Column) -> Column:
    """Lower-case words of two or more word characters, as a count vectorizer splits them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\b\w\w+\b)"), F.lit(1))
