"""The Porter stemmer of 1980, as a function of one word and as Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published suffix tables of steps 2 to 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(maxsize=100_000)
def _shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str | None) -> str | None:
    """The stem of ``word`` in lower case; words of one or two letters are their own."""
    if word is None:
        return None
    word = word.lower()
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


# The same rules as Spark expressions. In a marked word Y stands for a y that is a consonant: at the
# start and after a vowel.
_VOWEL, _CONSONANT = "[aeiouy]", "[^aeiouy]"


def _some(stem: Column) -> Column:
    """The measure of the stem of a marked word is above 0."""
    return stem.rlike(_VOWEL + _CONSONANT)


def _more(stem: Column) -> Column:
    """Its measure is above 1."""
    return stem.rlike(f"{_VOWEL}{_CONSONANT}+{_VOWEL}+{_CONSONANT}")


def _ends_short(stem: Column) -> Column:
    return stem.rlike(f"{_CONSONANT}{_VOWEL}[^aeiouywxY]\\z")


def _without(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _first(word: Column, rules: Sequence[tuple[Column, Column]]) -> Column:
    """The result of the first rule whose condition holds, else the word."""
    made = F
    for condition, result in rules:
        made = made.when(condition, result)
    return made.otherwise(word)


def _by_suffix(word: Column, suffixes: Iterable[str], made: Callable[[str, Column], Column]) -> Column:
    """``made(suffix, stem)`` of the longest of ``suffixes`` that the word has; the last letter tells which come into question."""
    by_letter: dict[str, list[str]] = {}
    for s in sorted(suffixes, key=len, reverse=True):
        by_letter.setdefault(s[-1], []).append(s)
    return _first(word, [(word.endswith(letter), _first(word, [(word.endswith(s), made(s, _without(word, len(s)))) for s in of])) for letter, of in by_letter.items()])


def _plural(w: Column) -> Column:
    return _first(w, [(w.endswith("sses") | w.endswith("ies"), _without(w, 2)), (w.endswith("s") & ~w.endswith("ss"), _without(w, 1))])


def _past(w: Column) -> Column:
    """Without ed or ing after a vowel, and what is left mended; eed becomes ee."""
    eed = F.when(_some(_without(w, 3)), _without(w, 1)).otherwise(w)
    return _first(w, [(w.endswith("eed"), eed), *((w.endswith(s) & _without(w, len(s)).rlike(_VOWEL), F.get(F.transform(F.array(_without(w, len(s))), _mended), F.lit(0))) for s in ("ed", "ing"))])


def _mended(c: Column) -> Column:
    double = c.rlike(f"(({_CONSONANT})\\2|yY)\\z") & ~F.right(c, F.lit(1)).isin("l", "s", "z")
    short = _some(c) & ~_more(c) & _ends_short(c)
    return _first(c, [(c.rlike("(at|bl|iz)\\z"), F.concat(c, F.lit("e"))), (double, _without(c, 1)), (short, F.concat(c, F.lit("e")))])


def _last_y(w: Column) -> Column:
    return _first(w, [((w.endswith("y") | w.endswith("Y")) & _without(w, 1).rlike(_VOWEL), F.concat(_without(w, 1), F.lit("i")))])


def _table(table: Mapping[str, str]) -> Callable[[Column], Column]:
    return lambda w: _by_suffix(w, table, lambda s, stem: F.when(_some(stem), F.concat(stem, F.lit(table[s]))).otherwise(w))


def _removed(w: Column) -> Column:
    def rule(s: str, stem: Column) -> Column:
        fits = _more(stem) & stem.rlike("[st]\\z") if s == "ion" else _more(stem)
        return F.when(fits, stem).otherwise(w)

    return _by_suffix(w, STEP_4, rule)


def _last_e_and_l(w: Column) -> Column:
    stem = _without(w, 1)
    no_e = w.endswith("e") & (_more(stem) | (_some(stem) & ~_ends_short(stem)))
    return _first(w, [(no_e, F.when(w.endswith("lle") & _more(stem), _without(w, 2)).otherwise(stem)), (w.endswith("ll") & _more(w), stem)])


def _marked(w: Column) -> Column:
    return F.when(F.contains(w, F.lit("y")), F.regexp_replace(F.regexp_replace(w, "(^|[aeiou])y", "$1Y"), "yy", "yY")).otherwise(w)


STEPS = (lambda w: _marked(_plural(w)), _past, _last_y, _table(STEP_2), _table(STEP_3), _removed, _last_e_and_l)


def stemmed(words: Column) -> Column:
    """The stems of an array of words, in their places; nulls stay null.

    All steps are expressions, so words stay in the JVM and in their rows.
    """
    return F.transform(words, lambda w: F.when(F.length(F.lower(w)) > 2, F.lower(_in_turn(F.lower(w)))).otherwise(F.lower(w)))


def _in_turn(word: Column) -> Column:
    """All steps one after another, each on the value of the one before: an array of one word binds it."""
    held = F.array(word)
    for step in STEPS:
        held = F.transform(held, step)
    return F.get(held, F.lit(0))
