"""The stemmer as DuckDB SQL: one step a subquery, for the oracles of stemmed texts."""

from __future__ import annotations

from tarn.functions.stem import STEP_2, STEP_3, STEP_4

# Y stands for a y that is a consonant: at the start and after a vowel.
_VOWEL, _CONSONANT = "[aeiouy]", "[^aeiouy]"


def _some(stem: str) -> str:
    """The stem's measure is above 0."""
    return f"regexp_matches({stem}, '{_VOWEL}{_CONSONANT}')"


def _more(stem: str) -> str:
    """The stem's measure is above 1."""
    return f"regexp_matches({stem}, '{_VOWEL}{_CONSONANT}+{_VOWEL}+{_CONSONANT}')"


def _cut(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def _short_end(stem: str) -> str:
    return f"regexp_matches({stem}, '{_CONSONANT}{_VOWEL}[^aeiouywxY]$')"


def _longest(suffixes, made) -> str:
    """The rule of the longest of ``suffixes`` that the word has; ``made(suffix)`` is its result."""
    cases = " ".join(f"WHEN ends_with(w, '{s}') THEN {made(s)}" for s in sorted(suffixes, key=len, reverse=True))
    return f"CASE {cases} ELSE w END"


def _table(table: dict[str, str]) -> str:
    return _longest(table, lambda s: f"CASE WHEN {_some(_cut('w', len(s)))} THEN {_cut('w', len(s))} || '{table[s]}' ELSE w END")


def _last(s: str) -> str:
    stem = _cut("w", len(s))
    more = f" AND right({stem}, 1) IN ('s', 't')" if s == "ion" else ""
    return f"CASE WHEN {_more(stem)}{more} THEN {stem} ELSE w END"


def _steps() -> list[str]:
    marked = "regexp_replace(regexp_replace(w, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    plural = f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut('w', 1)} ELSE w END"
    held = " ".join(f"WHEN NOT ends_with(w, 'eed') AND ends_with(w, '{s}') AND regexp_matches({_cut('w', len(s))}, '{_VOWEL}') THEN {_cut('w', len(s))}" for s in ("ed", "ing"))
    double = f"length(c) > 1 AND right(c, 1) = left(right(c, 2), 1) AND regexp_matches(right(c, 1), '{_CONSONANT}') AND right(c, 1) NOT IN ('l', 's', 'z')"
    mended = f"""CASE WHEN c IS NULL THEN CASE WHEN ends_with(w, 'eed') AND {_some(_cut('w', 3))} THEN {_cut('w', 1)} ELSE w END
WHEN ends_with(c, 'at') OR ends_with(c, 'bl') OR ends_with(c, 'iz') THEN c || 'e' WHEN {double} THEN {_cut('c', 1)}
WHEN {_some('c')} AND NOT {_more('c')} AND {_short_end('c')} THEN c || 'e' ELSE c END"""
    y = f"CASE WHEN lower(right(w, 1)) = 'y' AND regexp_matches({_cut('w', 1)}, '{_VOWEL}') THEN {_cut('w', 1)} || 'i' ELSE w END"
    e = f"CASE WHEN ends_with(w, 'e') AND ({_more(_cut('w', 1))} OR ({_some(_cut('w', 1))} AND NOT {_short_end(_cut('w', 1))})) THEN {_cut('w', 1)} ELSE w END"
    ll = f"CASE WHEN ends_with(w, 'll') AND {_more('w')} THEN {_cut('w', 1)} ELSE w END"
    return [marked, plural, f"{mended} FROM (SELECT *, CASE {held} END AS c FROM {{0}})", y, _table(STEP_2), _table(STEP_3), _longest(STEP_4, _last), e, ll]


def stems(tokens: str) -> str:
    """Subqueries that end in ``stems`` (token, stem), from the column ``token`` of the query ``tokens``."""
    parts = [f"s0 AS (SELECT token, lower(token) AS w FROM ({tokens}) WHERE length(token) > 2)"]
    steps = _steps()
    for k, step in enumerate(steps):
        value, _, source = step.partition(" FROM (")
        inner = f"({source}".format(f"s{k}") if source else f"s{k}"
        parts.append(f"s{k + 1} AS (SELECT token, {value} AS w FROM {inner})")
    return ",\n".join(parts) + f",\nstems AS (SELECT token, lower(w) AS stem FROM s{len(steps)} UNION ALL SELECT token, lower(token) FROM ({tokens}) WHERE length(token) <= 2)"
