import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarn.operators import collocations


def ratio(k, a, b, n):
    def log_odds(hits, of, share):
        return hits * math.log(max(share, 1e-10)) + (of - hits) * math.log(max(1 - share, 1e-10))

    return 2 * (log_odds(k, a, k / a) + log_odds(b - k, n - a, (b - k) / (n - a)) - log_odds(k, a, b / n) - log_odds(b - k, n - a, b / n))


def folded(counts):
    """Counts of words by stem: {stem: (word, n)}"""
    groups = defaultdict(Counter)
    for word, n in counts.items():
        groups[word.lower()][word] += n
    for key in sorted(groups):
        if key.endswith("s") and not key.endswith("ss") and key[:-1] in groups:
            for word, n in groups.pop(key).items():
                groups[key[:-1]][word[:-1]] += n
    cut = lambda k: k[:-1] if k.endswith("s") and not k.endswith("ss") else k
    return {cut(k): (min(c, key=lambda w: (-c[w], w)), sum(c.values())) for k, c in groups.items()}


def plain(texts, threshold, stop=("also",)):
    words, pairs = Counter(), Counter()
    for tokens in texts:
        words.update(w for w in tokens if w.lower() not in stop)
        pairs.update(f"{a} {b}" for a, b in zip(tokens, tokens[1:]) if a.lower() not in stop and b.lower() not in stop)
    single, double = folded(words), folded(pairs)
    total = sum(n for _, n in single.values())
    left, out = {s: n for s, (_, n) in single.items()}, {}
    cut = lambda k: k[:-1] if k.endswith("s") and not k.endswith("ss") else k
    for word, n in double.values():
        parts = [cut(p.lower()) for p in word.split(" ")]
        score = ratio(n, single[parts[0]][1], single[parts[1]][1], total)
        if score > threshold:
            out[word] = (n, round(score, 6))
            for p in parts:
                left[p] -= n
    return out | {single[s][0]: (n, None) for s, n in left.items() if n > 0}


TEXTS = [
    "Flight delay again Flight delays flight delay".split(),
    "late flights late Flight bags bag bag glass glasses glasses".split(),
    "customer service also customer service bad customers services".split(),
    "customer also service flight delay customer service".split(),
    "very very good news good newss".split(),
    [],
    ["single"],
]


@pytest.mark.parametrize("threshold", [-1e9, 2.0, 8.0, 1e9])
def test_equals_a_plain_version(spark, threshold):
    rows = [("x", t) for t in TEXTS] * 3 + [("y", TEXTS[0]), (None, ["lost", "words"]), ("z", None), ("y", ["Cats", "cats", "CATS", "cat"])]
    df = spark.createDataFrame(rows, "label string, tokens array<string>").withColumns({"word": F.lit(1), "n": F.lit("n"), "stem": F.lit("s")})
    made = defaultdict(dict)
    for r in collocations.cloud_words(df, "label", "tokens", 1000, threshold, ["also"]).collect():
        made[r.label][r.word] = (r.n, r.score and round(r.score, 6))
    assert made == {"x": plain(TEXTS * 3, threshold), "y": plain([TEXTS[0], ["Cats", "cats", "CATS", "cat"]], threshold)}


def test_top_words_are_ranked_with_pairs(spark):
    df = spark.createDataFrame([("x", TEXTS[2])] * 40, "label string, tokens array<string>")
    made = collocations.cloud_words(df, "label", "tokens", 3, 30.0, []).orderBy("place").collect()
    assert [(r.place, r.n == made[0].n * r.weight) for r in made] == [(1, True), (2, True), (3, True)]
    assert "customer service" in {r.word for r in made}


def test_an_empty_table_has_no_words(spark):
    assert collocations.cloud_words(spark.createDataFrame([], "label string, tokens array<string>"), "label", "tokens").collect() == []


def test_forms_are_folded_with_one_sort(spark):
    counts = [("x", w, n) for w, n in (("CATS", 2), ("CATs", 2), ("Cat", 1), ("cats", 3), ("Dogs", 1), ("dogs", 1), ("DOGS", 4), ("glass", 1), ("Glass", 1), ("s", 2), ("S", 3))]
    counts += [("y", "cats", 3), ("y", "Cats", 3), ("y", "cat", 2), ("y", "Cat", 2)]
    made = collocations.folded(spark.createDataFrame(counts, "label string, word string, n long"), "label")
    want = {("x", "CAT", 8), ("x", "DOGS", 6), ("x", "Glass", 2), ("x", "S", 5), ("y", "Cat", 10)}
    assert {(r.label, r.word, r.n) for r in made.collect()} == want
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len([line for line in plan.split("\n") if "Sort [" in line]) == 1
