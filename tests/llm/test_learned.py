"""The three operators that learn from labels: held-out accuracy, exact counts and edge rows."""

import re
import string
import zlib

import numpy as np
import pytest

from tarn.llm import isolation, rules, toxicity
from tarn.llm.labelled import sample
from tests.conftest import DATA
from tests.llm import brute

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def held(spark):
    return spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").cache(), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")


def rates(scored, labels, label):
    rows = [(r["predicted"], r[label]) for r in scored.where("held_out").join(labels, "doc_id").collect()]
    assert len(rows) > 300
    return [np.mean([p == c for p, y in rows if y == c]) for c in (0, 1)]


def test_quality_of_held_out_rows(held):
    poor, good = rates(rules.quality(*held), held[1], "quality")
    assert poor >= 0.95 and good >= 0.995


def test_toxicity_of_held_out_rows(held):
    ordinary, toxic = rates(toxicity.toxicity(*held), held[1], "toxic")
    assert ordinary >= 0.99 and toxic >= 0.85


def test_quality_rules_keep_good_and_drop_poor_rows_that_calibrated_nothing(held):
    rows = isolation.quality_rules(*held).join(held[1], "doc_id").where("not base_failed").collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % isolation.FOLDS == isolation.HELD_FOLD]
    kept = {c: np.mean([r["kept"] for r in rows if r["quality"] == c]) for c in (0, 1)}
    assert kept[1] >= 0.99 and kept[0] <= 0.05


def path(forest, t, row, node=0, depth=0):
    """The path length of a row in a tree, by the tree's own splits."""
    f = forest.feature[t, node]
    if f < 0:
        return forest.length[t, node]
    assert depth < isolation.DEPTH
    return path(forest, t, row, 2 * node + (2 if row[f] > forest.bound[t, node] else 1), depth + 1)


def test_path_lengths_and_scores_match_a_plain_walk():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 3))
    x[:5] += 12
    forest = isolation.grow(x, np.ones(300))
    c = lambda n: 2 * sum(1 / k for k in range(1, n)) - 2 * (n - 1) / n
    assert abs(isolation._expected(isolation.SUBSAMPLE) - c(isolation.SUBSAMPLE)) < 0.05
    scores = forest.scores(x)
    for i in range(0, 300, 17):
        mean = np.mean([path(forest, t, x[i]) for t in range(isolation.TREES)])
        assert np.isclose(scores[i], 2 ** (-mean / isolation._expected(isolation.SUBSAMPLE)))
    assert scores[:5].min() > np.quantile(scores[5:], 0.99)
    # a leaf's length is its depth and what its rows would still need; a tree's leaves hold its subsample
    depth = np.floor(np.log2(np.arange(1, 2 ** (isolation.DEPTH + 1))))
    leaves = (forest.feature < 0) & (forest.length > 0)
    assert (forest.length[leaves] >= np.broadcast_to(depth, leaves.shape)[leaves]).all()


def test_thresholds_cost_the_least():
    draw = np.random.default_rng(2)
    for _ in range(30):
        score, good = draw.integers(0, 12, 40) / 13, draw.random(40) < 0.7
        weight = draw.integers(1, 4, 40).astype(float)
        cost = lambda t: (weight * ~good * (score <= t)).sum() + isolation.COST * (weight * good * (score > t)).sum()
        assert cost(isolation.calibrated(score, good, weight)) == min(cost(t) for t in [-1, *score])
    assert isolation.calibrated(score, np.ones(40, bool), weight) == 1.0


def test_every_labelled_row_takes_part_in_the_thresholds(spark):
    """No bound on the labelled rows: the thresholds are the best ones over all rows, beyond 6,000 of a class too."""
    draw = np.random.default_rng(3)
    words, ids = draw.integers(60, 400, 15_000), range(15_000)
    rows = [(i, int(n), int(n * draw.integers(4, 9)), int(draw.integers(0, 30)), 0, int(n * draw.random() / 3), 20, int(draw.random() < 0.9)) for i, n in zip(ids, words, strict=True)]
    made = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{k} long" for k in isolation.STORED) + ", quality int")
    forests = isolation.fit(made.drop("quality"), made.select("doc_id", "quality"))
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % isolation.FOLDS != isolation.HELD_FOLD]
    at = dict(zip(isolation.STORED, np.array([r[1:7] for r in learn]).T, strict=True))
    good, rated = np.array([r[7] == 1 for r in learn]), isolation._rates(at)
    assert good.sum() > 6_000
    for name, columns in isolation.FAMILIES.items():
        score = isolation._told(forests[name], np.stack([rated[k] for k in columns], axis=1))
        assert forests[name].threshold == isolation.calibrated(score, good, np.ones(len(good)))


def counts(text):
    text = text or ""
    words = brute.WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in seen for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(brute.WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    extra = {10_000 + i: t for i, t in enumerate(["", None, "a\na\n\n \na", "x y z x y z", "\n", "é ü\né ü\n", "a b a b a b", "#*$%&|<>", "a\r\na\r\n", "w " * 60, "a b c d\n" * 3 + "q" * 50_000])}
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(extra.items()), DOCS))
    for r in isolation.quality_rules(docs, labels).collect():
        n = counts((texts | extra)[r["doc_id"]])
        assert tuple(r[k] for k in isolation.COUNTS) == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (2, 0, 1)]])
def test_edge_rows(spark, labels):
    rows = [(1, "some words here"), (2, "idiot idiot ###"), (3, None), (4, ""), (None, "x"), (5, "long " * 100_000), (5, "long " * 100_000)]
    docs = spark.createDataFrame([(*r, 1, "clash", 2.0) for r in rows], DOCS + ", score int, label string, stat_mean_word double")
    marked = spark.createDataFrame(labels, LABELS)
    for scored in (rules.quality(docs, marked), toxicity.toxicity(docs, marked)):
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows if i}
    assert isolation.quality_rules(docs, marked).count() == len(rows)
    for kept in (rules.keep_good(docs, marked), toxicity.keep_ordinary(docs, marked)):
        assert kept.columns == docs.columns and kept.count() <= len(rows)
    none = docs.limit(0)
    assert rules.quality(none, marked).count() + toxicity.toxicity(none, marked).count() + isolation.quality_rules(none, marked).count() == 0


def test_rules_as_columns_equal_rules_in_numpy(spark, held):
    docs, labels = held
    ensemble = rules.fit(docs, labels)
    rows = rules.statistics(docs.limit(300), ["doc_id"]).withColumn("score", ensemble.column()).toPandas()
    x = rows[rules.STATISTICS].to_numpy()
    total = ensemble.base + sum(w * rules._holds(r, x) for r, w in ensemble.rules)
    assert np.allclose(rows["score"], 1 / (1 + np.exp(-total)))


def test_samples_are_bounded_and_weighted(spark):
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(1000)], LABELS)
    from pyspark.sql import functions as F

    rows = sample(labels, "quality", F.lit(True), rows=50).collect()
    assert len(rows) == 100 and {(r["label"], r["weight"]) for r in rows} == {(0, 2.0), (1, 18.0)}


def shape(text):
    """The statistics of the quality rules, one by one."""
    text = text or ""
    words, data = brute.WORD.findall(text), text.encode()
    n, _, symbols, dup, repeated = counts(text)
    lines = sum(bool(brute.WORD.search(x)) for x in text.split("\n"))
    lengths = [len(w.encode()) for w in words]
    upper, low, digit = (sum(a <= b <= z for b in data) for a, z in ((65, 90), (97, 122), (48, 57)))
    high = sum(b >= 128 for b in data)
    punct = sum(chr(b) in string.punctuation for b in data)
    return {
        "log_words": np.log1p(n),
        "mean_word": sum(lengths) / max(n, 1),
        "symbol_rate": symbols / max(n, 1),
        "upper_rate": upper / max(upper + low + high / 2, 1),
        "digit_rate": digit / max(len(data), 1),
        "punct_rate": punct / max(n, 1),
        "repeat_rate": repeated / max(n, 1),
        "dup_line_rate": dup / max(lines, 1),
        "distinct_rate": len({brute.lower(w) for w in words}) / max(n, 1),
        "words_per_line": np.log1p(n / max(lines, 1)),
        "long_word_rate": sum(k > 14 for k in lengths) / max(n, 1),
    }


def test_statistics_match_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    texts |= {10_000 + i: t for i, t in enumerate(["", None, "\n \n", "É ü É\né ü", "A" * 15 + " b", "x1 2 3\nx1 2 3\nx1 2 3", "a\x0bb\x1cc", "~`{|}[]^_:;<=>?@ !", "w " * 3000])}
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in texts.items()], DOCS + ", label string, log_words double")
    got = rules.statistics(docs, ["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        want = shape(texts[r["doc_id"]])
        assert all(np.isclose(r[k], want[k]) for k in rules.STATISTICS), r["doc_id"]
