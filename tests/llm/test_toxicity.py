"""The Kneser-Ney models against a plain version with dictionaries."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tarn.llm import textkernel as tk
from tarn.llm import toxicity
from tests.conftest import DATA
from tests.llm import brute

TEXTS = [
    (0, "The cat sat on the mat. The cat, the dog!"),
    (1, "the Idiot sat on the cat; you idiot*** you"),
    (0, "a dog and a cat and a mat"),
    (1, "you IDIOT and you fool"),
    (0, ""),
    (0, "été l'été the sea"),
]


def words(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", brute.lower(text))


class Plain:
    def __init__(self, texts):
        self.n = [defaultdict(Counter), defaultdict(Counter)]
        for c, text in texts:
            for h, w in zip([None, *words(text)], words(text)):
                self.n[c][h][w] += 1
        self.after = [Counter(w for h in n for w in n[h]) for n in self.n]

    def shared(self, w):
        classes = Counter(w for after in self.after for w in after)
        total = sum(classes.values())
        return (classes[w] - toxicity.DISCOUNT) / total if w in classes else toxicity.DISCOUNT * len(classes) / total

    def alone(self, c, w):
        total = sum(self.after[c].values())
        return max(self.after[c][w] - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(self.after[c]) / total * self.shared(w)

    def after_word(self, c, h, w):
        n = self.n[c].get(h)
        if not n:
            return self.alone(c, w)
        total = sum(n.values())
        return max(n[w] - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(n) / total * self.alone(c, w)


def batch(texts):
    ((_, _, buf, offsets),) = tk.slices(pa.array(texts))
    return buf, offsets


def model_of(spark, texts):
    return toxicity.estimate(toxicity._counts(spark.createDataFrame(texts, "label int, text string")))


def test_log_likelihoods_equal_a_plain_version(spark):
    plain, model = Plain(TEXTS), model_of(spark, TEXTS)
    asked = [t for _, t in TEXTS if t] + ["idiot the unknown words and a cat", "new idiot", "sea mat you"]
    for text in asked:
        ws = words(text)
        _, word, before = toxicity._tokens(*batch([text]))
        alone, paired = toxicity.gains(model, word, before)
        assert np.allclose(alone, [math.log(plain.alone(1, w) / plain.alone(0, w)) for w in ws])
        assert np.allclose(paired, [math.log(plain.after_word(1, h, w) / plain.after_word(0, h, w)) for h, w in zip([None, *ws], ws)])
    a, p, n = toxicity.differences(model, *batch(asked))
    for k, text in enumerate(asked):
        ws = words(text)
        ratios = [plain.after_word(1, h, w) / plain.after_word(0, h, w) for h, w in zip([None, *ws], ws)]
        assert n[k] == len(ws) and math.isclose(p[k], sum(math.log(1 + toxicity.TOXIC_SHARE * (r - 1)) for r in ratios), rel_tol=1e-4, abs_tol=1e-7)


def test_distributions_of_both_classes_add_up_to_one():
    plain = Plain(TEXTS)
    kinds = sorted({w for _, t in TEXTS for w in words(t)}) + ["never"]
    assert math.isclose(sum(map(plain.shared, kinds)), 1)
    for c in (0, 1):
        assert math.isclose(sum(plain.alone(c, w) for w in kinds), 1)
        assert all(math.isclose(sum(plain.after_word(c, h, w) for w in kinds), 1) for h in (None, "the", "you", "never"))


def test_an_expression_of_ordinary_words_is_seen(spark):
    base = [f"w{i} w{(i * 7) % 40} w{(i * 11) % 40} w{(i * 13) % 40}" for i in range(400)]
    rows = [(i, (f"{t} red fish go home {t}" if i % 4 == 0 else f"{t} red go fish home {t}"), int(i % 4 == 0)) for i, t in enumerate(base)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_counts_are_of_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    from tarn.llm.labelled import texts_of

    chosen = spark.createDataFrame([(1, 1, 1.0), (2, 0, 1.0)], "doc_id long, label int, weight double")
    assert sorted(tuple(r) for r in texts_of(docs, chosen).collect()) == [(1, 1, 1.0, "a"), (2, 0, 1.0, "")]


def test_figures_of_the_readme(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = {c: np.mean([r["predicted"] == c for r in rows if r["toxic"] == c]) for c in (0, 1)}
    assert right[1] >= 0.92 and right[0] >= 0.995
