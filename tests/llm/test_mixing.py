import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing
from tests.llm import brute

LEVELS = ["domain", "lang", "source"]


def dealt(budget, children):
    """children: [(name, weight, capacity)]; the plain loop: full children leave, the rest share again."""
    from fractions import Fraction

    out = {n: 0 for n, w, _ in children if not w}
    children = [c for c in children if c[1]]
    open_, left = {n: (w, c) for n, w, c in children}, min(budget, sum(c for _, _, c in children))
    while open_:
        level = Fraction(left, sum(w for w, _ in open_.values()))
        full = [n for n, (w, c) in open_.items() if c <= level * w]
        if not full:
            upto, total = 0, sum(w for w, _ in open_.values())
            for n in sorted(open_, key=lambda x: (x is not None, x or "")):
                w = open_[n][0]
                out[n] = left * (upto + w) // total - left * upto // total
                upto += w
            return out
        for n in full:
            out[n] = open_.pop(n)[1]
            left -= out[n]
    return out


def expected(rows, weights, percent, epochs, seed=7):
    """rows: (id, text, domain, lang, source); the taken (id, epoch)."""
    tokens = [(r, len(brute.WORD.findall(r[1] or ""))) for r in rows]
    total = defaultdict(int)
    for r, n in tokens:
        total[r[2:]] += n
    budgets = {(): sum(total.values()) * percent // 100}
    for depth, level in enumerate(LEVELS):
        below = {}
        for path, budget in budgets.items():
            nodes = defaultdict(int)
            for leaf, n in total.items():
                if leaf[:depth] == path:
                    used = all(weights.get(x, {}).get(v, 1) for x, v in zip(LEVELS, leaf, strict=True))
                    nodes[leaf[depth]] += n * epochs * used
            for name, x in dealt(budget, [(k, weights.get(level, {}).get(k, 1), c) for k, c in nodes.items()]).items():
                below[(*path, name)] = x
        budgets = below
    taken = set()
    for leaf, n in total.items():
        whole, over = divmod(budgets[leaf], n) if n else (0, 0)
        mine = [(hashlib.md5(f"{seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0], k) for r, k in tokens if r[2:] == leaf]
        taken |= {(i, e) for _, i, _ in mine for e in range(whole)}
        used = 0
        for _, i, k in sorted(mine):
            used += k
            if over and used <= over:
                taken.add((i, whole))
    return taken, budgets


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")


@pytest.mark.parametrize(("percent", "epochs", "zero"), [(10, 1, 0), (60, 1, 0), (100, 1, 0), (150, 4, 0), (900, 4, 0), (60, 1, 1), (400, 4, 1)])
def test_matches_the_plain_loop(spark, percent, epochs, zero):
    rows = [(i, "w " * (1 + (i * 37) % 90), "ab"[i % 2], ["en", "de", None][i % 3], f"s{i % 5 if i % 7 else 0}") for i in range(900)]
    weights = {"domain": {"a": 5}, "lang": {"en": 3, "de": 2}, "source": {"s0": 4, "s3": 9}}
    if zero:  # a whole domain's language and one source get nothing
        weights["lang"]["de"] = weights["source"]["s2"] = 0
    want, budgets = expected(rows, weights, percent, epochs)
    levels = {n: F.col(n) for n in LEVELS}
    got = mixing.mixture(make(spark, rows), levels, weights, percent, epochs).collect()
    assert {(r["doc_id"], r["epoch"]) for r in got} == want and len(got) == len(want)
    leaves = mixing.plan(make(spark, rows), levels, weights, percent, epochs)[1].collect()
    assert {tuple(r[n] for n in LEVELS): r["alloc"] for r in leaves} == budgets
    held = sum(len(brute.WORD.findall(r[1])) for r in rows)
    usable = sum(len(brute.WORD.findall(r[1])) for r in rows if all(weights.get(x, {}).get(v, 1) for x, v in zip(LEVELS, r[2:], strict=True)))
    assert sum(budgets.values()) == min(held * percent // 100, usable * epochs)


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "a", "en", "s"), (3, "one two", "a", "en", "s"), (3, "one two", "a", "en", "s"), (None, "x", "a", None, "s"), (5, "y " * 300_000, "b", "en", "t")]
    levels = {n: F.col(n) for n in LEVELS}
    got = mixing.mixture(make(spark, rows), levels, {}, 100, 1).collect()
    assert sorted(r["n_tokens"] for r in got if r["n_tokens"]) == [1, 2, 2, 300_000]
    assert mixing.mixture(make(spark, []), levels, {}, 50, 2).collect() == []
    docs = make(spark, rows).withColumn("epochs", F.lit(1)).withColumn("cut", F.lit("x")).withColumn("tokens", F.lit(2))
    kept = mixing.mixed(docs, levels, {}, 300, 3)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 3


def test_weights_of_zero_and_below(spark):
    rows = [(i, "one two three", "ab"[i % 2], "en", "s") for i in range(10)]
    levels = {n: F.col(n) for n in LEVELS}
    got = mixing.mixture(make(spark, rows), levels, {"domain": {"a": 0}}, 100, 1).collect()
    assert {r["doc_id"] for r in got} == {1, 3, 5, 7, 9}
    assert mixing.mixture(make(spark, rows), levels, {"domain": {"a": 0, "b": 0}}, 100, 1).collect() == []
    with pytest.raises(ValueError, match="below 0"):
        mixing.mixture(make(spark, rows), levels, {"lang": {"en": -1}}, 100, 1)


def test_columns_of_documents_may_have_any_names(spark):
    rows = [(i, "one two three", "ab"[i % 2], "en", "s") for i in range(10)]
    docs = make(spark, rows)
    for name in ("__cut", "__leaf_0", "__epochs", "__copies", "__epoch", "mix_cut", "mix_0", "mix_epoch", "id", "h", "n_tokens", "alloc", "epochs", "over", "a b"):
        docs = docs.withColumn(name, F.lit(name))
    levels = {n: F.col(n) for n in LEVELS}
    kept = mixing.mixed(docs, levels, {}, 50, 1)
    assert kept.columns == docs.columns and 0 < kept.count() <= 5
    assert mixing.mixture(docs, levels, {}, 50, 1).count() == kept.count()
