import math
import zlib
from collections import Counter

import numpy as np

from tarn.llm import lm
from tests.conftest import DATA
from tests.llm import brute


def expected(rows):
    tokens = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*brute.WORD.findall(brute.lower(t or "")), ""]) for i, t in rows]
    counts = Counter(w for _, held, ws in tokens if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held, len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, held, ws in tokens}, counts


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        held, tokens, known, n, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] <= 0


def test_counts_match_brute_force_and_the_model_beats_the_base(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    want, _ = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = lm.scores(docs).collect()
    check(got, want)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (9, "b A a"), (12, "a " * 200_000), (13, "ÉÉ é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, held_out string")
    check(lm.scores(df).collect(), expected(rows)[0])
    taught = next(i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2)
    again = spark.createDataFrame([(taught, "a b"), (taught, "a b"), (None, "c")], "doc_id long, text string")
    assert [r["train_tokens"] for r in lm.scores(again).collect()] == [8, 8, 8]
    assert lm.scores(df.select("doc_id", "text").limit(0)).collect() == []


def test_probabilities_of_every_context_add_up_to_one():
    draw = np.random.default_rng(2)
    size = (40, lm.DIMS)
    model = lm.Model(draw.normal(size=size).astype(np.float32), draw.normal(size=size).astype(np.float32), draw.normal(size=40).astype(np.float32), draw.normal(size=(2, lm.DIMS)).astype(np.float32), 1)
    near, far, norm = lm._tables(model)
    for a in range(0, 40, 7):
        for b in range(0, 40, 5):
            assert math.isclose(np.exp(near[a].astype(float) + far[b] - norm[a, b]).sum(), 1, rel_tol=1e-4)
    words = np.array([3, 5, 1])
    one = lm.log_probabilities((near, far, norm), 1, words)
    assert math.isclose(one[2], near[5, 1] + far[3, 1] - norm[5, 3], rel_tol=1e-5) and math.isclose(one[0], near[1, 3] + far[1, 3] - norm[1, 1], rel_tol=1e-5)


def test_training_lowers_the_loss():
    draw = np.random.default_rng(2)
    words = np.tile([2, 3, 4, 5, 6, 7], 4000)
    share = np.full(10, 0.1)
    size = (10, lm.DIMS)
    start = lm.Model(draw.normal(0, 0.1, size).astype(np.float32), draw.normal(0, 0.1, size).astype(np.float32), np.log(share).astype(np.float32), np.ones((2, lm.DIMS), np.float32), 1)
    trainer = lm._Trainer(start, share, 0)
    near, far = lm._contexts(words, 1)
    for at in range(0, len(words), 500):
        trainer.step(words[at : at + 500], near[at : at + 500], far[at : at + 500])
    end = lm.Model(*trainer.params, 1)
    assert lm.log_probabilities(lm._tables(end), 1, words).mean() > lm.log_probabilities(lm._tables(start), 1, words).mean() + 1


def test_the_vocabulary_grows_and_frequent_words_are_not_its_bound(spark):
    draw = np.random.default_rng(4)
    pairs = draw.permutation(np.repeat(np.arange(3000), 40))
    texts = [" ".join(f"a{k} b{k}" for k in part) for part in np.split(pairs, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.union(spark.createDataFrame([(1000 + k, f"a{k} b{k}") for k in range(200)] + [(2000 + k, f"a{k} b{k + 1}") for k in range(200)], "doc_id long, text string"))
    rows = {r["doc_id"]: r["score"] for r in lm.scores(docs).collect()}
    # 6,000 words of about one count: what follows a word is told by the word only
    assert np.mean([rows[1000 + k] - rows[2000 + k] for k in range(200)]) > 0.1


def test_probabilities_over_classes_add_up_to_one(tmp_path):
    plan = lm.layout({-1: [0] * 24 + [2000, 0, 0, 100], -2: [0] * 24 + [1500, 20]}, 50, 10)
    assert plan.classes > 1 and plan.parts > plan.classes and plan.words == 3622
    draw = np.random.default_rng(2)
    np.save(tmp_path / "0.npy", draw.normal(size=(plan.rows, 2 * lm.DIMS + 1)).astype(np.float32))
    made = lm.Vectors(str(tmp_path), plan).log_probabilities([np.array([5, 3600, w]) for w in range(plan.words)])
    assert math.isclose(sum(math.exp(x[2]) for x in made), 1, rel_tol=1e-4)


def test_rare_words_are_told_apart_by_their_counts_and_long_texts_have_an_end(spark):
    taught = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:8]
    held = [i for i in range(60, 400) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    # the end is rarer than any known word, and far rarer than most
    rows = [(i, " ".join(f"w{(k * (i + 1)) % 97}" for k in range(4000)) + (" once" if i == taught[0] else "") + " thrice" * (i in taught[1:4])) for i in taught]
    rows += list(zip(held, ["once", "thrice", "never", "w3"], strict=True))
    got = {r["doc_id"]: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check(got.values(), expected(rows)[0])
    once, thrice, never = (got[i]["score"] for i in held[:3])
    assert math.isclose(once - never, math.log10(2), rel_tol=1e-6) and math.isclose(thrice - never, math.log10(4), rel_tol=1e-6)


def test_copies_are_averaged_by_what_they_have_seen(spark, monkeypatch):
    """Many small copies in groups: the model still learns what follows a word."""
    monkeypatch.setattr(lm, "COPY_TOKENS", 3000)
    draw = np.random.default_rng(4)
    texts = [" ".join(f"a{k} b{k}" for k in draw.integers(0, 30, 250)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(25)
    docs = docs.union(spark.createDataFrame([(1000 + k, f"a{k} b{k}") for k in range(30)] + [(2000 + k, f"a{k} b{(k + 1) % 30}") for k in range(30)], "doc_id long, text string"))
    rows = {r["doc_id"]: r["score"] for r in lm.scores(docs).collect()}
    assert np.mean([rows[1000 + k] - rows[2000 + k] for k in range(30)]) > 0.3


def test_scores_do_not_depend_on_how_the_work_is_split(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    made = []
    for parts in (1, 9):
        rows = [r for r in lm.scores(docs.repartition(parts, "doc_id")).collect() if r["held_out"]]
        made.append(sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows))
    assert abs(made[0] - made[1]) < 0.01


def test_scoring_does_no_work_of_its_own_for_each_part(tmp_path, monkeypatch):
    plan = lm.layout({-1: [0] * 24 + [2000, 0, 0, 100], -2: [0] * 24 + [1500, 20]}, 50, 10)
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(plan.rows, 2 * lm.DIMS + 1)).astype(np.float32)
    rows[plan.heads + 5, lm.DIMS : -1] *= 100  # sums of exponentials out of the range of single precision
    np.save(tmp_path / "0.npy", rows)
    calls, picked = [], lm._picked
    monkeypatch.setattr(lm, "_picked", lambda *a: calls.append(1) or picked(*a))
    texts = [draw.integers(1, plan.words, 3000) for _ in range(3)] + [np.array([1])]
    got = lm.Vectors(str(tmp_path), plan).log_probabilities(texts)
    assert len(calls) < plan.parts
    places = rows[-1, :-1].reshape(2, lm.DIMS).astype(float)
    outer, vectors = lm._outer_rows(plan), rows.astype(float)

    def log_share(predicted, members, one):
        scores = vectors[members, lm.DIMS : -1] @ predicted + vectors[members, -1]
        return scores[list(members).index(one)] - scores.max() - np.log(np.exp(scores - scores.max()).sum())

    for text, made in zip(texts, got, strict=True):
        padded = [1, 1, *text]
        for k in [*range(0, len(text), 97), *np.flatnonzero((text - plan.heads) // plan.size == 0)[:20]]:
            predicted = vectors[padded[k + 1], : lm.DIMS] * places[0] + vectors[padded[k], : lm.DIMS] * places[1]
            part = (text[k] - plan.heads) // plan.size
            of = part // plan.size
            want = log_share(predicted, outer, text[k] if text[k] < plan.heads else plan.words + plan.parts + of)
            if text[k] >= plan.heads:
                want += log_share(predicted, np.arange(plan.words + of * plan.size, plan.words + min((of + 1) * plan.size, plan.parts)), plan.words + part)
                want += log_share(predicted, np.arange(plan.heads + part * plan.size, min(plan.heads + (part + 1) * plan.size, plan.words)), text[k])
            assert math.isclose(made[k], want, rel_tol=1e-4, abs_tol=1e-4)


def test_slices_of_files_average_as_whole_files_do(spark, monkeypatch):
    monkeypatch.setattr(lm, "COPY_TOKENS", 3000)
    draw = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in draw.zipf(1.3, 250) % 4000)) for k in range(120)], "doc_id long, text string").repartition(12, "doc_id").cache()
    made = []
    for merged in (1000, 2):
        monkeypatch.setattr(lm, "MERGED", merged)
        made.append({r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.scores(docs).collect()})
    assert max(abs(made[0][k] - made[1][k]) for k in made[0]) < 1e-3
