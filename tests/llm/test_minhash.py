import random

import numpy as np
from pyspark.sql import types as T

from tarn.llm import textkernel as tk
from tarn.llm.components import components
from tarn.llm.minhash import MAX_ERRORS, SLOTS, _keys, deduplicate, near_duplicates
from tests.conftest import DATA
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def expected(rows, width):
    return {i: (n, c, c == i) for i, (n, c) in brute.near_duplicates(rows, width).items()}


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for width in (2, 5):
        assert result(near_duplicates(docs, width=width)) == expected(rows, width)


def test_group_of_near_copies_and_chains(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(300):  # near copies of one text, many below the threshold of each other
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[3][1].upper()) for i in range(200)]
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(near_duplicates(df, width=2)) == expected(rows, 2)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\x0btwo"), (8, "x" * 200_000), (9, "x" * 200_000 + "y"), (10, "É é"), (11, "é é"), (12, "a b " * 60_000), (13, "b a " * 60_000 + "b")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], f"{SCHEMA}, key string, component string")
    assert result(near_duplicates(df, width=2)) == expected(rows, 2)
    again = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(again, width=2).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    assert deduplicate(df, width=2).columns == df.columns


def test_pigeonhole_finds_every_signature_within_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, SLOTS), dtype=np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(SLOTS, MAX_ERRORS, replace=False)] ^= np.uint64(1)
    assert (_keys(a) == _keys(b)).any(axis=1).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(50)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(edges, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{1000 + i: 7 for i in range(50)}}


def test_words_split_at_text_ends():
    import pyarrow as pa

    texts = ["ab cd", None, "", "ef", " g\x0bh ", "é x", "\x1cq"]
    ((lo, hi, buf, offsets),) = tk.slices(pa.array(texts))
    w = tk.split(buf, offsets)
    got = [[] for _ in texts]
    for s, e, d in zip(w.starts, w.ends, w.doc, strict=True):
        got[d].append(bytes(buf[s:e]).decode())
    assert (lo, hi) == (0, 7) and got == [brute.WORD.findall(t or "") for t in texts]


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    rng = random.Random(8)
    a, b, c, d = ([f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(4))
    near = lambda t, k: " ".join([*t[:k], "other", *t[k + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 30)), (3, near(b, 20)), (9, near(c, 5)), (9, near(d, 6)), (8, " ".join(c)), (7, " ".join(d)), (6, "alone here"), (5, None), (5, " ".join(a))]
    for _ in range(3):
        rng.shuffle(rows)
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), width=2).collect()
        assert sorted({(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["n_shingles"]}) == [(1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (6, 6, True), (7, 7, True), (8, 7, False), (9, 7, False)]
        assert len(got) == len(rows)


def test_pairs_at_the_threshold_are_linked(spark):
    """Pairs of sets with a similarity of 0.8 exactly and just below, of many sizes."""
    rng, rows, want = random.Random(3), [], {}
    for k in range(400):
        n = 5 * (4 + k % 40)  # a union of n pairs of words: 0.8 n in common
        base = [f"{k}x{i}" for i in range(n + 1)]
        cut_off = n // 5 + (k % 4 == 3)  # with one more left out it is below
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n + 1 - cut_off]))]
        want[2 * k], want[2 * k + 1] = 2 * k, 2 * k + (k % 4 == 3)
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 2 and all(i % 2 and got[i] == i for i in wrong)


def test_blocks_of_long_texts_are_small(spark, monkeypatch):
    from tarn.llm import minhash

    monkeypatch.setattr(minhash, "SHINGLE_BLOCK", 50)
    rng = random.Random(4)
    base = [f"w{rng.randrange(200)}" for _ in range(80)]
    rows = [(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(60)]
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2)) == expected(rows, 2)
