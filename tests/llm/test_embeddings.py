import math

import numpy as np

from tarn.llm.embeddings import near_duplicates
from tests.conftest import DATA
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, least=0.95):
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    ids = list(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = brute.union_find([i for i, _ in rows], links)
    return {i: (n[i], root[i], root[i] == i) for i, _ in rows}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_matches_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    assert result(near_duplicates(df)) == expected(rows)


def test_groups_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.08).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, base.astype(np.float32).tolist()) for i in range(50)]
    rows += [(2000 + i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(100)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] * 16), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (3006, base[:8].astype(np.float32).tolist()), (3007, (base * 1e30).astype(np.float32).tolist())]
    want, got = expected(rows), result(near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    pairs = sum(n for n, _, _ in want.values())
    assert all(g[0] <= want[i][0] for i, g in got.items())
    assert sum(n for n, _, _ in got.values()) >= 0.99 * pairs
    assert {i: g[1:] for i, g in got.items()} == {i: w[1:] for i, w in want.items()}


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [2.0, 0.0])]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)]


def test_extra_columns_with_the_names_of_its_own(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], f"{SCHEMA}, id string, v string, rep string, `key` string, n_links string, kept string")
    assert result(near_duplicates(df)) == expected(rows)


def test_integers_and_doubles_are_vectors_too(spark):
    rows = [(1, [3, 4]), (2, [30, 40]), (3, [4, -3]), (4, None)]
    for kind in ("int", "double"):
        df = spark.createDataFrame([(i, v and [float(x) if kind == "double" else x for x in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>")
        assert result(near_duplicates(df)) == expected(rows)
