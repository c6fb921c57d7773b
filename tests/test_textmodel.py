import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import features, textmodel

TRAIN = [(1, "cat dog dog"), (2, "dog Eel a"), (3, ""), (4, None)]
NEW = [(10, "dog dog eel fox"), (11, "fox gnu"), (12, None), (13, "CAT cat"), (10, "never twice")]


def terms(text):
    return re.findall(r"\b\w\w+\b", (text or "").lower())


def plain(train, new):
    df = Counter(t for _, text in train for t in set(terms(text)))
    ids = {t: k for k, t in enumerate(sorted(df))}
    out = {}
    for key, text in new:
        tf = Counter(t for t in terms(text) if t in ids)
        w = {t: n * (math.log((1 + len(train)) / (1 + df[t])) + 1) for t, n in tf.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[key] = {ids[t]: (tf[t], round(x / length, 9)) for t, x in w.items()}
    return ids, out


def test_a_stored_model_weighs_other_documents(spark, tmp_path):
    fitted = textmodel.fit(spark.createDataFrame(TRAIN, "id long, text string"), "id", "text")
    assert (fitted.n_docs, fitted.n_terms) == (4, 3)
    fitted.save(str(tmp_path / "model"))
    model = textmodel.load(spark, str(tmp_path / "model"))
    assert (model.n_docs, model.n_terms) == (4, 3)
    new = spark.createDataFrame(NEW[:4], "id long, text string").withColumns({"term": F.lit("t"), "idf": F.lit(1)})
    cells = textmodel.weigh(model, new, "id", "text")
    ids, want = plain(TRAIN, NEW[:4])
    got = {k: {} for k in want}
    for r in cells.collect():
        assert ids[r.term] == r.term_id
        got[r.id][r.term_id] = (r.tf, round(r.tfidf, 9))
    assert got == want and got[11] == {}
    rows = {r.id: r for r in textmodel.sparse_rows(new, cells, "id", model.n_terms, "tfidf").collect()}
    assert rows.keys() == want.keys()
    for k, cells in want.items():
        assert (rows[k].size, rows[k].indices) == (3, sorted(cells)) and [round(v, 9) for v in rows[k]["values"]] == [cells[i][1] for i in sorted(cells)]


def test_no_plan_fits_again(spark, tmp_path):
    textmodel.fit(spark.createDataFrame(TRAIN, "id long, text string"), "id", "text").save(str(tmp_path / "m"))
    made = textmodel.weigh(textmodel.load(spark, str(tmp_path / "m")), spark.createDataFrame(NEW, "id long, text string"), "id", "text")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_repeated_keys_and_empty_tables(spark):
    model = textmodel.fit(spark.createDataFrame(TRAIN, "id long, text string"), "id", "text")
    twice = spark.createDataFrame(NEW, "id long, text string")
    cells = textmodel.weigh(model, twice, "id", "text")
    assert textmodel.sparse_rows(twice, cells, "id", 3).count() == 4  # rows of one key are one document
    empty = twice.limit(0)
    assert textmodel.weigh(model, empty, "id", "text").collect() == []
    none = textmodel.fit(empty, "id", "text")
    assert (none.n_docs, none.n_terms) == (0, 0)
    only = textmodel.sparse_rows(twice, textmodel.weigh(none, twice, "id", "text"), "id", none.n_terms).collect()
    assert {(r.size, tuple(r.indices)) for r in only} == {(0, ())}


def test_terms_are_counted_in_their_rows_and_repeated_keys_are_summed(spark):
    rows = [(1, "bb aa bb a AA"), (2, ""), (3, None), (4, "x"), (5, "one two"), (5, "two é_é two"), (None, "aa"), (None, "aa bb"), (6, "zz")]
    rows += [(7, "many aa aa")] * (features.JOINED_ROWS + 1)
    docs = spark.createDataFrame(rows, "id long, t string")
    want = Counter((k, w.lower()) for k, t in rows for w in re.findall(r"\w\w+", t or ""))
    assert {(r.id, r.term): r.tf for r in features.bag_of_words(docs, "id", "t").collect()} == want
    once = docs.where("id < 7 and id <> 5")
    made = features.bag_of_words(once, "id", "t")
    assert {(r.id, r.term): r.tf for r in made.collect()} == {c: n for c, n in want.items() if c[0] not in (5, 7, None)}
    # no task of a table of single keys holds more than a row's terms
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_tidy_words_are_runs_of_letters_and_hashes(spark):
    texts = ["@a hi #abcd efgh1ijkl", "", None, "abc", "éabcdé #### ab#cd", "a" * 5 + "\n" + "b" * 4 + "@x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    want = [None if t is None else [w for w in re.split("[^a-zA-Z#]+", t.replace("@a", "").replace("@x", "")) if len(w) > 3] for t in texts]
    assert [r.w for r in df.select(text.tidy_words(F.col("t")).alias("w")).collect()] == want


def test_cells_are_not_sorted_by_term(spark):
    docs = spark.createDataFrame(TRAIN + NEW[:4], "id long, text string")
    model = textmodel.fit(docs, "id", "text")
    for made in (features.tfidf(docs, features.bag_of_words(docs, "id", "text"), "id"), textmodel.weigh(model, docs, "id", "text")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert [line for line in plan.split("\n") if "Sort [" in line and "term" in line] == []
    weights = {(r.id, r.term): round(r.tfidf, 9) for r in textmodel.weigh(model, docs, "id", "text").collect()}
    assert {(r.id, r.term): round(r.tfidf, 9) for r in features.tfidf(docs, features.bag_of_words(docs, "id", "text"), "id").collect()} == weights
