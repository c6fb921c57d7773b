import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import spelling
from tarn.llm.fmindex import Index

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, shortest=6, rarest=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += len(run) >= shortest
    return forms({w: n for w, n in counts.items() if n >= rarest})


def forms(words):
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = (n, len(near), form[w], words[best] if form[w] else None)
    for w in words:
        top = w
        while form[top]:
            top = form[top]
        out[w] += (top,)
    return out


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("alphabet", ["ab", "abcdé"])
def test_index_finds_all_pairs_at_one_edit(alphabet):
    draw = random.Random(len(alphabet))
    words = sorted({"".join(draw.choice(alphabet) for _ in range(draw.randint(2, 7))) for _ in range(150)})
    letters = sorted(set("".join(words)))
    coded = [np.array([letters.index(c) + 1 for c in w]) for w in words]
    index, got = Index(coded, len(letters) + 1), set()
    for n in set(map(len, words)):
        of = [k for k, w in enumerate(words) if len(w) == n]
        queries = np.stack([coded[k] for k in of])
        for pairs in (index.one_error(queries, n // 2), index.one_error(queries[:, ::-1], n - n // 2, True)):
            assert len(pairs) == len(set(map(tuple, pairs.tolist())))
            got |= {(words[of[q]], words[w]) for q, w in pairs.tolist()}
    assert got == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


@pytest.mark.parametrize("block", [8192, 40, 5])
def test_pairs_of_any_block_size(spark, block):
    draw = random.Random(4)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(300)}
    words |= {"same" + "".join(draw.choice("abcdef") for _ in range(3)) for _ in range(150)}  # one hot half
    given = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = [(r.word, r.near) for r in spelling.near_words(given, block).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_forms_follow_to_the_last(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdegh": 125, "abcdegi": 125, "zbcdegh": 800, "colour": 7, "color": 500, "colours": 34, "êtreas": 6, "etreas": 30, "lonely": 9}
    given = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.forms(given)) == forms(counts)
    assert found(spelling.forms(given))["abcdef"] == (5, 1, "abcdeg", 25, "zbcdegh")


def test_documents_equal_a_plain_version(spark):
    draw = random.Random(9)
    stems = ["".join(draw.choice("abcdeéßØ×÷ÿÉ") for _ in range(draw.randint(5, 8))) for _ in range(12)] + ["Straße", "ABCDEFG", "ÀÉÎÕÜÝ"]
    texts = [" ".join(draw.choice(stems) + draw.choice(["", "", "", "s", "x", "中", "1"]) for _ in range(150)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (90, None), (91, ""), (92, "hotword " * 20_000), (93, "x" * 100_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("w"), "n": F.lit(1), "run": F.lit("r")})
    got = found(spelling.variants(docs))
    assert got == plain(rows)
    assert any(v[2] for v in got.values())


def test_empty_tables_and_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], SCHEMA)).collect() == []
