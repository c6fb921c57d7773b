import re

from tarn.llm import licenses
from tarn.llm.templates import NOTICES

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words(text):
    return [w.lower() for w in WORD.findall(text or "")]


def best(template, doc):
    """Matched words of the best local alignment, without fingerprints or a band."""
    above = [(0, 0)] * (len(doc) + 1)
    top = (0, 0)
    for t in template:
        row = [(0, 0)]
        for j, d in enumerate(doc):
            s, m = above[j]
            cell = (s + 2, m + 1) if t == d else (s - 1, m)
            for o in (above[j + 1], row[-1]):
                if o[0] - 1 > cell[0]:
                    cell = (o[0] - 1, o[1])
            row.append(cell if cell[0] > 0 else (0, 0))
            if row[-1][0] > top[0]:
                top = row[-1]
        above = row
    return top[1]


def test_matches_full_alignment(spark):
    mit = NOTICES["MIT", "text"]
    texts = [
        "Some text. Released under the MIT License.",
        "released   UNDER the mit license, and more",
        "Released under the license of MIT.",
        "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
        mit,
        "Début. " + mit.replace("without restriction", "with no restriction at all").replace("NONINFRINGEMENT", "") + " fin",
        " ".join(mit.split()[:60]),
        NOTICES["Apache-2.0", "header"],
        "nothing of the kind is here " * 50,
        "This work is licensed under the GNU General Public License, version 3. " * 30,
    ]
    rows = list(enumerate(texts))
    got = licenses.scan(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, matched string")).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r)
        text = texts[r["doc_id"]]
        assert words(text[r["char_start"] : r["char_end"]]) == words(text)[r["word_start"] : r["word_end"]]
    for i, text in rows:
        full = {k: best(words(t), words(text)) for k, t in NOTICES.items()}
        passing = {k for k, m in full.items() if 100 * m >= licenses.COVERAGE * len(words(NOTICES[k]))}
        reported = {(r["license_id"], r["template"]) for r in found.get(i, [])}
        assert reported <= passing and bool(reported) == bool(passing)
        assert all(r["matched"] == full[r["license_id"], r["template"]] for r in found.get(i, []))
    assert len(found[9]) == 30 and [r["license_id"] for r in found[3]] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert {(r["license_id"], r["template"]) for r in found[7]} == {("Apache-2.0", "header")}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "MIT"), (None, "Released under the MIT License."), (4, "a " * 300_000 + "Released under the MIT License."), (4, "Released under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["word_start"]) for r in got) == [(0, 0), (4, 0), (4, 300_000)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[(r["license_id"], r["template"], r["matched"], r["word_start"]) for r in sorted(rows, key=lambda r: r["word_start"]) if r["doc_id"] == i] for i in range(len(texts))]


def test_short_notices_on_following_lines_have_a_row_each(spark):
    notices = [(k, t) for k, t in NOTICES.items() if len(words(t)) <= 8]
    assert len(notices) == 3
    for (k, t), got in zip(notices, found(spark, [f"{t}\n" * 40 for _, t in notices]), strict=True):
        assert got == [(*k, len(words(t)), i * len(words(t))) for i in range(40)]


def test_coverage_alone_decides(spark):
    texts = []
    for text in NOTICES.values():
        w = text.split()
        if len(w) <= 12:
            texts += [" ".join(["see", *w[:i], "other", *w[i + 1 :], "here"]) for i in range(len(w))]
            texts += [" ".join(w[:i] + w[i + 1 :]) for i in range(len(w))] + [" x ".join(w), " ".join(w[::-1])]
    texts += ["Released under an MIT License", " ".join(w if i % 6 else "other" for i, w in enumerate(NOTICES["ISC", "text"].split()))]
    for text, got in zip(texts, found(spark, texts), strict=True):
        full = {k: best(words(t), words(text)) for k, t in NOTICES.items()}
        passing = {k for k, m in full.items() if 100 * m >= licenses.COVERAGE * len(words(NOTICES[k]))}
        assert {r[:2] for r in got} <= passing and bool(got) == bool(passing), text
        assert all(r[2] == full[r[:2]] for r in got)


def test_every_occurrence_has_a_row_whatever_the_template(spark):
    """Ten of each template, one after another: as many rows, with whole coverage, each in its place."""
    for (k, t), got in zip(NOTICES.items(), found(spark, [f"{t} and so on. " * 10 for t in NOTICES.values()]), strict=True):
        n = len(words(t))
        assert got == [(*k, n, i * (n + 3)) for i in range(10)]


def test_licences_that_differ_in_a_word_are_told_apart(spark):
    names = [("GPL-2.0", "header"), ("GPL-3.0", "header"), ("LGPL-2.1", "header"), ("AGPL-3.0", "header"), ("BSD-2-Clause", "text"), ("BSD-3-Clause", "text"), ("Unlicense", "text"), ("Zlib", "text")]
    got = found(spark, [f"/* Copyright 2020 A. Person\n * {NOTICES[k]}\n */ int main() {{}}" for k in names])
    assert [[r[:2] for r in rows] for rows in got] == [[k] for k in names]


def test_winnowing_keeps_one_of_every_window():
    import numpy as np

    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 40):
        grams = draw.integers(0, 2**60, n, dtype=np.uint64)
        at = set(licenses.winnowed(grams, 3).tolist())
        assert all(at & {i, i + 1, i + 2} for i in range(n - 2)) and (not n or at) and all(0 <= i < n for i in at)
        assert all(i - 2 + int(grams[i - 2 : i + 1].argmin()) in at for i in range(2, n))


def test_long_templates_with_scattered_changes_are_found(spark):
    """A fifth of the words changed or left out and as many put in, spread evenly."""
    texts, keys = [], []
    for k, t in NOTICES.items():
        w = words(t)
        if len(w) >= licenses.SHORT:
            changed = [x if i % 6 else "other" for i, x in enumerate(w)]
            texts += [" ".join(changed), " ".join(x for i, x in enumerate(w) if i % 6), " ".join(y for i, x in enumerate(changed) for y in ((x, "more") if i % 6 == 3 and i % 4 else (x,)))]
            keys += [k] * 3
    for k, text, got in zip(keys, texts, found(spark, texts), strict=True):
        full = best(words(NOTICES[k]), words(text))
        assert 100 * full >= licenses.COVERAGE * len(words(NOTICES[k])) and got and all(r[2] == best(words(NOTICES[r[:2]]), words(text)) for r in got), k


def test_time_is_linear_in_a_text():
    import time

    import numpy as np
    import pyarrow as pa

    from tarn.llm import textkernel as tk

    lib, took = licenses.library(), []
    for lines in (500, 4000):
        ((_, _, buf, offsets),) = tk.slices(pa.array(["Licensed under CC BY-NC 4.0. The end of it.\n" * lines]))
        w, hashes = licenses._split(buf, offsets)
        ids = np.searchsorted(lib.keys, hashes)
        ids = np.where(lib.keys[np.minimum(ids, len(lib.keys) - 1)] == hashes, ids, -1)
        began = time.time()
        assert len(licenses._matches(lib, hashes, ids, *licenses.hits(lib, hashes, w.doc))) == lines
        took.append(time.time() - began)
    assert took[1] < 24 * took[0]


def test_spans_are_code_points_and_take_linear_time(spark):
    import time

    line = "é中😀 Licensed under CC BY-NC 4.0. The end.\n"
    took = []
    for lines in (2000, 16_000):
        docs = spark.createDataFrame([(1, line * lines)], "doc_id long, text string")
        began = time.time()
        rows = licenses.scan(docs).select("char_start", "char_end").collect()
        took.append(time.time() - began)
        assert len(rows) == lines
        spans = {(r.char_start % len(line), r.char_end % len(line)) for r in rows}
        assert len(spans) == 1 and line[slice(*spans.pop())].startswith("Licensed under")
        assert sorted(r.char_start // len(line) for r in rows) == list(range(lines))
    assert took[1] < 24 * took[0]


def test_a_match_that_shares_words_with_a_larger_one_is_kept_if_its_own_are_enough(spark):
    one = [f"one{i}" for i in range(30)] + ["shared"]
    two = ["shared"] + [f"two{i}" for i in range(20)]
    lib = licenses.library({("one", "text"): " ".join(one), ("two", "text"): " ".join(two), ("part", "text"): " ".join(one[5:25])})
    texts = [" ".join(one + two[1:]), " ".join([*one[:15], *two, *one[15:]]), " ".join(one), " ".join([*one[5:25], "x", *one[5:25]])]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lib).collect()
    got = {i: sorted((r["word_start"], r["word_end"], r["license_id"], r["matched"]) for r in rows if r["doc_id"] == i) for i in range(4)}
    # a template inside a larger match has no words of its own
    assert got[0] == [(0, 31, "one", 31), (31, 51, "two", 20)]
    assert got[2] == [(0, 31, "one", 31)]
    assert got[3] == [(0, 20, "part", 20), (21, 41, "part", 20)]
    # the words of "one" on each side of "two" are not enough alone, and "two" is wider than the band
    assert got[1] == [(15, 36, "two", 21)]
