"""Variants of a word's spelling: words at one edit, found by a bidirectional FM-index, and their forms.

One error lies in one half of a word, so its near words have the other half as it is, at their start
or at their end. Words are dealt by such halves: each is asked for by its own two halves, and is found
by every half that a word of nearly its length may ask for. A unit of some thousand words becomes a
delimited text with an index of it (``fmindex``), in which the asked half is matched exactly and the
pattern is then extended over the other half with one error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import lean, sized, table
from tarn.llm.fmindex import Index
from tarn.llm.sql import crc32
from tarn.llm.units import runs, together

#: Words of an index; its occurrence table takes some 30 MB for each direction.
BLOCK = 8192
#: Code points and occurrences of a word at least; a form occurs so many times as often as its variant.
SHORTEST, RAREST, RATIO = 6, 5, 5
#: Of so many runs, told by a hash of the document and the run, one loses a letter.
TYPO = 199
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, rarest: int = RAREST, typo: int = TYPO) -> DataFrame:
    """(word, n): the words of ``shortest`` code points and ``rarest`` occurrences or more.

    Words are runs of Latin letters with A-Z in lower case. One run in about ``typo`` loses a letter,
    by the CRC-32 of ``<key>:<run>``, a null key being empty there. Null texts have no words; counts
    are pre-aggregated, so frequent words and long texts cost no task more.
    """
    lowered = F.translate(F.col(text), UPPER, UPPER.lower())
    found = F.filter(F.regexp_extract_all(lowered, F.lit(f"({RUN})"), F.lit(1)), lambda w: F.length(w) >= shortest)
    # explode() would have Spark filter on the size of the runs first, and so extract them twice
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode_outer(found).alias("run")).where("run is not null")
    hashed = each.withColumn("h", F.crc32(F.encode(F.concat("key", F.lit(":"), "run"), "UTF-8")))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % typo == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def _half(length: Column, side: int) -> Column:
    """The letters of a word's first (0) or last (1) half."""
    return F.shiftright(length + side, 1)


def _dealt(words: DataFrame, block: int) -> DataFrame:
    """(side, unit, i, j, role, word, n) rows: role 1 to be found, 2 to be asked for, 3 both.

    Halves with up to ``block`` words share units by their hash. A half with more has units of its
    own: block i of its words is indexed and block j asked, for all i and j.
    """
    length = F.length("word")
    count, least = words.agg(F.count("*"), F.min(length)).first()
    shorter = F.when(length > (least or 0), length - 1).otherwise(length)  # no shorter word asks for the shortest ones

    def halves(side: int) -> Column:
        sizes = F.array_distinct(F.array(*(_half(n, side) for n in (shorter, length, length + 1))))
        cut = F.left if side == 0 else F.right
        return F.transform(sizes, lambda k: F.struct(F.lit(side).alias("side"), cut(F.col("word"), k).alias("half"), (k == _half(length, side)).alias("asks")))

    rows = words.select("word", "n", F.explode(F.concat(halves(0), halves(1))).alias("k")).select("word", "n", "k.side", F.xxhash64("k.side", "k.half").alias("half"), "k.asks")
    shared = max(1, math.ceil(count * 4 / block))
    hot = rows.groupBy(F.col("half").alias("hot")).agg(F.count("*").alias("size")).where(F.col("size") > block).select("hot", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    met = rows.join(sized(table(hot)), F.col("half") == F.col("hot"), "left").drop("hot")
    role = F.when(F.col("asks"), 3).otherwise(1)
    cold = met.where("blocks is null").select("side", F.pmod("half", F.lit(shared)).alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), role.alias("role"), "word", "n")
    split = met.where("blocks is not null").withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = split.select("side", F.col("half").alias("unit"), F.col("own").alias("i"), F.col("other").alias("j"), F.lit(1).alias("role"), "word", "n")
    asked = split.where("asks").select("side", F.col("half").alias("unit"), F.col("other").alias("i"), F.col("own").alias("j"), F.lit(2).alias("role"), "word", "n")
    return cold.unionByName(found).unionByName(asked)


def _searched(batches):
    for unit in runs(batches, 4):
        side = unit.column("side")[0].as_py()
        role, counts = unit.column("role").to_numpy(), unit.column("n").to_numpy()
        words = unit.column("word").to_pylist()
        texts = {w: n for w, n, r in zip(words, counts.tolist(), role.tolist(), strict=True) if r & 1}
        asked = list(dict.fromkeys(w for w, r in zip(words, role.tolist(), strict=True) if r & 2))
        if not texts or not asked:
            continue
        listed = list(texts)
        letters = sorted(set().union(*listed, *asked))
        code = {c: k + 1 for k, c in enumerate(letters)}
        coded = lambda w: np.fromiter(map(code.__getitem__, w), np.int64, len(w))
        index = Index([coded(w) for w in listed], len(letters) + 1)
        for length in sorted(set(map(len, asked))):
            of = [w for w in asked if len(w) == length]
            queries = np.stack([coded(w) for w in of])
            exact = (length + side) >> 1
            pairs = index.one_error(queries[:, ::-1] if side else queries, exact, bool(side))
            met = [(of[q], listed[w]) for q, w in pairs.tolist()]
            if side:  # pairs that have the first half in common were found by it
                met = [(q, w) for q, w in met if q[: length >> 1] != w[: length >> 1]]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in met], pa.string()), pa.array([w for _, w in met], pa.string()), pa.array([texts[w] for _, w in met], pa.int64())], names=["word", "near", "near_n"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): all pairs of different words at one inserted, deleted or replaced code point, both ways.

    ``words``: distinct (word, n) of two code points or more, see ``vocabulary``. No pair is lost
    or found twice, however many words share a half; a half with g words makes g * g / block rows.
    """
    dealt = together(_dealt(words, block), ["side", "unit", "i", "j"])
    return dealt.mapInArrow(lean(_searched), "word string, near string, near_n long")


def forms(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of each of ``words``.

    The form is the near word of the largest count, the first in code-point order of equals, if it
    occurs ``ratio`` times as often as the word; the root is where forms lead to. No words, no rows.
    """
    near = near_words(words, block).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    much = -F.col("best.n") >= ratio * F.col("n")
    met = words.join(near, F.col("of") == F.col("word"), "left")
    found = table(met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, F.col("best.word")).alias("form"), F.when(much, -F.col("best.n")).alias("form_n")))
    steps = table(found.where("form is not null").select("word", F.col("form").alias("top")))
    while True:  # each round doubles the forms that are followed; counts grow with every form, so there are few
        beyond = steps.select(F.col("word").alias("top_"), F.col("top").alias("next"))
        now = table(steps.join(beyond, F.col("top") == F.col("top_"), "left").select("word", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")))
        steps = now.select("word", "top")
        if not now.where("moved").limit(1).count():
            break
    roots = steps.select(F.col("word").alias("of"), "top")
    return found.join(roots, F.col("of") == F.col("word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("top", "word").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """Words of documents with their near words, forms and roots, see ``vocabulary`` and ``forms``."""
    return forms(table(vocabulary(docs)))


_HOLES = "SELECT word, unnest(range(length(word))) AS i FROM v"
SQL = f"""WITH RECURSIVE e AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT doc, run, count(*) AS c FROM e WHERE length(run) >= {SHORTEST} GROUP BY ALL),
h AS (SELECT *, {crc32("doc || ':' || run")} AS h FROM g),
w AS (SELECT CASE WHEN h % {TYPO} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(c) >= {RAREST}),
s AS (SELECT word, left(word, i) || '_' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS less FROM ({_HOLES})),
p AS (SELECT a.word, b.word AS near FROM s a JOIN s b ON a.hole = b.hole AND a.word <> b.word
UNION SELECT s.word, v.word FROM s JOIN v ON v.word = s.less UNION SELECT v.word, s.word FROM s JOIN v ON v.word = s.less),
k AS (SELECT p.word, near, v.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near) AS place, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN v ON v.word = near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM v LEFT JOIN k ON k.word = v.word AND place = 1),
r AS (SELECT word, word AS top FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = top WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.top AS root FROM f JOIN r ON r.word = f.word JOIN f z ON z.word = r.top WHERE z.form IS NULL"""
