"""Quality rules: counts with fixed bounds, and isolation forests on their rates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import textkernel as tk
from tarn.llm.common import fold, lean, sized, table

#: The statistics of the rules by what they describe; each family has a forest of its own. In one
#: forest of all five a text that is odd in one way is hidden by all that are odd in others.
FAMILIES = {"wording": ("symbol_rate", "char_rate"), "repetition": ("repeat_rate", "dup_line_rate", "log_words")}
RATES = [k for family in FAMILIES.values() for k in family]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Small subsamples, so that even frequent anomalies are few in each and do not hide one another.
TREES, SUBSAMPLE, DEPTH = 200, 64, 6
#: Rows that the subsamples are drawn from: as many as all trees take, so that they hardly share any.
POOL = TREES * SUBSAMPLE
#: Steps of a score.
STEPS = 1 << 16
#: What is stored of a text: the counts that are returned, and the lines, which a rate needs.
STORED = [*COUNTS, "n_lines"]
LEAST_WORDS, MOST_REPEATED = 50, 50
#: What a good document lost costs against a poor one kept, when a threshold is calibrated.
COST = 5.0
#: Rows of this CRC-32 remainder by 5 calibrate nothing: figures come from them.
FOLDS, HELD_FOLD = 5, 0


@dataclass
class Forest:
    """Complete trees as arrays (trees, nodes): the split rate, its bound, and a leaf's path length."""

    feature: np.ndarray
    bound: np.ndarray
    length: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = self.feature[t, node]
                down = 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > self.bound[t, node])
                node = np.where(f >= 0, down, node)
            total += self.length[t, node]
        return 2.0 ** (-total / max(len(self.feature), 1) / _expected(SUBSAMPLE)) if len(self.feature) else np.zeros(len(x))


def _expected(n: int) -> float:
    """The mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _rates(counts: dict) -> dict[str, np.ndarray]:
    words = np.maximum(counts["n_words"], 1)
    return {
        "symbol_rate": counts["n_symbols"] / words,
        "char_rate": counts["word_chars"] / words,
        "repeat_rate": counts["n_repeat_words"] / words,
        "dup_line_rate": counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1),
        "log_words": np.log1p(counts["n_words"]),
    }


def _failed(counts: dict) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def grow(x: np.ndarray, weight: np.ndarray, seed: int = 5) -> Forest:
    """Random splits of random subsamples of rows; an empty table gives a forest without trees.

    ``weight``: how many rows each one stands for. No label has a part in it.
    """
    share = weight / weight.sum() if len(x) else weight
    nodes = 2 ** (DEPTH + 1) - 1
    trees = TREES if len(x) else 0
    forest = Forest(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), 1.0)
    draw = np.random.Generator(np.random.PCG64(seed))
    for t in range(trees):
        stack = [(0, 0, x[draw.choice(len(x), min(SUBSAMPLE, len(x)), replace=False, p=share)])]
        while stack:
            node, depth, rows = stack.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth == DEPTH or len(rows) < 2 or not len(open_):
                forest.length[t, node] = depth + _expected(len(rows))
                continue
            f = int(draw.choice(open_))
            bound = float(draw.uniform(low[f], high[f]))
            forest.feature[t, node], forest.bound[t, node] = f, bound
            above = rows[:, f] > bound
            if above.all() or not above.any():
                forest.feature[t, node] = -1
                forest.length[t, node] = depth + _expected(len(rows))
                continue
            stack += [(2 * node + 1, depth + 1, rows[~above]), (2 * node + 2, depth + 1, rows[above])]
    return forest


def calibrated(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the least weighted cost of good rows above it (COST each) and poor rows up to it."""
    if not good.any() or good.all():
        return 1.0
    order = np.argsort(score, kind="stable")
    score, good, weight = score[order], good[order], weight[order]
    # a threshold after the k-th score: poor rows up to it are kept, good rows after it are lost
    kept_poor = np.concatenate([[0], np.cumsum(np.where(good, 0, weight))])
    kept_good = np.concatenate([[0], np.cumsum(np.where(good, weight, 0))])
    cost = kept_poor + COST * (kept_good[-1] - kept_good)
    cost[1:-1][score[1:] == score[:-1]] = np.inf  # equal scores are on one side
    edge = np.concatenate([[score[0] - 1e-6], score, [1.0]])
    k = int(np.argmin(cost))
    return float((edge[k] + edge[k + 1]) / 2)


def _told(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Scores in steps of 1 / STEPS, so that those of any number of rows are a bounded table of counts."""
    return np.rint(forest.scores(x) * STEPS) / STEPS


def _of_rows(counted: DataFrame, keep: list[str], fields: str, made: Callable[[dict[str, np.ndarray]], list]) -> DataFrame:
    """``keep`` columns of counted rows and the ``fields`` that ``made(counts)`` gives."""
    schema = T.StructType([counted.schema[k] for k in keep] + T.StructType.fromDDL(fields).fields)
    read = [*keep, *(k for k in STORED if k not in keep)]

    def run(batches):
        for batch in batches:
            counts = {k: batch.column(read.index(k)).to_numpy(zero_copy_only=False) for k in STORED}
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(x) for x in made(counts)], names=schema.names)

    return counted.select(*(f"`{c}`" for c in read)).mapInArrow(lean(run), schema)


def fit(counted: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> dict[str, Forest]:
    """A forest of each family's rates, its threshold calibrated on all labelled rows.

    ``counted``: ids and STORED counts. Rows count that have a label, are outside the held fold and
    pass the counts' bounds; repeated ones count as often as they occur, and of an id's labels the
    largest. A tree's subsample is drawn from POOL of these rows, by a hash of the id, or from all
    if they are fewer; trees do not see the labels. Every row is scored for the thresholds, which
    without rows of both classes are 1 and reject nothing.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(id_col, FOLDS) != HELD_FOLD)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    met = counted.join(sized(known), id_col)
    rated = table(_of_rows(met, [id_col, "label"], "failed boolean, " + ", ".join(f"{k} double" for k in RATES), lambda counts: [_failed(counts), *(np.asarray(x, dtype=np.float64) for x in _rates(counts).values())]).where("not failed"))
    drawn = rated.orderBy(F.xxhash64(id_col), id_col, *RATES).limit(POOL).toPandas()
    forests = {name: grow(drawn[list(columns)].to_numpy().astype(float), np.ones(len(drawn))) for name, columns in FAMILIES.items()}
    steps = T.StructType.fromDDL("label int, " + ", ".join(f"{name} int" for name in FAMILIES))

    def scored(batches):
        for batch in batches:
            at = {k: batch.column(1 + i).to_numpy(zero_copy_only=False) for i, k in enumerate(RATES)}
            told = [_told(forests[name], np.stack([at[k] for k in columns], axis=1)) * STEPS for name, columns in FAMILIES.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int32)) for x in told)], names=steps.names)

    scores = rated.select("label", *RATES).mapInArrow(lean(scored), steps)
    each = scores.select("label", F.explode(F.array(*(F.struct(F.lit(name).alias("family"), F.col(name).alias("step")) for name in FAMILIES))).alias("at"))
    counts = each.groupBy("at.family", "at.step", "label").agg(F.count("*").alias("n")).toPandas()
    for name, forest in forests.items():
        mine = counts[counts["family"] == name].sort_values(["step", "label"])
        forest.threshold = calibrated(mine["step"].to_numpy() / STEPS, mine["label"].to_numpy() == 1, mine["n"].to_numpy().astype(float))
    return forests


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the five counts, base_failed, the families' anomaly scores and kept for every row's whole text.

    base_failed: under LEAST_WORDS words, or more than MOST_REPEATED percent of them in windows
    of three words that repeat. kept: not base_failed and no forest's score is above its
    threshold; equal scores have equal verdicts. Null and empty texts have no words and so fail;
    very long ones count whole. Null ids and repeated rows keep their rows; other columns are
    ignored. No documents give no rows; without labels of both classes only the bounds decide.
    Texts are read once: their counts are written, and all else works on these.
    """

    def count(buf, offsets):
        counts = tk.rule_counts(tk.split(buf, offsets))
        return [np.asarray(counts[k], dtype=np.int64) for k in STORED]

    texts = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    counted = table(tk.over_texts(texts, [id_col], text_col, ", ".join(f"{k} long" for k in STORED), count))
    forests = fit(counted, labels, id_col=id_col)

    def made(counts):
        failed, rates = _failed(counts), _rates(counts)
        scores = {name: _told(forests[name], np.stack([rates[k] for k in columns], axis=1)) for name, columns in FAMILIES.items()}
        odd = np.any([scores[name] > forests[name].threshold for name in FAMILIES], axis=0)
        return [failed, *scores.values(), ~failed & ~odd]

    fields = "base_failed boolean, " + ", ".join(f"{name}_anomaly double" for name in FAMILIES) + ", kept boolean"
    return _of_rows(counted, [id_col, *COUNTS], fields, made)
