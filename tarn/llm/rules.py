"""Quality by a sparse ensemble of conjunctive rules over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import textkernel as tk
from tarn.llm.common import fold
from tarn.llm.labelled import ROWS_PER_CLASS, sample, texts_of

#: The statistics that rules may use, in the order of ``textkernel.text_shape``.
STATISTICS = ["log_words", "mean_word", "symbol_rate", "upper_rate", "digit_rate", "punct_rate", "repeat_rate", "dup_line_rate", "distinct_rate", "words_per_line", "long_word_rate"]
TREES, DEPTH, CUTS, STEP = 40, 3, 32, 0.3
PENALTY, ROUNDS = 5e-4, 400
THRESHOLD = 0.3

#: A condition: the statistic's place, above (or not), the bound.
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


@dataclass
class Ensemble:
    base: float
    rules: list[tuple[Rule, float]]

    def column(self, prefix: str = "") -> Column:
        """The score as a Spark expression over the statistics' columns."""
        total = F.lit(float(self.base))
        for rule, weight in self.rules:
            total = total + F.expr(f"CASE WHEN {' AND '.join(f'`{prefix}{STATISTICS[k]}` {'>' if above else '<='} {bound!r}D' for k, above, bound in rule)} THEN {weight!r}D ELSE 0D END")
        return 1 / (1 + F.exp(-total))


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``keep`` columns and all STATISTICS of each row's whole text; a null text is an empty one."""

    def made(buf, offsets):
        shape = tk.text_shape(tk.split(buf, offsets))
        return [np.asarray(shape[k], dtype=np.float64) for k in STATISTICS]

    return tk.over_texts(docs, keep, text_col, ", ".join(f"`{prefix}{k}` double" for k in STATISTICS), made)


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Bounds between distinct values of each statistic, at its quantiles."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1), method="lower"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def _grown(x, target, rows, cuts, picks, rule: Rule, found: list[Rule], depth: int) -> np.ndarray:
    """A regression tree's predictions for all rows; every path from the root is a rule."""
    inside = np.ones(len(x), dtype=bool)
    for k, above, bound in rule:
        inside &= (x[:, k] > bound) == above
    here = inside & (rows > 0)
    weight = rows[here].sum()
    mean = float((rows[here] * target[here]).sum() / weight) if weight else 0.0
    out = np.where(inside, mean, 0.0)
    if depth == DEPTH or here.sum() < 40:
        return out
    best = (1e-9, None)
    for k in picks:
        if not len(cuts[k]):
            continue
        slot = np.searchsorted(cuts[k], x[here, k], side="left")
        n = np.cumsum(np.bincount(slot, rows[here], minlength=len(cuts[k]) + 1))
        s = np.cumsum(np.bincount(slot, rows[here] * target[here], minlength=len(cuts[k]) + 1))
        seen = np.cumsum(np.bincount(slot, minlength=len(cuts[k]) + 1))
        low, high = n[:-1], n[-1] - n[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s[:-1] ** 2 / low + (s[-1] - s[:-1]) ** 2 / high - s[-1] ** 2 / n[-1]
        gain[(seen[:-1] < 10) | (seen[-1] - seen[:-1] < 10) | ~np.isfinite(gain)] = -1
        if gain.max() > best[0]:
            best = (float(gain.max()), (k, float(cuts[k][int(gain.argmax())])))
    if best[1] is None:
        return out
    k, bound = best[1]
    for above in (False, True):
        path = (*rule, (k, above, bound))
        found.append(path)
        out = np.where((x[:, k] > bound) == above, np.where(inside, _grown(x, target, rows, cuts, picks, path, found, depth + 1), out), out)
    return out


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for k, above, bound in rule:
        held &= (x[:, k] > bound) == above
    return held


def _lasso(z: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """L1-penalised logistic weights by accelerated proximal gradient steps; the base is free."""
    rows = rows / rows.sum()
    full = np.hstack([np.ones((len(z), 1)), z])
    step = 4 / max(np.linalg.norm((full * rows[:, None]).T @ full, 2), 1e-9)
    w = ahead = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(full @ ahead, -30, 30)))
        new = ahead - step * (full.T @ (rows * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (before - 1) / t * (new - w)
    return float(w[0]), w[1:]


def grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, seed: int = 11) -> Ensemble:
    """Boosted trees give rules, the lasso their weights; one class only gives its constant score."""
    if not len(y) or y.min() == y.max():
        return Ensemble(4.0 if len(y) and y[0] == 1 else 0.0, [])
    draw = np.random.Generator(np.random.PCG64(seed))
    share = float((rows * y).sum() / rows.sum())
    f = np.full(len(y), np.log(share / (1 - share)))
    cuts, found = _cuts(x), []
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-f))
        part = rows * (draw.random(len(y)) < 0.6)
        picks = draw.choice(x.shape[1], max(1, (2 * x.shape[1]) // 3), replace=False)
        f = f + STEP * 4 * _grown(x, residual, part, cuts, picks, (), found, 0)
    kept: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in found:
        held = _holds(rule, x)
        if 0 < held.sum() < len(x):
            kept.setdefault(np.packbits(held).tobytes(), (rule, held))
    z = np.stack([h for _, h in kept.values()], axis=1).astype(np.float64) if kept else np.zeros((len(y), 0))
    base, weights = _lasso(z, y, rows)
    return Ensemble(base, [(rule, float(w)) for (rule, _), w in zip(kept.values(), weights, strict=True) if w])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS_PER_CLASS) -> Ensemble:
    """An ensemble of the labelled rows whose CRC-32 fold is not 0, at most ``rows`` of a class."""
    chosen = sample(labels, label, fold(id_col, 5) != 0, id_col, rows)
    held = statistics(texts_of(docs, chosen, id_col, text_col), [id_col, "label", "weight"], "text").orderBy(id_col).toPandas()
    return grow(held[STATISTICS].to_numpy(), held["label"].to_numpy().astype(float), held["weight"].to_numpy())


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics for every row of ``docs``.

    Null and empty texts have statistics of 0 and the score of these; very long ones count whole.
    Repeated rows each have a row, null ids count as held out; no documents give no rows. Labels
    of good rows only give a constant high score, of poor ones only or none at all 0.5. Other
    columns are ignored.
    """
    held = statistics(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"], "text")
    scored = held.withColumn("score", fit(docs, labels).column())
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted to be of quality.

    Nulls, long texts and missing labels are as in ``quality``; repeated rows stand or fall
    together. Columns of ``docs`` may have any names, those of the statistics too.
    """
    prefix = "stat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    held = statistics(docs, docs.columns, "text", prefix)
    return held.where(fit(docs, labels).column(prefix) >= threshold).select(*(f"`{c}`" for c in docs.columns))
