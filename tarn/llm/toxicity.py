"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import textkernel as tk
from tarn.llm.common import fold, lean, table
from tarn.llm.labelled import ROWS_PER_CLASS, sample, texts_of

#: What is taken off each count and given to the backoff.
DISCOUNT = 0.9
#: The part of a toxic text's words that the toxic model writes; the ordinary one writes the rest.
TOXIC_SHARE = 0.003
#: What a text's log-likelihood difference is divided by: its words to this power.
LENGTH_POWER, SCALE = 0.5, 100.0
THRESHOLD = 0.5
#: The history of a text's first word.
START = np.uint64(1)


@dataclass
class Model:
    """Log-likelihood ratios, toxic against ordinary, of everything that the models know.

    ``pairs``/``pair_gain``: words after the word before them. ``words``/``word_gain``: words
    without a history; ``unseen`` is that of a word that neither class holds. ``histories``/
    ``history_gain``: of the backoff weights of a word before an unknown pair.
    """

    pairs: np.ndarray
    pair_gain: np.ndarray
    words: np.ndarray
    word_gain: np.ndarray
    histories: np.ndarray
    history_gain: np.ndarray
    unseen: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0]))


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    """Words of letters, digits and non-ASCII bytes in lower case: hashes and those of the words before."""
    w = tk.split(buf, offsets, tk.BREAK)
    word = tk.hash_spans(buf, w.starts, w.ends, folded=True)
    before = np.roll(word, 1)
    before[np.flatnonzero(np.diff(w.doc, prepend=-1))] = START
    return w, word, before


def _counts(texts: DataFrame) -> DataFrame:
    """(history, word, pair, n0, n1) over the sample's texts, pre-aggregated per slice; pair is a hash of both words."""

    def run(batches):
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in tk.slices(batch.column(1)):
                w, word, before = _tokens(buf, offsets)
                toxic = label[lo:hi][w.doc] == 1
                keys, first, back = np.unique(tk.pair_hash(before, word), return_index=True, return_inverse=True)
                n1 = np.bincount(back[toxic], minlength=len(keys))
                n0 = np.bincount(back, minlength=len(keys)) - n1
                columns = (before[first].view(np.int64), word[first].view(np.int64), keys.view(np.int64), n0.astype(np.int64), n1.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["history", "word", "pair", "n0", "n1"])

    parts = texts.select("label", "text").mapInArrow(lean(run), "history long, word long, pair long, n0 long, n1 long")
    return parts.groupBy("history", "word", "pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (long) in the order of their unsigned values, and their gains, in single precision."""
    held = rows.select(rows.columns[0], F.col("gain").cast("float")).toArrow()
    key, gain = held.column(0).to_numpy().view(np.uint64), held.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], gain[order]


def estimate(counts: DataFrame) -> Model:
    """Interpolated Kneser-Ney of both classes from the counts of pairs of words.

    With D the discount and c a class, a word w after h has
    p(w | h, c) = max(n(c, h, w) - D, 0) / n(c, h) + D * kinds(c, h) / n(c, h) * p(w | c), and
    p(w | c) = max(N(c, w) - D, 0) / N(c) + D * kinds(c) / N(c) * p(w),
    where N(c, w) are continuation counts: in how many histories the class has w. The backoff
    p(w) is shared: it counts in how many classes w occurs, less D, which is left for words that
    no class has. So what one class has often and the other never is told apart clearly, and an
    expression that is rare in both is mostly its shared backoff, which cancels out.
    """
    counts, d = table(counts), F.lit(DISCOUNT)
    both = {c: F.col(f"n{c}") for c in (0, 1)}
    words = counts.groupBy("word").agg(*(F.count_if(n > 0).alias(f"after{c}") for c, n in both.items()))
    whole = words.agg(*(f(f"after{c}").alias(f"{name}{c}") for c in both for name, f in (("total", F.sum), ("kinds", lambda x: F.count_if(F.col(x) > 0))))).first()
    if not whole["total0"] or not whole["total1"]:
        none, zero = np.zeros(0, np.uint64), np.zeros(0)
        return Model(none, zero, none, zero, none, zero)
    left = {c: DISCOUNT * whole[f"kinds{c}"] / whole[f"total{c}"] for c in both}
    shared = ((F.col("after0") > 0).cast("int") + (F.col("after1") > 0).cast("int") - d) / (whole["kinds0"] + whole["kinds1"])
    by_word = {c: F.greatest(F.col(f"after{c}") - d, F.lit(0.0)) / whole[f"total{c}"] + left[c] * shared for c in both}
    words = words.select("word", *(p.alias(f"p{c}") for c, p in by_word.items()), F.ln(by_word[1] / by_word[0]).alias("gain"))
    histories = counts.groupBy("history").agg(*(f.alias(f"{name}{c}") for c, n in both.items() for name, f in (("total", F.sum(n)), ("kinds", F.count_if(n > 0)))))
    kept = {c: F.when(F.col(f"total{c}") > 0, d * F.col(f"kinds{c}") / F.col(f"total{c}")).otherwise(1.0) for c in both}
    histories = histories.select("history", "total0", "total1", *(k.alias(f"kept{c}") for c, k in kept.items()), F.ln(kept[1] / kept[0]).alias("gain"))
    joined = counts.join(words.drop("gain"), "word").join(histories.drop("gain"), "history")
    by_pair = {c: F.greatest(n - d, F.lit(0.0)) / F.greatest(F.col(f"total{c}"), F.lit(1)) + F.col(f"kept{c}") * F.col(f"p{c}") for c, n in both.items()}
    pairs = joined.select("pair", F.ln(by_pair[1] / by_pair[0]).alias("gain"))
    return Model(*_sorted(pairs), *_sorted(words.select("word", "gain")), *_sorted(histories.select("history", "gain")), float(np.log(left[1] / left[0])))


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(missing, wanted.shape).astype(float)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at].astype(float), missing)


def gains(model: Model, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p(w | toxic) / p(w | ordinary) of words alone and of words after those before them."""
    kinds, back = np.unique(word, return_inverse=True)
    alone = _look(model.words, model.word_gain, kinds, model.unseen)[back]
    backoff = _look(model.histories, model.history_gain, before, 0.0) + alone
    return alone, _look(model.pairs, model.pair_gain, tk.pair_hash(before, word), backoff)


def differences(model: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood differences of texts by words alone and by pairs of words, and their words.

    Most words of a toxic text are ordinary: each is the toxic model's with probability
    TOXIC_SHARE, so that a word can speak against toxicity only a little.
    """
    w, word, before = _tokens(buf, offsets)
    mixed = (np.log1p(TOXIC_SHARE * np.expm1(np.minimum(g, 30))) for g in gains(model, word, before))
    alone, paired = (tk.per_text(g, w.bounds) for g in mixed)
    return alone, paired, w.counts


def _features(alone: np.ndarray, paired: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The length-normalised difference by words, what pairs add to it, both on a log scale, and the length."""
    root = np.maximum(words, 1) ** LENGTH_POWER

    def scaled(x):
        return np.sign(x) * np.log1p(SCALE * np.abs(x) / root)

    return np.stack([np.ones(len(words)), scaled(alone), scaled(paired - alone), np.log1p(words)], axis=1)


def _calibrated(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic weights of weighted rows by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.array([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (rows * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS_PER_CLASS) -> Model:
    """A model of the labelled rows whose CRC-32 fold is not 0.

    Folds 1 to 3 give the counts and fold 4 the weights of the length-normalised differences, so
    weights are not fitted to texts that the counts hold. At most ``rows`` ids of each class, each
    with one text, so what reaches the driver, a number for each pair, is of 2 * ``rows`` texts at most.
    Without labels of both classes every score is 0.
    """
    chosen = sample(labels, label, fold(id_col, 5) != 0, id_col, rows)
    texts = texts_of(docs, chosen, id_col, text_col)
    model = estimate(_counts(texts.where(fold(id_col, 5) != 4)))

    def made(buf, offsets):
        return list(differences(model, buf, offsets))

    held = tk.over_texts(texts.where(fold(id_col, 5) == 4), ["label", "weight"], "text", "alone double, paired double, words long", made).toPandas()
    y = held["label"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = _calibrated(_features(*(held[k].to_numpy() for k in ("alone", "paired", "words"))), y, held["weight"].to_numpy())
    return model


def _scores(model: Model, *parts: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(*parts) @ model.weights, -40, 40)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, log_ratio (per word) and score of every row's whole text.

    A null or word-less text has no evidence: its score is the weights' at a length of 0. Rows
    that repeat an id are scored as rows; other columns are ignored.
    """

    def made(buf, offsets):
        alone, paired, words = differences(model, buf, offsets)
        return [words.astype(np.int64), paired / np.maximum(words, 1), _scores(model, alone, paired, words)]

    return tk.over_texts(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), [id_col], text_col, "n_words long, log_ratio double, score double", made)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, log_ratio for every row of ``docs``.

    Null and empty texts have the score of a text without words, very long ones are scored whole,
    repeated rows each have a row, null ids count as held out, no
    documents give no rows and no labels give scores of 0. Other columns do not matter.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "log_ratio")


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic.

    Rows with null or empty texts are judged as texts without words; repeated rows stand or fall
    together; without labels of both classes all rows stay.
    """
    model = fit(docs, labels)
    return tk.filter_texts(docs, "text", lambda buf, offsets: _scores(model, *differences(model, buf, offsets)) < threshold)
