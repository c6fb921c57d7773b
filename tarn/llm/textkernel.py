"""Vectorised word splitting, hashing and statistics over Arrow batches of texts.

A slice is the UTF-8 bytes of consecutive whole texts and their offsets. All functions work on
slices of about half a MB, so memory does not follow the batch; a longer text is a slice of its own.
A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarn.llm.common import lean

SLICE_BYTES = 512 << 10

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The bytes between words of letters, digits and non-ASCII bytes.
BREAK = np.ones(256, dtype=bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_draw = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWER = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, 1024, dtype=np.uint64) | np.uint64(1)


def _powers(longest: int) -> np.ndarray:
    global _POWER
    if longest > len(_POWER):
        size = 1 << int(longest - 1).bit_length()
        _POWER = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, size, dtype=np.uint64) | np.uint64(1)
    return _POWER


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """The words of a slice in order: where each starts and ends, and the text it is of."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    @property
    def bounds(self) -> np.ndarray:
        """Offsets into the words by text."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, last, data[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def split(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Words between the bytes that ``space`` marks."""
    solid = ~space[buf]
    first, last = solid.copy(), solid.copy()
    if len(buf):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(offsets, starts, side="right") - 1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """64-bit hashes of non-empty byte spans; ``folded``: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    values = (_FOLDED if folded else _BYTE)[buf[place + np.repeat(starts, lengths)]]
    values *= _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order matters."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the text of each.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    n = len(hashes)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    run = hashes.copy()
    for k in range(1, width):
        run = pair_hash(run[: n - k], hashes[k:]) if n > k else run[:0]
    full = np.flatnonzero(doc[: len(run)] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    out, of = run[full], doc[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        value = hashes[bounds[short]]
        for k in range(1, width - 1):
            more = counts[short] > k
            value = np.where(more, pair_hash(value, hashes[np.minimum(bounds[short] + k, n - 1)]), value)
        value = mix(value ^ np.uint64(0x5851F42D4C957F2D) * counts[short].astype(np.uint64))
        out, of = np.concatenate([out, value]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def distinct(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, one text after another, and their offsets."""
    at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    parts = [np.unique(values[at[i] : at[i + 1]]) for i in range(n)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a value for each byte or word by text."""
    upto = np.cumsum(values)
    total = np.zeros(len(upto) + 1, dtype=upto.dtype)  # a plain 0 would turn unsigned sums into floats
    total[1:] = upto
    return total[bounds[1:]] - total[bounds[:-1]]


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_HIGH = np.zeros(256, dtype=bool)
_HIGH[128:] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _of_class(lut: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return per_text(lut[buf], offsets)


def rule_counts(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    ``n_dup_lines``: lines (split at ``\\n``) that hold a word and equal an earlier line of the
    text. ``n_repeat_words``: words inside some 3-word window that the text holds twice or more.
    """
    n = len(w.offsets) - 1
    counts, bounds = w.counts, w.bounds
    point = (w.buf & 0xC0) != 0x80
    out = {"n_words": counts, "word_chars": per_text(point & ~_SPACE[w.buf], w.offsets), "n_symbols": _of_class(_SYMBOL, w.buf, w.offsets)}
    h = hash_spans(w.buf, w.starts, w.ends)
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) > 2:
        whole = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        window = mix(pair_hash(pair_hash(h[:-2], h[1:-1]), h[2:])[whole] ^ mix(w.doc[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(window), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered[whole[twice]] += 1
        covered[whole[twice] + 3] -= 1
    out["n_repeat_words"] = per_text(np.cumsum(covered)[:-1] > 0, bounds)
    # lines: between text starts, newlines and text ends
    breaks = np.flatnonzero(w.buf == 10)
    line_starts = np.concatenate([w.offsets[:-1], breaks + 1])
    line_ends = np.concatenate([breaks, w.offsets[1:]])
    line_starts.sort(kind="stable")
    line_ends.sort(kind="stable")
    line_doc = np.searchsorted(w.offsets[:-1], line_starts, side="right") - 1
    words_before = np.searchsorted(w.starts, np.stack([line_starts, line_ends]))
    solid = (words_before[1] > words_before[0]) & (line_ends > line_starts)
    line_starts, line_ends, line_doc = line_starts[solid], line_ends[solid], line_doc[solid]
    key = mix(hash_spans(w.buf, line_starts, line_ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)))
    _, once = np.unique(key, return_index=True)
    repeat = np.ones(len(key), dtype=bool)
    repeat[once] = False
    out["n_dup_lines"] = np.bincount(line_doc[repeat], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    return out


def text_shape(w: Words) -> dict[str, np.ndarray]:
    """Rates of a text's characters, words and lines; every rate of an empty text is 0."""
    return shape_and_counts(w)[0]


def shape_and_counts(w: Words) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """``text_shape`` and the ``rule_counts`` it is made from."""
    c = rule_counts(w)
    n_words, n_bytes = np.maximum(c["n_words"], 1), np.maximum(np.diff(w.offsets), 1)
    by_byte = {k: _of_class(lut, w.buf, w.offsets) for k, lut in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("high", _HIGH), ("punct", _PUNCT))}
    letters = np.maximum(by_byte["upper"] + by_byte["lower"] + by_byte["high"] / 2, 1)
    h = hash_spans(w.buf, w.starts, w.ends, folded=True)
    _, at = distinct(h, w.doc, len(w.offsets) - 1)
    lengths = (w.ends - w.starts).astype(np.float64)
    mean = per_text(lengths, w.bounds) / n_words
    shape = {
        "log_words": np.log1p(c["n_words"]),
        "mean_word": mean,
        "symbol_rate": c["n_symbols"] / n_words,
        "upper_rate": by_byte["upper"] / letters,
        "digit_rate": by_byte["digit"] / n_bytes,
        "punct_rate": by_byte["punct"] / n_words,
        "repeat_rate": c["n_repeat_words"] / n_words,
        "dup_line_rate": c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        "distinct_rate": np.diff(at) / n_words,
        "words_per_line": np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)),
        "long_word_rate": per_text((lengths > 14).astype(np.float64), w.bounds) / n_words,
    }
    return shape, c


def over_texts(df: DataFrame, keep: list[str], text: str, fields: str, made: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """``keep`` columns of each row and the ``fields`` that ``made(bytes, offsets)`` gives for its text."""
    schema = T.StructType([df.schema[k] for k in keep] + T.StructType.fromDDL(fields).fields)
    read = keep if text in keep else [*keep, text]

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column(read.index(text))):
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [x if isinstance(x, pa.Array) else pa.array(x) for x in made(buf, offsets)], names=schema.names)

    return df.select(*(f"`{c}`" for c in read)).mapInArrow(lean(run), schema)


def filter_texts(df: DataFrame, text: str, kept: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows for whose text ``kept(bytes, offsets)`` holds, with all columns."""
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column(place)):
                yield batch.slice(lo, hi - lo).filter(pa.array(kept(buf, offsets)))

    return df.mapInArrow(lean(run), df.schema)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list column of 64-bit integers from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
