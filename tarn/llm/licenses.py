"""Licence texts in documents, by winnowed fingerprints of templates and banded alignment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import textkernel as tk
from tarn.llm.common import lean
from tarn.llm.templates import NOTICES

#: The part of a template's words that must be matched, in percent.
COVERAGE = 80
#: Templates of SHORT words or more have fingerprints of GRAM words, the least of each WINDOW in a
#: row: a run of GRAM + WINDOW - 1 equal words has one for sure. Of a match that puts in, changes
#: and leaves out words in fewer than 0.4 * words - 1 places some run is as long as that. In shorter
#: templates every word is a fingerprint.
SHORT, GRAM, WINDOW = 16, 2, 2


@dataclass
class Index:
    """Fingerprints of one length: hashes in order, where each one's postings begin, and postings."""

    keys: np.ndarray
    starts: np.ndarray
    template: np.ndarray
    place: np.ndarray


@dataclass
class Library:
    """Templates as word hashes, the inverted index of their fingerprints, and their words' counts.

    ``band``: how far from a fingerprint's diagonal words may be put in or left out. For a short
    template it is as far as any match can go, for others a quarter of the template.
    """

    names: list[tuple[str, str]]
    words: list[np.ndarray]
    keys: np.ndarray
    times: np.ndarray
    need: np.ndarray
    band: np.ndarray
    index: dict[int, Index]


def _split(buf: np.ndarray, offsets: np.ndarray) -> tuple[tk.Words, np.ndarray]:
    """Words of letters, digits and non-ASCII bytes, in lower case."""
    w = tk.split(buf, offsets, tk.BREAK)
    return w, tk.hash_spans(buf, w.starts, w.ends, folded=True)


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    out = words
    for k in range(1, width):
        out = tk.pair_hash(out[: max(len(words) - k, 0)], words[k:])
    return out


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """The places of the least hash of every ``window`` grams in a row; of equal ones the last."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(grams[::-1].argmin())]) if len(grams) else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(rows)) + window - 1 - rows.argmin(axis=1))


def library(templates: Mapping[tuple[str, str], str] = NOTICES) -> Library:
    """The templates' fingerprints and words; the size is the library's."""
    words = []
    for text in templates.values():
        ((_, _, buf, offsets),) = tk.slices(pa.array([text]))
        words.append(_split(buf, offsets)[1])
    keys = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
    times = np.stack([np.bincount(np.searchsorted(keys, w), minlength=len(keys)) for w in words], axis=1) if words else np.zeros((0, 0), np.int64)
    need = np.array([max(1, -(-COVERAGE * len(w) // 100)) for w in words], dtype=np.int64)
    band = np.array([2 * len(w) if len(w) < SHORT else max(SHORT, len(w) // 4) for w in words], dtype=np.int64)
    index = {}
    for width, short in ((1, True), (GRAM, False)):
        posts = []
        for k, w in enumerate(words):
            if (len(w) < SHORT) == short:
                grams = _grams(w, width)
                at = np.arange(len(grams)) if short else winnowed(grams, WINDOW)
                posts += [(int(grams[i]), k, int(i)) for i in at]
        posts.sort()
        held, starts = np.unique(np.array([p[0] for p in posts], dtype=np.uint64), return_index=True)
        index[width] = Index(held, np.append(starts, len(posts)), np.array([p[1] for p in posts], dtype=np.int64), np.array([p[2] for p in posts], dtype=np.int64))
    return Library(list(templates), words, keys, times, need, band, index)


def hits(lib: Library, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, template, place in the template) of every fingerprint that the texts hold, by word."""
    found = []
    for width, index in lib.index.items():
        if len(words) < width or not len(index.keys):
            continue
        grams = _grams(words, width)
        at = np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)
        here = np.flatnonzero((index.keys[at] == grams) & (doc[: len(grams)] == doc[width - 1 :]))
        n = index.starts[at[here] + 1] - index.starts[at[here]]
        post = np.repeat(index.starts[at[here]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        found.append(np.stack([np.repeat(here, n), index.template[post], index.place[post]]))
    all_ = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return tuple(all_[:, np.argsort(all_[0], kind="stable")])


def aligned(template: np.ndarray, words: np.ndarray, band: int) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment near the main diagonal.

    ``words`` begins ``band`` words before the template's first one and ends ``band`` words after
    its last. A match counts 2, a word left out, put in or changed -1. ``start`` and ``end`` are
    places in ``words``. Of equal scores the first alignment counts.
    """
    width = 2 * band + 1
    best, found = 0, (0, 0, 0)
    place = np.arange(width)
    score, matched, start = (np.zeros(width + 1, dtype=np.int64) for _ in range(3))
    for row, t in enumerate(template):
        # a cell's place in the row before is the same for the word before, and the next for this word
        equal = words[row : row + width] == t
        cell = score[:-1] + np.where(equal, 2, -1)
        count = matched[:-1] + equal
        first = np.where(equal & (score[:-1] == 0), place + row, start[:-1])
        up = score[1:] - 1 > cell
        cell, count, first = np.where(up, score[1:] - 1, cell), np.where(up, matched[1:], count), np.where(up, start[1:], first)
        # words put in: the last place from which the way to the right costs least
        ahead = np.maximum.accumulate((np.maximum(cell, 0) + place) * (width + 1) + place)
        of = ahead % (width + 1)
        cell = ahead // (width + 1) - place
        alive = cell > 0
        score[:-1], matched[:-1], start[:-1] = np.where(alive, cell, 0), np.where(alive, count[of], 0), np.where(alive, first[of], 0)
        j = int(score[:-1].argmax())
        if score[j] > best:
            best, found = int(score[j]), (int(matched[j]), int(start[j]), j + row + 1)
    return found


def _places(lib: Library, k: int, words: np.ndarray, ids: np.ndarray, at: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(matched, start, end) of all matches of a template in one text, none on another's words.

    ``at``, ``place``: words of the text with a fingerprint and the fingerprints' places in the
    template. ``ids``: the place of each word in the library's word list, -1 if it has none. Each
    fingerprint outside the matches so far is aligned on its own diagonal, if the words there
    are enough for a match.
    """
    template, need, band = lib.words[k], int(lib.need[k]), int(lib.band[k])
    n = len(template)
    low, high = np.maximum(at - place - band, 0), np.minimum(at - place + n + band, len(words))
    held = np.concatenate([[0], np.cumsum((ids >= 0) & (lib.times[ids, k] > 0))])
    ids = np.where(ids < 0, len(lib.keys), ids)
    free, times = words.copy(), np.append(lib.times[:, k], 0)
    found, failed, done = [], None, 0
    for i in np.flatnonzero(held[high] - held[low] >= need):
        t, lo, hi = int(at[i]), int(low[i]), int(high[i])
        diagonal = t - int(place[i])
        while t >= done and failed != (diagonal, len(found)):
            own = ids[lo:hi][free[lo:hi] != 0]
            if np.minimum(np.bincount(own, minlength=len(times)), times).sum() < need:
                break
            near = np.zeros(n + 2 * band, dtype=np.uint64)
            near[lo - diagonal + band : hi - diagonal + band] = free[lo:hi]
            matched, a, b = aligned(template, near, band)
            if matched < need:
                failed = (diagonal, len(found))
                break
            a, b = a + diagonal - band, b + diagonal - band
            free[a:b] = 0
            found.append((matched, a, b))
            if a <= t < b:
                done = b
                break
    return found


def _rest(lib: Library, k: int, words: np.ndarray, taken: np.ndarray, a: int, b: int) -> tuple[int, int, int]:
    """(matched, start, end) of the best alignment of a template with a free run of the words a to b."""
    template = lib.words[k]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], taken[a:b], [True]]).astype(np.int8)))
    best = (0, a, a)
    for first, last in edges.reshape(-1, 2).tolist():
        if last - first >= lib.need[k]:
            # as wide a band as the run: where the template lies in it is not known any more
            band = max(last - first, len(template))
            near = np.zeros(len(template) + 2 * band, dtype=np.uint64)
            near[band : band + last - first] = words[a + first : a + last]
            matched, start, end = aligned(template, near, band)
            best = max(best, (matched, a + first + start - band, a + first + end - band), key=lambda m: m[0])
    return best


def _matches(lib: Library, words: np.ndarray, ids: np.ndarray, at: np.ndarray, template: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, matched, start, end) of one text, no two of them on the same words.

    Those with most matched words come first; of one that meets their words, what is left between
    them is aligned again and waits for its turn, if it is still enough.
    """
    found = [(int(k), *one) for k in np.unique(template) for one in _places(lib, int(k), words, ids, at[template == k], place[template == k])]
    waiting = [(-matched, start, k, end) for k, matched, start, end in found]
    heapify(waiting)
    taken, kept = np.zeros(len(words), dtype=bool), []
    while waiting:
        matched, start, k, end = heappop(waiting)
        if not taken[start:end].any():
            taken[start:end] = True
            kept.append((k, -matched, start, end))
            continue
        left, start, end = _rest(lib, k, words, taken, start, end)
        if left >= lib.need[k]:
            heappush(waiting, (-left, start, k, end))
    return sorted(kept, key=lambda f: f[2:])


def _enough(lib: Library, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """text * templates + template of the pairs where the text holds as many of the template's words as a match needs."""
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return at
    pair, n = np.unique(doc[at] * len(lib.keys) + ids[at], return_counts=True)
    of, word = pair // len(lib.keys), pair % len(lib.keys)
    texts, first = np.unique(of, return_index=True)
    both = np.add.reduceat(np.minimum(n[:, None], lib.times[word]), first, axis=0)
    text, template = np.nonzero(both >= lib.need)
    return texts[text] * len(lib.names) + template


def _points(buf: np.ndarray) -> np.ndarray:
    """The code points before each byte of UTF-8 texts, and of all: bytes that start one, summed up once."""
    return np.concatenate([[0], np.cumsum((np.asarray(buf) & 0xC0) != 0x80)])


def scan(docs: DataFrame, lib: Library | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per match: id, license_id, template, matched, coverage, word and character spans.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A text is a candidate
    for the templates of which it holds a winnowed fingerprint. Where the words about it are
    enough they are aligned in a band around the fingerprint's diagonal; every match of COVERAGE
    percent of a template's words is reported. Words count for the match with most matched words;
    another that meets them is reported if its words beside them are enough alone. Texts stay where they are read; the index is sent to the tasks and grows with
    the templates only. Null, empty and unlicensed texts have no rows, an empty table none; very
    long texts are scanned whole, in time that grows with their words and matches. Rows that repeat
    an id have their own; other columns are ignored. char_start and char_end are code points.
    """
    lib = lib or library()
    schema = docs.select(id_col).schema.add("license_id", "string").add("template", "string").add("matched", "integer").add("coverage", "double").add("word_start", "long").add("word_end", "long").add("char_start", "long").add("char_end", "long")

    def run(batches):
        for batch in batches:
            for lo, _, buf, offsets in tk.slices(batch.column(1)):
                w, hashes = _split(buf, offsets)
                ids = np.minimum(np.searchsorted(lib.keys, hashes), max(len(lib.keys) - 1, 0))
                ids = np.where(lib.keys[ids] == hashes, ids, -1) if len(lib.keys) else np.full(len(hashes), -1)
                at, template, place = hits(lib, hashes, w.doc)
                good = np.isin(w.doc[at] * len(lib.names) + template, _enough(lib, ids, w.doc))
                at, template, place = at[good], template[good], place[good]
                bounds, rows = w.bounds, []
                owner = w.doc[at]
                points = _points(buf) if len(at) else None
                for d in np.unique(owner):
                    base, stop = int(bounds[d]), int(bounds[d + 1])
                    mine = slice(*np.searchsorted(owner, [d, d + 1]))
                    for k, matched, start, end in _matches(lib, hashes[base:stop], ids[base:stop], at[mine] - base, template[mine], place[mine]):
                        first, last = (int(points[byte] - points[offsets[d]]) for byte in (w.starts[base + start], w.ends[base + end - 1]))
                        rows.append((lo + int(d), *lib.names[k], matched, matched / len(lib.words[k]), start, end, first, last))
                kept = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                types = (pa.string(), pa.string(), pa.int32(), pa.float64(), *(pa.int64(),) * 4)
                yield pa.RecordBatch.from_arrays([kept] + [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(types)], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(lean(run), schema)
