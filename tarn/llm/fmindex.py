"""A bidirectional FM-index over delimited words, searched for many words at once with one error."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _rotations(text: np.ndarray) -> np.ndarray:
    """The starts of the rotations of ``text`` in order, by ranks of twice as many characters each round."""
    n, rank, width = len(text), text.astype(np.int64), 1
    while True:
        key = rank * (n + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


@dataclass
class _Side:
    """The index of one reading direction: occurrences of every letter in the transform's prefixes, and the first row of each letter."""

    starts: np.ndarray
    seen: np.ndarray
    first: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray, letters: int, word_at: np.ndarray) -> _Side:
        starts = _rotations(text)
        last = text[starts - 1]
        seen = np.zeros((len(text) + 1, letters), np.int32)
        np.cumsum(last[:, None] == np.arange(letters), axis=0, out=seen[1:], dtype=np.int32)
        counts = seen[-1].astype(np.int64)
        return cls(starts, seen, np.cumsum(counts) - counts, word_at)


class Index:
    """Distinct words between delimiters (letter 0), read both ways.

    A pattern's occurrences are an interval of suffix ranks in the forward text and one of as many
    in the backward text; a letter put before the pattern or after it narrows both.
    """

    def __init__(self, words: list[np.ndarray], letters: int):
        text = np.zeros(sum(map(len, words)) + len(words) + 1, np.int64)
        ends = np.cumsum([len(w) + 1 for w in words])
        inner = np.ones(len(text), bool)
        inner[0] = False
        inner[ends] = False
        text[inner] = np.concatenate(words)
        before, after = np.full(len(text), -1), np.full(len(text), -1)
        before[np.concatenate([[0], ends[:-1]])] = np.arange(len(words))  # the delimiter before a word
        after[len(text) - 1 - ends] = np.arange(len(words))  # the one behind it, from the end
        self.letters = letters
        self.sides = _Side.of(text, letters, before), _Side.of(text[::-1].copy(), letters, after)

    def narrowed(self, side: int, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """States (start there, start in the other side, size) with ``letter`` before the pattern as ``side`` reads it."""
        here, there, size = state[:, side], state[:, 1 - side], state[:, 2]
        index = self.sides[side]
        low, high = index.seen[here], index.seen[here + size]
        row = np.arange(len(state))
        made = np.empty_like(state)
        made[:, side] = index.first[letter] + low[row, letter]
        counts = high - low
        made[:, 1 - side] = there + np.where(np.arange(self.letters) < letter[:, None], counts, 0).sum(axis=1)
        made[:, 2] = counts[row, letter]
        return made

    def branches(self, side: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``state``, letter, narrowed state) for all letters but the delimiter that occur before the pattern."""
        index = self.sides[side]
        counts = index.seen[state[:, side] + state[:, 2]] - index.seen[state[:, side]]
        row, letter = np.nonzero(counts[:, 1:])
        return row, letter + 1, self.narrowed(side, state[row], letter + 1)

    def one_error(self, queries: np.ndarray, exact: int, mirrored: bool = False) -> np.ndarray:
        """(row of ``queries``, word) pairs at one error that lies behind the first ``exact`` letters, once each.

        ``queries`` have one length. ``mirrored``: they are given backwards, and so the error lies
        before the last letters of the words. The exact half is matched from its inner end to the
        delimiter, then the pattern is extended over the other half: by its letter, and once by
        another letter, by one more, or by none.
        """
        left, right = (1, 0) if mirrored else (0, 1)
        n, length = queries.shape
        state = np.zeros((n, 3), np.int64)
        state[:, 2] = len(self.sides[0].starts)
        of = np.arange(n)
        for k in range(exact - 1, -1, -1):
            state = self.narrowed(left, state, queries[of, k])
            of, state = _alive(of, state)
        of, state = _alive(of, self.narrowed(left, state, np.zeros(len(of), np.int64)))
        erred_of, erred = of[:0], state[:0]
        for k in range(exact, length + 1):
            row, letter, more = self.branches(right, state)
            erred_of, erred = np.concatenate([erred_of, of[row]]), np.concatenate([erred, more])  # one letter more in the word
            if k == length:
                break
            wanted = queries[:, k]
            erred_of, erred = _alive(erred_of, self.narrowed(right, erred, wanted[erred_of]))
            other = letter != wanted[of[row]]
            erred_of = np.concatenate([erred_of, of[row[other]], of])  # another letter, and none
            erred = np.concatenate([erred, more[other], state])
            of, state = _alive(of, self.narrowed(right, state, wanted[of]))
        erred_of, erred = _alive(erred_of, self.narrowed(right, erred, np.zeros(len(erred_of), np.int64)))
        side = self.sides[left]
        return np.unique(np.stack([erred_of, side.word[side.starts[erred[:, left]]]], axis=1), axis=0)


def _alive(of: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = state[:, 2] > 0
    return of[kept], state[kept]
