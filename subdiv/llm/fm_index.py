"""Bidirectional FM-index over word ids, in numpy, for phrases of a bounded length.

The indexed text is a sequence of word ids with 0 between pieces and at both ends.  Rows
stand for positions, sorted by the ``depth`` words that follow; a phrase of up to that many
words is an interval of rows.  The Burrows-Wheeler column holds the word before each
position, and the last-to-first column says to which row one goes by putting that word in
front.  Rows that agree in ``depth`` words stand in any order, which no interval of a phrase
can see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def order_of(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` words that begin there; compared words double in every round."""
    n, width = len(text), 1
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable") if depth == 1 else None
    while width < depth:
        step = min(width, depth - width)
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key)
        width += step
        if width < depth:
            ranked = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return order


@dataclass
class Index:
    """Rows of one direction."""

    bwt: np.ndarray  # word before the position of each row
    to_front: np.ndarray  # row after putting that word in front
    first: np.ndarray  # first row of each word, and the number of rows

    @classmethod
    def of(cls, text: np.ndarray, depth: int, words: int) -> tuple[Index, np.ndarray]:
        """The index, and the position of each row."""
        order = order_of(text, depth)
        bwt = text[order - 1]  # the position before the first is the last, which is 0 as well
        to_front = np.empty(len(text), dtype=np.int64)
        to_front[np.argsort(bwt.astype(np.int64) * len(text) + np.arange(len(text)))] = np.arange(len(text))
        return cls(bwt, to_front, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words))])), order

    def extend(self, low: np.ndarray, high: np.ndarray):
        """All one-word extensions of disjoint intervals: number of the interval, word, new interval."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - np.cumsum(size) + size, size)
        inside = self.bwt[rows] != 0
        owner, rows = owner[inside], rows[inside]
        # in the order of the new rows, extensions of one interval by one word are neighbours
        at = self.to_front[rows]
        held = np.full(len(self.bwt), -1, dtype=np.int64)
        held[at] = owner
        at = np.flatnonzero(held >= 0)
        owner, word = held[at], np.searchsorted(self.first, at, side="right") - 1
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])) if len(at) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([new, [len(at)]]))
        return owner[new], word[new], at[new], at[new] + count


@dataclass
class Grams:
    """Phrases of one length: their words, their rows in the index and in that of the reversed text."""

    words: np.ndarray  # one row per phrase
    low: np.ndarray
    high: np.ndarray
    back: np.ndarray  # first row in the index of the reversed text

    @property
    def count(self) -> np.ndarray:
        return self.high - self.low

    def some(self, keep: np.ndarray) -> Grams:
        return Grams(self.words[keep], self.low[keep], self.high[keep], self.back[keep])


class TwoWay:
    """Index of a text and of its reverse, moved together."""

    def __init__(self, text: np.ndarray, depth: int, words: int, followed: tuple[np.ndarray, np.ndarray] | None = None):
        """``followed``: whether a word stands before, and behind, each position; by default what the text shows."""
        self.ahead, order = Index.of(text, depth, words)
        self.reverse, back = Index.of(text[::-1], depth, words)
        self._empty = [np.concatenate([[0], np.cumsum(i.bwt == 0)]) for i in (self.ahead, self.reverse)]
        before, behind = followed or (np.roll(text, 1) != 0, np.roll(text, -1) != 0)
        self._next = [np.concatenate([[0], np.cumsum(x)]) for x in (before[order], behind[len(text) - 1 - back])]

    def single(self) -> Grams:
        words = 1 + np.flatnonzero(np.diff(self.ahead.first)[1:])
        return Grams(words[:, None], self.ahead.first[words], self.ahead.first[words + 1], self.reverse.first[words])

    def _moved(self, index: Index, other_empty, low, high, other):
        """Extensions by ``index``, and the interval each takes within the other direction's ``other``."""
        owner, word, new_low, new_high = index.extend(low, high)
        by_owner = np.lexsort((word, owner))
        owner, word, new_low, new_high = (x[by_owner] for x in (owner, word, new_low, new_high))
        size = new_high - new_low
        before = np.cumsum(size) - size
        starts = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        before -= np.repeat(before[starts], np.diff(np.concatenate([np.flatnonzero(starts), [len(owner)]]))) if len(owner) else 0
        ends = other_empty[high] - other_empty[low]  # occurrences at the edge of a piece come first
        return owner, word, new_low, new_high, other[owner] + ends[owner] + before

    def to_left(self, grams: Grams) -> Grams:
        """Every phrase with one more word in front."""
        order = np.argsort(grams.low)
        grams = grams.some(order)
        owner, word, low, high, back = self._moved(self.ahead, self._empty[0], grams.low, grams.high, grams.back)
        return Grams(np.column_stack([word, grams.words[owner]]), low, high, back)

    def to_right(self, grams: Grams) -> Grams:
        """Every phrase with one more word behind."""
        order = np.argsort(grams.back)
        grams = grams.some(order)
        owner, word, back, end, low = self._moved(self.reverse, self._empty[1], grams.back, grams.back + grams.count, grams.low)
        return Grams(np.column_stack([grams.words[owner], word]), low, low + (end - back), back)

    def neighbours(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences with a word in front, and with a word behind, in the same piece."""
        before, behind = self._next
        return before[grams.high] - before[grams.low], behind[grams.back + grams.count] - behind[grams.back]
