"""Counts of words, symbols, repeated lines and repeated word windows of whole texts."""

from __future__ import annotations

import numpy as np

from quantloom.llm import batches as b

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_POINTS = np.isin(np.arange(256), list(b".,;:!?"))
_MARKS = np.isin(np.arange(256), list(b"!?"))
WINDOW = 8


class Structure:
    """The counts of every row of ``texts``, as integer arrays."""

    def __init__(self, texts: b.Texts):
        self.texts = texts
        inside = b.UNSPACED[texts.data]
        lead = (texts.data & 0xC0) != 0x80
        self.starts, self.ends = texts.runs(inside)
        self.row = texts.row_of(self.starts)
        self.edges = b.borders(self.row, texts.n)
        self.hash = texts.hashes(self.starts, self.ends)
        self.n_words = np.diff(self.edges)
        self.n_chars = texts.count(lead)
        self.word_chars = texts.count(inside & lead)
        self.n_symbols = texts.count(SYMBOLS[texts.data])
        self.n_lines, self.n_dup_lines = self._lines(inside)
        self.n_repeat_words = self._repeats()

    def _lines(self, inside) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self.texts.lines()
        seen = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        full = seen[ends] > seen[starts]
        starts, ends = starts[full], ends[full]
        row = self.texts.row_of(starts)
        n = np.bincount(row, minlength=self.texts.n)
        own = b.mix(self.texts.hashes(starts, ends) + row.astype(np.uint64))
        _, at = np.unique(own, return_index=True)
        return n, n - np.bincount(row[at], minlength=self.texts.n)

    def _repeats(self) -> np.ndarray:
        n = len(self.hash)
        if n < WINDOW:
            return np.zeros(self.texts.n, np.int64)
        whole = self.row[: n - WINDOW + 1] == self.row[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        own = b.mix(b.chain(self.hash, WINDOW)[at] + self.row[at].astype(np.uint64))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(n + 1, np.int64)
        step[at[twice]] += 1
        step[at[twice] + WINDOW] -= 1
        return np.bincount(self.row[np.cumsum(step[:-1]) > 0], minlength=self.texts.n)

    def shares(self) -> dict[str, np.ndarray]:
        """Figures that describe the shape of a text, each 0 where the text is empty."""
        t, words, chars = self.texts, np.maximum(self.n_words, 1), np.maximum(self.n_chars, 1)
        _, at = np.unique(b.mix(self.hash + self.row.astype(np.uint64)), return_index=True)
        kinds = np.bincount(self.row[at], minlength=t.n)
        return {
            "words": np.log2(1 + self.n_words),
            "word_length": self.word_chars / words,
            "symbols": self.n_symbols / words,
            "upper": t.count(_UPPER[t.data]) / chars,
            "digits": t.count(_DIGIT[t.data]) / chars,
            "points": t.count(_POINTS[t.data]) / words,
            "marks": t.count(_MARKS[t.data]) / words,
            "kinds": kinds / words,
            "dup_lines": self.n_dup_lines / np.maximum(self.n_lines, 1),
            "repeats": self.n_repeat_words / words,
        }
