"""Whole texts of an Arrow batch as one byte array, cut into words, lines and hashes without a loop over rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is one piece.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _table(inside: Iterable[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(inside)] = True
    return t


#: bytes of words cut at white space, and of lower-cased words of letters, digits and anything beyond ASCII
UNSPACED = _table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _table(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


class Texts:
    """The texts of some rows: ``data`` holds their bytes, ``offs`` the borders between rows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1

    @staticmethod
    def of(column: pa.Array) -> Texts:
        column = pc.fill_null(column, "").cast(pa.large_string())
        offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        return Texts(data[offs[0] : offs[-1]], offs - offs[0])

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offs)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of True bytes; no run spans two rows."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = self.offs[1:] > self.offs[:-1]
        at, to = self.offs[:-1][full], self.offs[1:][full] - 1
        first[at] = inside[at]
        last[to] = inside[to]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(table[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the newline-split lines; an empty row has one empty line."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offs[:-1], cuts + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offs[1:], cuts]), kind="stable")
        return starts, ends

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The row of each byte position that lies inside one."""
        return np.searchsorted(self.offs, at, "right") - 1

    def count(self, flags: np.ndarray) -> np.ndarray:
        """True bytes of each row."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, from one running sum."""
        power, back = _powers(1 << max(10, int(len(self.data)).bit_length()))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _UNBASE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive entries of ``h``, one for each start that has them."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : j + n]
    return mix(out)


def chain_rows(h: np.ndarray) -> np.ndarray:
    """One hash from the entries of every column."""
    out = np.zeros(h.shape[1:], np.uint64)
    for row in h:
        out = out * _BASE + row
    return mix(out)


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about ``limit`` bytes of text, and their texts."""
    for batch in batches:
        whole = Texts.of(batch.column(text))
        i = 0
        while i < whole.n:
            j = max(i + 1, int(np.searchsorted(whole.offs, whole.offs[i] + limit, "right")) - 1)
            o = whole.offs[i : j + 1]
            yield batch.slice(i, j - i), Texts(whole.data[o[0] : o[-1]], o - o[0])
            i = j


def borders(owner: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of ``n`` rows begin in the sorted ``owner``, and the end."""
    return np.searchsorted(owner, np.arange(n + 1))


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums between consecutive edges; an empty stretch gives zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))
