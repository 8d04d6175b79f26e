"""Suffix arrays by induced sorting, and permuted common prefixes, over one piece of text held in memory."""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last suffix counts as smaller than the end of all others."""
    n = len(t)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    rise[-1] = 1
    at = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones given in order: one pass up for larger, one down for smaller types."""
    larger: list[list[np.ndarray]] = [[] for _ in range(width)]
    done_larger: list[np.ndarray] = []
    none = np.zeros(0, np.int64)

    def deal(found: np.ndarray, to: list[list[np.ndarray]]) -> None:
        """Append suffixes to the buckets of their first characters, in order."""
        first = t[found]
        order = np.argsort(first, kind="stable")
        found, first = found[order], first[order]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(found) else none
        for i, part in zip(cuts, np.split(found, cuts[1:])):
            to[first[i]].append(part)

    def before(found: np.ndarray, kind: bool) -> np.ndarray:
        """The suffixes one to the left that are of the wanted type."""
        left = found[found > 0] - 1
        return left[small[left] == kind]

    seeded: list[list[np.ndarray]] = [[] for _ in range(width)]
    deal(seeds, seeded)
    for c in range(width):
        fresh, got = np.concatenate([none, *larger[c]]), []
        while len(fresh):  # a run of one character feeds its own bucket
            got.append(fresh)
            left = before(fresh, False)
            own = t[left] == c
            deal(left[~own], larger)
            fresh = left[own]
        done_larger.append(np.concatenate([none, *got]))
        deal(before(np.concatenate([none, *seeded[c]]), False), larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(width)]
    out: list[np.ndarray] = []
    for c in range(width - 1, -1, -1):
        fresh, got = np.concatenate([none, *smaller[c]]), []
        while len(fresh):
            got.append(fresh)
            left = before(fresh, True)
            own = t[left] == c
            deal(left[~own], smaller)
            fresh = left[own]
        out.append(np.concatenate([none, *got])[::-1] if c else np.array([len(t) - 1]))
        deal(before(done_larger[c][::-1], True), smaller)
        out.append(done_larger[c])
    return np.concatenate(out[::-1])


def suffix_array(t: np.ndarray, width: int) -> np.ndarray:
    """Positions of ``t`` (entries below ``width``) by the order of their suffixes; only the last entry is 0."""
    n = len(t)
    small = classify(t)
    seeds = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    if len(seeds) < 2:
        return _induce(t, small, np.union1d(seeds, [n - 1]), width)
    # leftmost-smaller substrings: sort them by inducing from unsorted seeds, then name equal ones alike
    order = _induce(t, small, seeds, width)
    lead = np.zeros(n, bool)
    lead[seeds] = True
    order = order[lead[order]]
    name = np.zeros(len(seeds), np.int64)
    place = np.searchsorted(seeds, order)
    name[place] = np.concatenate([[0], np.cumsum(_differ(t, small, seeds, place))])
    return _induce(t, small, seeds[_ranked(name)], width)


def _differ(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether neighbouring leftmost-smaller substrings, each up to and with the start of the next, are unequal."""
    ends = np.append(seeds[1:], len(t) - 1)
    size = ends - seeds + 1
    a, c = place[:-1], place[1:]
    unequal = size[a] != size[c]
    open_, k = np.flatnonzero(~unequal), 0
    while len(open_):
        bad = t[seeds[a[open_]] + k] != t[seeds[c[open_]] + k]
        unequal[open_[bad]] = True
        k += 1
        open_ = open_[~bad & (size[a[open_]] > k)]
    return unequal


def _ranked(name: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string. All recursion levels run side by side: each round ranks by twice as many names."""
    m, reach = len(name), 1
    rank = name + 1
    order = np.argsort(rank, kind="stable")
    rank[order] = 1 + np.concatenate([[0], np.flatnonzero(np.diff(rank[order])) + 1])[np.concatenate([[0], np.cumsum(np.diff(rank[order]) != 0)])]
    while True:
        sorted_rank = rank[order]
        tied = np.zeros(m, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        who = order[slots]
        then = np.where(who + reach < m, rank[np.minimum(who + reach, m - 1)], 0)
        key = sorted_rank[slots] * (m + 2) + then
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[slots] = who
        new = np.concatenate([[True], key[1:] != key[:-1]])
        # a rank is one more than the place of the first of its ties
        rank[who] = 1 + slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        reach *= 2


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, length): the suffix in front of each in the array, and the length of the prefix they share.

    Where both are preceded by the same character, the length is one less than that of the suffix to the left; only the
    others are compared, and a running maximum gives the rest.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(before >= 0)
    left = np.where((at > 0) & (before[at] > 0), t[at - 1] == t[before[at] - 1], False)
    own = at[~left]
    length, live, k = np.zeros(len(own), np.int64), np.arange(len(own)), 0
    while len(live):
        i, j = own[live] + k, before[own[live]] + k
        live = live[(i < n) & (j < n)]
        i, j = own[live] + k, before[own[live]] + k
        live = live[t[i] == t[j]]
        k += 1
        length[live] = k
    ends = np.zeros(n, np.int64)
    ends[own] = own + length
    return before, np.maximum(np.maximum.accumulate(ends) - np.arange(n), 0)
