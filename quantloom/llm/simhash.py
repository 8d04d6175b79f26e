"""SimHash near-duplicates: a Gray-ordered hierarchical index finds every pair of fingerprints at few differing bits.

Fingerprints equal to each other are one entry. The 64 bits fall into six runs; two fingerprints at four or fewer
differing bits agree on at least two runs, so each entry is dealt out once for every pair of runs under the value of
those bits. Within such a cell the entries are sorted by Gray rank. Nodes over eight entries, then over eight nodes, hold
the mask of bits that all entries below share and their values. Two nodes are compared by the masked bits: what differs
there differs in every pair below, and the pair of nodes falls as soon as these differences pass the limit.

A null text counts as empty; texts without words have fingerprint zero and link like others. Rows with a null id take
part and count as larger than any id: a component of null ids alone has a null component_id. Repeated rows and ids share
a fingerprint or link as others do. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import batches as b
from quantloom.llm.graph import components
from quantloom.llm.store import keep, spare

SHINGLE, SEED, BITS = 4, 42, 4
#: Borders of the six runs of bits, and the pairs of runs that deal entries out.
RUNS = (0, 11, 22, 33, 44, 54, 64)
PAIRS = tuple(combinations(range(6), 2))
FAN = 8
_FRONT = 1 << 16


def _prints(batches) -> Iterator[pa.RecordBatch]:
    for part, raw in b.pieces(batches, "text"):
        texts = raw.lower()
        starts, ends = texts.words(b.UNSPACED)
        row = texts.row_of(starts)
        size = np.diff(b.borders(row, texts.n))
        # words side by side with one space between them
        inside = b.UNSPACED[texts.data]
        keep_byte = inside.copy()
        keep_byte[1:] |= inside[:-1]
        moved = np.concatenate([[0], np.cumsum(keep_byte)])
        joined = np.where(inside, texts.data, 32)[keep_byte].astype(np.uint8).tobytes()
        first = np.concatenate([[0], np.cumsum(size)])
        step = SHINGLE - 1
        full = np.flatnonzero(row[: max(0, len(row) - step)] == row[step:])
        few = np.flatnonzero((size > 0) & (size < SHINGLE))
        at = np.concatenate([moved[starts[full]], moved[starts[first[few]]]]).astype(np.int64)
        to = np.concatenate([moved[ends[full + step]], moved[ends[first[few + 1] - 1]]]).astype(np.int64)
        owner = np.concatenate([row[full], few])
        order = np.argsort(owner, kind="stable")
        at, to, owner = at[order], to[order], owner[order]
        h = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(at.tolist(), to.tolist())), np.uint64, len(at))
        edges = b.borders(owner, texts.n)
        out = np.zeros(texts.n, np.uint64)
        some = np.flatnonzero(np.diff(edges))
        for block in np.array_split(some, max(1, len(h) >> 16)):
            if len(block):
                lo, hi = edges[block[0]], edges[block[-1] + 1]
                bits = np.unpackbits(h[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, edges[block] - lo, axis=0, dtype=np.int64)
                most = 2 * ones > (edges[block + 1] - edges[block])[:, None]
                out[block] = np.packbits(most, axis=1).view(">u8").ravel()
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(out.view(np.int64))], [*(c for c in part.schema.names if c != "text"), "fp"])


def fingerprints(docs: DataFrame, *extra) -> DataFrame:
    """doc_id, any further columns, and the fingerprint as a signed long ``fp`` of every row."""
    rows = docs.select("doc_id", *extra, F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_prints, f"{kinds}, fp long")


def _gray(x: np.ndarray) -> np.ndarray:
    """Rank of each pattern in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class Index:
    """The hierarchy over the entries of some cells, each cell Gray-sorted. ``root`` numbers entries by component."""

    def __init__(self, cell: np.ndarray, fp: np.ndarray):
        order = np.lexsort((_gray(fp), cell))
        self.fp, cell = fp[order], cell[order]
        self.root = np.arange(len(fp))
        # levels[0] are entries: pattern, mask, first and last child; a node never spans two cells
        self.levels = [(self.fp, np.full(len(fp), ~np.uint64(0)), None, None)]
        while len(cell) > 1 and (cell[1:] == cell[:-1]).any():
            pattern, mask = self.levels[-1][:2]
            begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            rank = np.arange(len(cell)) - np.repeat(begins, np.diff(np.append(begins, len(cell))))
            heads = np.flatnonzero(rank % FAN == 0)
            sure = np.bitwise_and.reduceat(pattern & mask, heads)  # ones shared by all
            none = np.bitwise_and.reduceat(~pattern & mask, heads)  # zeros shared by all
            self.levels.append((sure, sure | none, heads, np.append(heads[1:], len(cell))))
            cell = cell[heads]

    def join(self, most: int) -> None:
        """Unite all entries of a cell that differ in at most ``most`` bits."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        work = [(top, np.arange(n), np.arange(n))]
        while work:
            level, left, right = work.pop()
            if len(left) > _FRONT:
                half = len(left) // 2
                work += [(level, left[:half], right[:half]), (level, left[half:], right[half:])]
                continue
            pattern, mask = self.levels[level][:2]
            near = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right]) <= most
            left, right = left[near], right[near]
            if level == 0:
                self._unite(left, right)
                continue
            if level == 1:  # nodes whose entries are all united already hold no news
                low, high = self._reach()
                news = (low[left] != high[left]) | (low[right] != high[right]) | (low[left] != low[right])
                left, right = left[news], right[news]
            for half in np.array_split(np.arange(len(left)), max(1, len(left) // (_FRONT // FAN**2))):
                if len(half):
                    work.append((level - 1, *self._below(level, left[half], right[half])))

    def _reach(self) -> tuple[np.ndarray, np.ndarray]:
        heads = self.levels[1][2]
        return np.minimum.reduceat(self.root, heads), np.maximum.reduceat(self.root, heads)

    def _below(self, level: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of each pair of nodes, once."""
        _, _, first, end = self.levels[level]
        wide, deep = end[left] - first[left], end[right] - first[right]
        pair = np.repeat(np.arange(len(left)), wide * deep)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(wide * deep) - wide * deep, wide * deep)
        a, c = first[left[pair]] + at // deep[pair], first[right[pair]] + at % deep[pair]
        once = a <= c if level > 1 else a < c
        return a[once], c[once]

    def _unite(self, left: np.ndarray, right: np.ndarray) -> None:
        root = self.root
        while len(left):
            a, c = root[left], root[right]
            low, high = np.minimum(a, c), np.maximum(a, c)
            apart = low != high
            if not apart.any():
                return
            left, right, low, high = left[apart], right[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root[:] = root[root]


def _cells(batches) -> Iterator[pa.RecordBatch]:
    """Links found among the cells of one partition: each entry and the first of its component there."""
    got = [x for x in batches if x.num_rows]
    if not got:
        return
    cell, fp = (np.concatenate([np.asarray(x.column(c)) for x in got]) for c in ("cell", "fp"))
    _, cell, n = np.unique(cell, return_inverse=True, return_counts=True)
    shared = n[cell] > 1
    index = Index(cell[shared], fp[shared].astype(np.int64).view(np.uint64))
    if len(index.fp):
        index.join(BITS)
    own = np.flatnonzero(index.root != np.arange(len(index.root)))
    yield pa.RecordBatch.from_arrays([pa.array(index.fp[own].view(np.int64)), pa.array(index.fp[index.root[own]].view(np.int64))], ["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect exactly what links at up to BITS bits connect."""
    def run(i: int):
        return F.shiftrightunsigned("fp", RUNS[i]).bitwiseAND(F.lit((1 << (RUNS[i + 1] - RUNS[i])) - 1))

    keys = [(F.shiftleft(F.lit(t).cast("long"), 32) + F.shiftleft(run(i), 11) + run(j)).alias("cell") for t, (i, j) in enumerate(PAIRS)]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("cell"))
    return dealt.repartition(F.col("cell")).mapInArrow(_cells, "u long, v long")


def _classed(docs: DataFrame, *extra) -> DataFrame:
    """doc_id, the further columns, fp, root (one fingerprint that names the component) and component_id of every row."""
    rows = keep(fingerprints(docs, *extra))
    own = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(own.select("fp")))
    classes = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classes.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row."""
    return _classed(docs).drop("root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the smallest (doc_id, text hash), null ids last, once.

    Rows are told apart by hashes of doc_id and of the text, so repeated rows leave one.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    a, c = spare(docs, "_id", "_text")
    found = _classed(docs, text.alias("_text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_text")).alias("k")
    chosen = found.groupBy("root").agg(first).select(F.xxhash64("k.doc_id").alias(a), F.col("k._text").alias(c))
    rows = docs.withColumns({a: F.xxhash64("doc_id"), c: text})
    return rows.join(chosen, [a, c], "left_semi").dropDuplicates([a, c]).select(*docs.columns)
