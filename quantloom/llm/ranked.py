"""Ranked lexical search: MaxScore with bounds of term pairs.

The index has one row a document: its number of terms, and the query terms in it with their counts (all terms, if the items use
all). Items are searched in blocks of about BLOCK terms, so what a task is sent does not grow with the items. Every block's
search passes over the index twice. The first pass makes the pair lists: the terms of an item, by rising weight, are taken two by two,
and for each pair the documents that hold both are intersected to get the list's length and its joint maximum impact; the
documents in the lists of an item's heaviest pairs are scored, and the TOP-th best of them is the item's first threshold. The second pass
ranks. For each item the lightest pairs whose bounds sum up to less than the threshold are not essential: a document that
holds none of the other terms can't reach it and is skipped unseen. The bound of a pair is its joint maximum where it stands for
both terms, never the sum of two maxima from different documents, so more lists are skipped than with terms alone. What is left is scored by
its essential terms, dropped if these and the bound of the rest are below the threshold, and else scored in full. A task raises its
thresholds as it goes and hands on TOP documents an item at most; the best of all tasks are the result. All arithmetic of
scores is exact in 64 bits.

Equal items (id and text) are one; items of equal ids and different texts are ranked each on its own under that id. A null item_id
stays null. Null and empty texts have no terms: such documents are never returned, such items return nothing. Null doc_ids come last
among equal scores. Repeated rows are ranked one by one. Empty tables give an empty result; other columns are never read.
Terms are told apart by 64-bit hashes. One item is held whole; a text of n bytes takes about 40 n bytes while it is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import batches as b
from quantloom.llm.bits import bit_field, passes
from quantloom.llm.store import keep

TOP = 20
#: Terms of the items in a block, on average, and impacts that a task holds at once.
BLOCK, _CELLS = 16_384, 1 << 22
#: The heaviest pairs of an item whose lists give the first threshold.
_SEEDS = 3
_LAST = np.iinfo(np.int64).max


def _bags(texts: b.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every different term of a text, and the number of all terms by row."""
    low = texts.lower()
    starts, ends = low.words(b.ALNUM)
    h, row = low.hashes(starts, ends), low.row_of(starts)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.append(new, len(h))), np.bincount(row, minlength=texts.n)


def _listed(field: np.ndarray | None):
    """n, terms and counts in place of the text; with a bit field, only the terms that pass it are listed."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, texts in b.pieces(batches, "text"):
            row, term, count, n = _bags(texts)
            if field is not None:
                row, term, count = (x[passes(field, term)] for x in (row, term, count))
            edges = b.borders(row, texts.n)
            others = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(n.astype(np.int64)), b.lists(term.view(np.int64), edges, pa.int64()), b.lists(count, edges, pa.int32())], [*others, "n", "terms", "counts"])

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, item (the item's name), terms and counts of every different item that has terms."""
    text = F.coalesce("text", F.lit(""))
    rows = items.select("item_id", F.xxhash64("item_id", text).alias("item"), text.alias("text")).dropDuplicates(["item"])
    kind = items.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(_listed(None), f"item_id {kind}, item long, n long, terms array<long>, counts array<int>").where("n > 0").drop("n")


def index_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, n, terms and counts of every row: which of ``terms(term)`` (and a few others) it holds, and how often."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_listed(bit_field(terms)), "doc_id long, n long, terms array<long>, counts array<int>")


class Block:
    """The items that are searched together, as a task gets them."""

    def __init__(self, items, df: dict[int, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.terms = np.array(sorted(df), np.int64)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in self.terms.tolist()], np.int64)
        self.names, self.own, self.times = [], [], []
        for name, terms, counts in items:
            terms, counts = np.array(terms, np.int64), np.array(counts, np.int64)
            known = np.isin(terms, self.terms)
            at = np.searchsorted(self.terms, terms[known])
            order = np.lexsort((at, self.weight[at]))
            self.names.append(name)
            self.own.append(at[order])
            self.times.append(counts[known][order])
        two = [x[: len(x) // 2 * 2].reshape(-1, 2) for x in self.own]
        self.pairs, back = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *two]), axis=0, return_inverse=True)
        self.pair_of = np.split(back.ravel(), np.cumsum([len(x) for x in two])[:-1]) if two else []
        self.floor = np.zeros(len(self.names), np.int64)

    def chunks(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some documents and their impacts, a row for each term; null ids are the largest number."""
        step = max(1, _CELLS // max(1, len(self.terms)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                n = np.asarray(part.column("n"))
                terms, counts = (np.asarray(part.column(c).flatten()) for c in ("terms", "counts"))
                doc = np.repeat(np.arange(part.num_rows), np.asarray(part.column("terms").value_lengths()))
                at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
                known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
                doc, at, tf = doc[known], at[known], counts[known].astype(np.int64)
                damp = 75 + 25 * n * self.n_docs // self.n_terms
                impact = np.zeros((len(self.terms), part.num_rows), np.int64)
                impact[at, doc] = self.weight[at] * (1_000_000_000 * tf // (1000 * tf + 12 * damp[doc]))
                yield np.asarray(part.column("doc_id").fill_null(_LAST)), impact

    def bounds(self, single: np.ndarray, joint: np.ndarray) -> None:
        """Take the maxima of terms and pairs over all documents, and bound for each item what its lightest pairs can add."""
        self.below = []
        for own, times, pairs in zip(self.own, self.times, self.pair_of):
            alone = single[own] * times
            left, right = alone[: 2 * len(pairs) : 2], alone[1 : 2 * len(pairs) : 2]
            x, y = times[: 2 * len(pairs) : 2], times[1 : 2 * len(pairs) : 2]
            shared = np.minimum(x, y)
            both = shared * joint[pairs] + (x - shared) * single[own[: 2 * len(pairs) : 2]] + (y - shared) * single[own[1 : 2 * len(pairs) : 2]]
            steps = np.maximum(both * (joint[pairs] > 0), np.maximum(left, right))
            # below[k]: the most that the k lightest terms add together
            sums = np.concatenate([[0], np.cumsum(steps)])
            below = np.zeros(len(own) + 1, np.int64)
            below[: 2 * len(pairs) + 1 : 2] = sums
            below[1::2] = (sums[: len(below[1::2])]) + alone[::2]
            self.below.append(below)


class Best:
    """The best documents of each item so far, in one task."""

    def __init__(self, block: Block):
        self.floor = block.floor.copy()
        self.ids = [np.zeros(0, np.int64) for _ in block.names]
        self.scores = [np.zeros(0, np.int64) for _ in block.names]

    def add(self, k: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.floor[k])
        if not good.any():
            return
        ids, scores = np.concatenate([self.ids[k], ids[good]]), np.concatenate([self.scores[k], scores[good]])
        order = np.lexsort((ids, -scores))[:TOP]
        self.ids[k], self.scores[k] = ids[order], scores[order]
        if len(order) == TOP:
            self.floor[k] = max(self.floor[k], scores[order[-1]])


def _lists(block: Block):
    """The pass that makes the pair lists: (kind, k, n, most). kind 0: a term, 1: a pair, with its documents and its largest impact; 2: an item's score."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        single, joint = np.zeros(len(block.terms), np.int64), np.zeros(len(block.pairs), np.int64)
        held, met = np.zeros_like(single), np.zeros_like(joint)
        best = Best(block)
        for ids, impact in block.chunks(batches):
            single = np.maximum(single, impact.max(1, initial=0))
            held += (impact > 0).sum(1)
            for some in np.array_split(np.arange(len(joint)), max(1, len(joint) * len(ids) // _CELLS)):
                x, y = impact[block.pairs[some, 0]], impact[block.pairs[some, 1]]
                both = (x > 0) & (y > 0)
                joint[some] = np.maximum(joint[some], ((x + y) * both).max(1, initial=0))
                met[some] += both.sum(1)
            for k, (own, times, pairs) in enumerate(zip(block.own, block.times, block.pair_of)):
                heavy = block.pairs[pairs[-_SEEDS:]]
                there = ((impact[heavy[:, 0]] > 0) & (impact[heavy[:, 1]] > 0)).any(0) if len(heavy) else impact[own].any(0)
                at = np.flatnonzero(there)
                if len(at):
                    best.add(k, ids[at], times @ impact[own][:, at])
        seeds = [(2, k, 1, x) for k, scores in enumerate(best.scores) for x in scores.tolist()]
        told = [(0, i, n, m) for i, (n, m) in enumerate(zip(held.tolist(), single.tolist())) if n] + [(1, i, n, m) for i, (n, m) in enumerate(zip(met.tolist(), joint.tolist())) if n] + seeds
        columns = zip(*told) if told else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["kind", "k", "n", "most"])

    return run


def _ranked(block: Block):
    """The pass that ranks: at most TOP documents of each item."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        best = Best(block)
        for ids, impact in block.chunks(batches):
            there = impact > 0
            for k, (own, times, below) in enumerate(zip(block.own, block.times, block.below)):
                light = int(np.searchsorted(below, best.floor[k], "left")) - 1 if best.floor[k] > 0 else 0
                light = min(max(0, light), len(own))
                at = np.flatnonzero(there[own[light:]].any(0))
                if not len(at):
                    continue
                part = times[light:] @ impact[own[light:]][:, at]
                able = part + below[light] >= best.floor[k]
                at, part = at[able], part[able]
                if light and len(at):
                    part = part + times[:light] @ impact[own[:light]][:, at]
                best.add(k, ids[at], part)
        rows = [(name, *row) for name, *each in zip(block.names, best.ids, best.scores) for row in zip(*(x.tolist() for x in each))]
        columns = list(zip(*rows)) if rows else [[]] * 3
        ids = [None if x == _LAST else x for x in columns[1]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (columns[0], ids, columns[2])], ["item", "doc_id", "score"])

    return run


def pair_lists(index: DataFrame, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Largest impact of each term and of each pair over all documents; sets the block's first thresholds."""
    told = keep(index.mapInArrow(_lists(block), "kind long, k long, n long, most long"))
    single, joint = np.zeros(len(block.terms), np.int64), np.zeros(len(block.pairs), np.int64)
    for kind, k, most in told.where("kind < 2").groupBy("kind", "k").agg(F.max("most").alias("most")).collect():
        (joint if kind else single)[k] = most
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("most")))
    for k, most in told.where("kind = 2").withColumn("place", place).where(F.col("place") == TOP).select("k", "most").collect():
        block.floor[k] = most
    return single, joint


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the TOP best documents of every item."""
    queries = keep(item_terms(items))
    terms = queries.select(F.explode("terms").alias("term")).distinct()
    index = keep(index_of(docs, terms))
    n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = keep(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    total = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n_blocks = -(-total // BLOCK)
    dealt = queries.withColumn("block", F.pmod("item", F.lit(max(1, n_blocks))))
    found = []
    for k in range(n_blocks if n_terms else 0):
        own = dealt.where(F.col("block") == k)
        df = dict(own.select(F.explode("terms").alias("term")).distinct().join(often, "term").select("term", "df").collect())
        if df:
            block = Block([tuple(r) for r in own.select("item", "terms", "counts").collect()], df, n_docs, n_terms)
            block.bounds(*pair_lists(index, block))
            found.append(keep(index.mapInArrow(_ranked(block), "item long, doc_id long, score long")))
    if not found:
        none = queries.sparkSession.createDataFrame([], "item long, doc_id long, score long")
        found.append(none)
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return best.join(queries.select("item_id", "item"), "item").select("item_id", "rank", "doc_id", "score")
