"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

The score is logistic(bias + sum w x + (|sum V x|^2 - sum |V x|^2) / 2), linear in the number of words. Inputs are the
share of each hashed word, bins of the structure figures, and a bin of the stored length; never labels, lang, source or
doc_id. Null and empty texts get the score that their empty structure earns. Repeated rows score equally, null ids are
scored and counted as the text 'null' by the fold rule. Without labels of both classes every row gets the smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import batches as b
from quantloom.llm.labelled import SAMPLE, held_out, sample
from quantloom.llm.quality import _logistic, gather
from quantloom.llm.structure import Structure

WORDS, BINS, RANK, LEAST = 1 << 14, 16, 8, 0.3
#: Upper ends of the bins of every structure figure, fixed so that a score never depends on other rows.
CUTS = {
    "words": np.arange(1, 16),
    "word_length": np.arange(1.5, 16.5),
    "symbols": np.geomspace(0.002, 2, 15),
    "upper": np.geomspace(0.005, 0.9, 15),
    "digits": np.geomspace(0.002, 0.5, 15),
    "points": np.geomspace(0.01, 2, 15),
    "marks": np.geomspace(0.005, 2, 15),
    "kinds": np.linspace(0.06, 0.97, 15),
    "dup_lines": np.geomspace(0.005, 0.95, 15),
    "repeats": np.geomspace(0.005, 0.95, 15),
    "n_chars": np.geomspace(20, 100_000, 15),
}
DIMS = WORDS + BINS * len(CUTS)


def features(texts: b.Texts, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and row borders; equal words of a row are one entry."""
    s = Structure(texts)
    key = (s.row * WORDS + (s.hash % np.uint64(WORDS)).astype(np.int64))
    key, n = np.unique(key, return_counts=True)
    row, slot = key // WORDS, key % WORDS
    value = 3 * n / np.maximum(s.n_words, 1)[row]
    figures = s.shares() | {"n_chars": stored}
    rows, slots = [row], [slot]
    for i, (name, cuts) in enumerate(CUTS.items()):
        rows.append(np.arange(texts.n))
        slots.append(WORDS + BINS * i + np.searchsorted(cuts, figures[name]))
    row, slot = np.concatenate(rows), np.concatenate(slots)
    value = np.concatenate([value, np.full(len(row) - len(value), 0.3)])
    order = np.argsort(row, kind="stable")
    return slot[order].astype(np.int32), value[order].astype(np.float32), b.borders(row[order], texts.n)


def _stored(part: pa.RecordBatch) -> np.ndarray:
    return np.nan_to_num(np.asarray(part.column("n_chars").to_numpy(zero_copy_only=False), float))


class Machine:
    """Bias, one weight and one vector of RANK entries per slot."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def logits(self, slots: np.ndarray, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        scaled = self.vectors[slots] * values[:, None]
        pulled = b.sums(scaled, edges)
        own = b.sums((scaled**2).sum(1), edges)
        return self.bias + b.sums(self.weights[slots] * values, edges) + ((pulled**2).sum(1) - own) / 2


def _pairs(batches) -> Iterator[pa.RecordBatch]:
    for part, texts in b.pieces(batches, "text"):
        slots, values, edges = features(texts, _stored(part))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), b.lists(slots, edges, pa.int32()), b.lists(values, edges, pa.float32())], ["doc_id", "y", "slots", "vals"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = SAMPLE, epochs: int = 12, block: int = 64) -> Machine:
    """Fit on at most ``bound`` labelled rows outside the held-out fold, by block-wise steps scaled by past gradients."""
    rows = sample(docs, labels, target, "text", bound, ("n_chars",)).mapInArrow(_pairs, "doc_id long, y int, slots array<int>, vals array<float>")
    y, edges, slots, values = gather(rows)
    rate = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(DIMS), np.zeros((DIMS, RANK)))
    if len(set(y)) < 2:
        return m
    draw = np.random.default_rng(7)
    m.vectors = draw.normal(0, 0.05, (DIMS, RANK))
    past_w, past_v, past_b = np.full(DIMS, 1e-6), np.full((DIMS, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        for at in np.array_split(order := draw.permutation(len(y)), max(1, len(order) // block)):
            pick = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in at])
            cut = np.concatenate([[0], np.cumsum(edges[at + 1] - edges[at])])
            s, x = slots[pick], values[pick].astype(float)
            error = (_logistic(m.logits(s, x, cut)) - y[at]) / len(at)
            own = np.repeat(np.arange(len(at)), np.diff(cut))
            pulled = b.sums(m.vectors[s] * x[:, None], cut)
            seen, back = np.unique(s, return_inverse=True)
            gw = np.bincount(back, error[own] * x, minlength=len(seen)) + 1e-6 * m.weights[seen]
            each = (error[own] * x)[:, None] * (pulled[own] - m.vectors[s] * x[:, None])
            gv = np.stack([np.bincount(back, each[:, f], minlength=len(seen)) for f in range(RANK)], 1) + 1e-5 * m.vectors[seen]
            past_w[seen] += gw**2
            past_v[seen] += gv**2
            past_b += error.sum() ** 2
            m.weights[seen] -= 0.1 * gw / np.sqrt(past_w[seen])
            m.vectors[seen] -= 0.03 * gv / np.sqrt(past_v[seen])
            m.bias -= 0.05 * error.sum() / np.sqrt(past_b)
    m.weights, m.vectors = m.weights.astype(np.float32), m.vectors.astype(np.float32)
    return m


def score(docs: DataFrame, m: Machine, least: float = LEAST) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; ``docs`` holds doc_id, text and n_chars."""

    def run(batches):
        for part, texts in b.pieces(batches, "text"):
            p = _logistic(m.logits(*features(texts, _stored(part))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"), held_out(F.col("doc_id")).alias("held_out"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
