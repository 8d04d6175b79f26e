"""Quality rules: a calibrated logistic regression over hashed word and character n-grams, beside fixed base rules.

A null text counts as empty and has no words, so the base rules reject it. Empty tables give empty results. Rows are
scored one by one: repeated rows and ids get equal scores, null ids are scored too. Without labelled rows of both classes
the model is a constant, the smoothed share of good rows. Only the named columns are read, whatever else a table holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm import batches as b
from quantloom.llm.labelled import sample
from quantloom.llm.structure import Structure

#: Hash slots of word n-grams and of character n-grams; gram lengths; least probability that a kept row has.
SLOTS, WORD_GRAMS, CHAR_GRAMS, LEAST = 1 << 15, (1, 2), (3,), 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Labelled rows the model is fitted on at most; their n-gram counts are all that the driver receives.
SAMPLE = 2048
_SCALE = 30.0


def grams(texts: b.Texts, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, row) of every word n-gram, then of every character n-gram; ``words``, ``row``: hash and row of each word."""
    found = []
    for k in WORD_GRAMS:
        n = max(0, len(words) - k + 1)
        at = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
        found.append(((b.chain(words, k)[at] % np.uint64(SLOTS)).astype(np.int32), row[at]))
    yield _joined(found)
    chars = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(texts.n), texts.count((texts.data & 0xC0) != 0x80))
    found = []
    for k in CHAR_GRAMS:
        n = max(0, len(chars) - k + 1)
        at = np.flatnonzero(owner[:n] == owner[k - 1 : k - 1 + n])
        found.append(((b.chain(chars, k)[at] % np.uint64(SLOTS)).astype(np.int32) + SLOTS, owner[at]))
    yield _joined(found)


def _joined(found):
    if len(found) == 1:
        return found[0]
    slot, row = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(row, kind="stable")
    return slot[order], row[order]


class Model:
    """Weights by slot; the logit is a calibrated linear function of the mean weights of both kinds of grams."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights, slope, shift

    def score(self, texts: b.Texts, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        total = np.zeros(texts.n)
        for slot, owner in grams(texts, words, row):
            edges = b.borders(owner, texts.n)
            total += _SCALE * b.sums(self.weights[slot], edges) / np.maximum(np.diff(edges), 1)
        return _logistic(self.slope * total + self.shift)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in b.pieces(batches, "text"):
        s = Structure(texts)
        slots, values, edges = [[] for _ in range(texts.n)], [[] for _ in range(texts.n)], [0]
        for slot, owner in grams(texts, s.hash, s.row):
            at = b.borders(owner, texts.n)
            for i in range(texts.n):
                kinds, n = np.unique(slot[at[i] : at[i + 1]], return_counts=True)
                slots[i].append(kinds)
                values[i].append(_SCALE * n / max(1, at[i + 1] - at[i]))
        slots, values = [np.concatenate(x) for x in slots], [np.concatenate(x) for x in values]
        edges = np.cumsum([0, *map(len, slots)])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("y"), b.lists(np.concatenate(slots), edges, pa.int32()), b.lists(np.concatenate(values), edges, pa.float32())],
            ["doc_id", "y", "slots", "vals"],
        )


def gather(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """y, row borders, slots and values of a bounded sample, by doc_id."""
    got = rows.toArrow().sort_by("doc_id").combine_chunks()
    slots, values = (got.column(c).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("slots", "vals"))
    return (
        got.column("y").to_numpy().astype(float),
        np.concatenate([[0], np.cumsum(np.asarray(slots.value_lengths().to_numpy(zero_copy_only=False), np.int64))]),
        slots.flatten().to_numpy(zero_copy_only=False),
        values.flatten().to_numpy(zero_copy_only=False).astype(np.float32),
    )


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = SAMPLE, text: str = "text", steps: int = 120) -> Model:
    """Fit on three quarters of a sample of at most ``bound`` rows; the fourth quarter calibrates the probabilities."""
    rows = sample(docs, labels, target, text, bound).mapInArrow(_features, "doc_id long, y int, slots array<int>, vals array<float>")
    y, edges, slots, values = gather(rows)
    rate = (y.sum() + 1) / (len(y) + 2)
    flat = Model(np.zeros(2 * SLOTS), 0.0, float(np.log(rate / (1 - rate))))
    learn = np.arange(len(y)) % 4 != 3
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        return flat
    owner = np.repeat(np.arange(len(y)), np.diff(edges))
    weights, first, second = np.zeros(2 * SLOTS), np.zeros(2 * SLOTS), np.zeros(2 * SLOTS)
    raw, shift = np.zeros(len(y)), np.log(rate / (1 - rate))
    for step in range(1, steps + 1):
        error = np.where(learn, _logistic(raw + shift) - y, 0) / learn.sum()
        slope = np.bincount(slots, values * error[owner], minlength=2 * SLOTS) + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        raw = b.sums(weights[slots] * values, edges)
    return Model(weights.astype(np.float32), *_calibrate(raw[~learn], y[~learn]))


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-back scores, by damped Newton steps on smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    aim = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * raw + c)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - aim) * raw).sum(), (p - aim).sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    return max(float(a), 0.0), float(c)


def judge(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST) -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good and kept.

    The columns of ``docs`` stay in front, but for those that bear a name of the eight.
    """
    made = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "p_good": "double", "kept": "boolean"}
    own = [f for f in docs.schema if f.name not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), *(f"{k} {v}" for k, v in made.items())])

    def run(batches):
        for part, texts in b.pieces(batches, text):
            s = Structure(texts)
            failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEAT_PERCENT * s.n_words)
            good = model.score(texts, s.hash, s.row)
            new = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, good, ~failed & (good >= least)]
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, new)], [*part.schema.names, *made])

    return docs.select(*[f"`{f.name}`" for f in own]).mapInArrow(run, schema)
