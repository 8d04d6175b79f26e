"""Spelling variants: words at one edit, found by asymmetric chunks.

The shorter word of a pair (either, if they are equally long) contributes two disjoint chunks, its halves; the other contributes the positional grams that
can hold them. One inserted, deleted or replaced character leaves one chunk whole, shifted by one place at most: a first half begins where the other word
does, a last half ends where it ends. Many words share a half such as an ending, so what is left of the word obeys the same rule once more: one of its
own two halves is whole. The join key holds both, the chunk and that half, and pairs are verified by their edit distance. A key's words
differ only within a quarter of a word.

A word's form is the near word that stands most often (ties: smallest in code-point order) if that is at least twice as
often; roots follow forms by doubling, in as many joins as the logarithm of the longest chain.

Null and empty texts have no words, and an empty table gives none. A null doc_id counts as empty text where words are cut.
Repeated rows count again each time. Words are whole, however long. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import batches as b
from quantloom.llm.store import keep

#: Least code points of a word, least places where it stands, and how much more often a form stands.
LETTERS, PLACES, MORE = 5, 3, 2
#: One word in this many loses a character before it is counted, picked by its crc32.
CUT = 97
#: Different words that a task holds before it hands on their counts.
_HELD = 1 << 18
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: In UTF-8, U+00C0 to U+00FF are the characters of two bytes that begin with this one.
_LATIN = 0xC3


def _counted(cut: int | None):
    def run(batches) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for part, raw in b.pieces(batches, "text"):
            texts = raw.lower()
            lead = texts.data == _LATIN
            inside = _LETTER[texts.data] | lead
            inside[1:] |= lead[:-1]
            starts, ends = texts.runs(inside)
            two = np.concatenate([[0], np.cumsum(lead)])
            length = ends - starts - (two[ends] - two[starts])
            long = length >= LETTERS
            starts, ends, row, body = starts[long], ends[long], texts.row_of(starts[long]), texts.data.tobytes()
            heads = [crc32(f"{i}:".encode()) for i in part.column("name").to_pylist()]
            for i, j, r in zip(starts.tolist(), ends.tolist(), row.tolist()):
                word = body[i:j]
                if cut and (h := crc32(word, heads[r])) % cut == 0:
                    whole = word.decode()
                    at = h % len(whole)
                    if len(whole) == LETTERS:
                        continue
                    word = (whole[:at] + whole[at + 1 :]).encode()
                counts[word] = counts.get(word, 0) + 1
            if len(counts) > _HELD:
                yield told(counts)
                counts = {}
        yield told(counts)

    def told(counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, cut: int | None = CUT, least: int = PLACES) -> DataFrame:
    """(word, n): the words of at least LETTERS letters that stand in ``least`` places; with ``cut``, some have lost a letter."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_counted(cut), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keys(word: Column, size: Column, longer: int) -> Column:
    """Keys of a word as one of ``size`` letters whose halves are chunks: the word itself, or one ``longer`` by so many letters."""
    half = F.floor(size / 2).cast("int")
    first, last = F.floor(half / 2).cast("int"), half + F.floor((size - half) / 2).cast("int")

    def kept(no: int, left: Column, right: Column) -> Column:
        """The letters before ``left`` and those from ``right``, where nothing has changed; the chunk is one of the two or inside."""
        return F.xxhash64(size, F.lit(no), F.substring(word, F.lit(1), left), F.substring(word, right + longer + 1, size + 1))

    zero, end = F.lit(0), size + 1
    return F.array(kept(0, last, end), kept(1, half, last), kept(2, first, half), kept(3, zero, first))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of different words of ``words(word, n)`` at one edit, once."""
    word, size = F.col("word"), F.char_length("word")
    chunks = words.select("word", "n", F.explode(_keys(word, size, 0)).alias("key"))
    grams = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(F.array_union(_keys(word, size, 0), _keys(word, size - 1, 1))).alias("key"))
    turn = (F.char_length("word") < F.char_length("other")) | (F.col("word") < F.col("other"))
    near = F.levenshtein("word", "other", 1) == 1
    pairs = chunks.join(grams, "key").where(turn & near).select("word", "n", "other", "other_n").distinct()
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms(word, form)``; following forms must come to an end."""
    at = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = keep(at.join(step, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return at
        at = moved.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """word, n, form, root, n_near and form_n of every row of ``words(word, n)``."""
    words = keep(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    found = keep(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best))
    form = F.when(-F.col("best.less") >= MORE * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))
    listed = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("f"))
    listed = keep(listed.select("word", "n", "n_near", "f.form", "f.form_n"))
    rooted = roots(listed.where("form is not null"))
    return listed.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))
