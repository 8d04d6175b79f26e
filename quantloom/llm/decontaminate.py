"""Benchmark decontamination: a positional inverted index of the corpus, searched from the rarest words of each phrase.

The index holds, for the words that phrases are searched by, the positions of the word in every document. A phrase takes
the list of its rarest corpus word and intersects it, shifted by the distance of the two words, with that of its second
rarest; what is left is checked word by word (by 64-bit hashes) in the text itself. A phrase with a word that the corpus lacks is not
searched at all. The word filter that tasks receive is a bit field of fixed size, whatever the benchmark's.

Null and empty texts have no words and no hits; an empty benchmark or corpus gives rows without hits, or none. Repeated
rows and null ids are judged row by row: rows are told apart by hashes of doc_id and text. Items of equal text all count.
Null item_ids count as the text 'null'. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import batches as b
from quantloom.llm.bits import bit_field, passes
from quantloom.llm.store import keep, spare

#: Words of a window.
WINDOW = 10


def _words(raw: b.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    texts = raw.lower()
    starts, ends = texts.words(b.ALNUM)
    return texts.hashes(starts, ends), texts.row_of(starts)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, wid, terms): every window of ``size`` consecutive words; a shorter item is one window.

    ``wid`` hashes the words and their number, ``terms`` are the hashes of the words.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, texts in b.pieces(batches, "text"):
            h, row = _words(texts)
            edges = b.borders(row, texts.n)
            of, wid, terms, ends = [], [], [], [0]
            for i in range(texts.n):
                own = h[edges[i] : edges[i + 1]]
                k = min(size, len(own))
                if k:
                    n = len(own) - k + 1
                    of += [i] * n
                    wid.append(named(b.chain(own, k), k))
                    terms += [own[j : j + k] for j in range(n)]
                    ends += [ends[-1] + k * (j + 1) for j in range(n)]
            if of:
                flat = np.concatenate(terms).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(of)), pa.array(np.concatenate(wid).view(np.int64)), b.lists(flat, np.array(ends), pa.int64())], ["item_id", "wid", "terms"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id string, wid long, terms array<long>")


def named(h: np.ndarray, k: int) -> np.ndarray:
    """Window hashes with the number of words in them."""
    return b.mix(h + np.uint64(k))


def frequencies(docs: DataFrame, field: np.ndarray) -> DataFrame:
    """(term, n): how often the filtered words stand in the corpus."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        terms, counts, waiting = [], [], 0
        for _, texts in b.pieces(batches, "text"):
            h, _ = _words(texts)
            kinds, n = np.unique(h[passes(field, h)], return_counts=True)
            terms.append(kinds)
            counts.append(n)
            waiting += len(kinds)
            if waiting > 1 << 20:
                yield total(terms, counts)
                terms, counts, waiting = [], [], 0
        if waiting:
            yield total(terms, counts)

    def total(terms, counts) -> pa.RecordBatch:
        kinds, back = np.unique(np.concatenate(terms), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, field: np.ndarray) -> DataFrame:
    """(term, a, b, at): the ascending word positions ``at`` of each filtered word in the row named by a, b."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, texts in b.pieces(batches, "text"):
            h, row = _words(texts)
            at = np.flatnonzero(passes(field, h))
            place = at - b.borders(row, texts.n)[row[at]]
            order = np.lexsort((place, h[at], row[at]))
            h, row, place = h[at][order], row[at][order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, int)
            own = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), part.column("a").take(own), part.column("b").take(own), b.lists(place, np.append(new, len(h)), pa.int32())], ["term", "a", "b", "at"])

    return docs.mapInArrow(run, "term long, a long, b long, at array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their names a, b (hashes of id and text) and a text that is never null."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id").alias("a"), F.xxhash64(text).alias("b"), text.alias("text"))


def candidates(rows: DataFrame, phrases: DataFrame, slack: int = 0) -> DataFrame:
    """(a, b, start, wid): places where the two rarest words of a phrase stand as far apart as in it.

    ``phrases`` has one row for each ``wid`` with its ``terms``. With ``slack`` the distance may be larger by that many words,
    and ``start`` is where the phrase would begin if nothing stood between.
    """
    words = keep(phrases.select("wid", F.posexplode("terms").alias("place", "term")))
    used = words.select("term").distinct()
    counted = frequencies(rows, bit_field(used)).join(words, "term", "right").select("wid", "place", "term", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = counted.groupBy("wid").agg(F.min("n").alias("least"), F.slice(F.array_sort(F.collect_list(F.struct("n", "place", "term"))), 1, 2).alias("two"))
    search = keep(ranked.where("least > 0").select("wid", F.col("two")[0].alias("x"), F.col("two")[F.size("two") - 1].alias("y")))
    led = search.select(F.col("x.term").alias("term")).union(search.select(F.col("y.term"))).distinct()
    index = keep(postings(rows, bit_field(led)))
    lead = index.join(search, index["term"] == F.col("x.term")).select("a", "b", "wid", "x", "y", F.explode("at").alias("found"))
    lead = lead.select("a", "b", "wid", "x", "y", (F.col("found") - F.col("x.place")).alias("start"), F.col("y.term").alias("term"))
    joined = lead.join(index, ["term", "a", "b"])
    hope = F.col("start") + F.col("y.place")
    if slack:
        gap = lambda p: (p - hope) * F.signum(F.col("y.place") - F.col("x.place")).cast("int")
        return joined.where(F.exists("at", lambda p: gap(p).between(0, slack))).select("a", "b", "start", "wid")
    return joined.where("start >= 0").where(F.array_contains("at", hope)).select("a", "b", "start", "wid")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, a, b, n_words, n_hit and items (sorted distinct item_ids as text) of every row of ``docs``."""
    rows = keyed(docs)
    found = keep(windows(items, size))
    phrases = found.groupBy("wid").agg(F.first("terms").alias("terms"))
    places = candidates(rows, phrases).groupBy("a", "b").agg(F.collect_set(F.struct("start", "wid")).alias("places"))
    checked = keep(rows.join(places, ["a", "b"], "left").mapInArrow(_check(size), "doc_id long, a long, b long, n_words long, n_hit long, wids array<long>"))
    named_items = checked.where("n_hit > 0").select("a", "b", F.explode("wids").alias("wid")).join(found.select("wid", "item_id").distinct(), "wid")
    per_doc = named_items.groupBy("a", "b").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return checked.drop("wids").join(per_doc, ["a", "b"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def _check(size: int):
    """Compare every candidate with the words of the text; count words, covered words and phrases found."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, texts in b.pieces(batches, "text"):
            h, row = _words(texts)
            edges = b.borders(row, texts.n)
            hit, wids, ends = np.zeros(texts.n, np.int64), [], [0]
            places = part.column("places")
            for i in range(texts.n):
                mine = []
                if places[i].is_valid:
                    listed = places[i].values
                    start, wid = listed.field("start").to_numpy().astype(np.int64), listed.field("wid").to_numpy().view(np.uint64)
                    own = h[edges[i] : edges[i + 1]]
                    covered = np.zeros(len(own) + 1, np.int64)
                    for k in range(1, size + 1):
                        if len(own) < k:
                            break
                        # phrases of fewer words than the window are items of their own
                        inside = start + k <= len(own)
                        true = np.zeros(len(start), bool)
                        true[inside] = named(b.chain(own, k), k)[start[inside]] == wid[inside]
                        np.add.at(covered, start[true], 1)
                        np.add.at(covered, start[true] + k, -1)
                        mine.append(wid[true])
                    hit[i] = (np.cumsum(covered[:-1]) > 0).sum()
                mine = np.unique(np.concatenate(mine)) if mine else np.zeros(0, np.uint64)
                wids.append(mine)
                ends.append(ends[-1] + len(mine))
            flat = np.concatenate(wids).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("a"), part.column("b"), pa.array(np.diff(edges)), pa.array(hit), b.lists(flat, np.array(ends), pa.int64())], ["doc_id", "a", "b", "n_words", "n_hit", "wids"])

    return run


def near_phrases(docs: DataFrame, items: DataFrame, slack: int, size: int = WINDOW) -> DataFrame:
    """Proximity matches (doc_id, item_id, start): the words of a window in order, with at most ``slack`` others between them."""
    rows = keyed(docs)
    found = keep(windows(items, size))
    phrases = found.groupBy("wid").agg(F.first("terms").alias("terms"))
    places = candidates(rows, phrases, slack).join(phrases, "wid").groupBy("a", "b").agg(F.collect_set(F.struct("start", "wid", "terms")).alias("places"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part, texts in b.pieces(batches, "text"):
            h, row = _words(texts)
            edges = b.borders(row, texts.n)
            ids, out = [], []
            for i in range(texts.n):
                own = h[edges[i] : edges[i + 1]].view(np.int64)
                for place in part.column("places")[i].as_py():
                    for at in range(max(0, place["start"] - slack), place["start"] + 1):
                        reach, j = own[at : at + len(place["terms"]) + slack], 0
                        for term in place["terms"]:
                            left = np.flatnonzero(reach[j:] == term)
                            j = j + left[0] + 1 if len(left) else -1
                            if j < 0:
                                break
                        if j > 0 and own[at] == place["terms"][0]:
                            ids.append(i)
                            out.append((place["wid"], at))
            wid, at = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(ids, pa.int64())), wid, at], ["doc_id", "wid", "start"])

    matched = rows.join(places, ["a", "b"]).mapInArrow(run, "doc_id long, wid long, start long")
    return matched.join(found.select("wid", "item_id").distinct(), "wid").select("doc_id", "item_id", "start").distinct()


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with their columns."""
    a, c = spare(docs, "_a", "_b")
    bad = contamination(docs.select("doc_id", "text"), items).where("n_hit > 0").select(F.col("a").alias(a), F.col("b").alias(c))
    rows = docs.withColumns({a: F.xxhash64("doc_id"), c: F.xxhash64(F.coalesce("text", F.lit("")))})
    return rows.join(bad, [a, c], "left_anti").select(*docs.columns)
