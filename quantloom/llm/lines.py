"""Fuzzy line dedup by MinHash.

Lines with anything but white space are judged, however short. Equal lines are one entry. An entry's shingles are its runs of ``SHINGLE``
characters at every position, or the whole of a shorter line; its signature is one minimum for each of HASHES orders of their hashes, and each band
is three of these, shared with no other band. A candidate pair links when the Jaccard similarity of the shingle sets is at least
``ALIKE``. First, entries of a bucket are candidates with the bucket's smallest entry, in an order of the bucket's own. Then, in buckets that
still hold several components, the entries outside the bucket's largest one are candidates with the entries of other components, unless
bitmaps of their shingle sets differ in more places than those of alike lines can. Of each
connected component, and of each set of equal lines, the first line stays, by doc_id, then text hash, then line number.

Signatures and similarities are made in Arrow batches: SQL functions would work on each position of each text one by one.
Only lines that are candidates are read again for the exact comparison, picked by a bit field of fixed size.

A null text is an empty text: one blank line, which is not judged. Null ids come last. Rows equal in id and text
lose and keep the same lines. Lines are named by a 64-bit hash. An empty table gives an empty result; other columns stay
as they are in ``without_duplicates`` and are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quantloom.llm import batches as b
from quantloom.llm.bits import only_in
from quantloom.llm.graph import components
from quantloom.llm.minhash import of_several, parities
from quantloom.llm.store import exchange_parts, keep, spare

SHINGLE, ALIKE, HASHES, BITS = 16, 0.8, 24, 4096
#: Each band is three orders of its own.
BANDS = np.arange(HASHES).reshape(-1, 3)
_ORDERS = b.mix(np.arange(1, HASHES + 1).astype(np.uint64)) | np.uint64(1)
#: Bytes of lines that are signed at once, and pairs that are compared at once: as many as a byte can name.
_BYTES, _PAIRS = 1 << 17, 256


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def judged_lines(docs: DataFrame) -> DataFrame:
    """doc_id, b (hash of the text), at (line number from 0), line and id of every line that is not blank."""
    lines = docs.select("doc_id", F.xxhash64(_text()).alias("b"), F.posexplode(F.split(_text(), "\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike(r"\S")).withColumn("id", F.xxhash64("line"))


def shingles(lines: b.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every line, and the borders between lines; an empty line has one empty shingle."""
    lead = (lines.data & 0xC0) != 0x80
    chars = np.append(np.flatnonzero(lead), len(lines.data))
    seen = np.concatenate([[0], np.cumsum(lead)])
    first, last = seen[lines.offs[:-1]], seen[lines.offs[1:]]
    n = np.maximum(last - first - SHINGLE + 1, 1)
    edges = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(edges[-1]) - np.repeat(edges[:-1] - first, n)
    return lines.hashes(chars[place], chars[np.minimum(place + SHINGLE, np.repeat(last, n))]), edges


def _signed(batches) -> Iterator[pa.RecordBatch]:
    """The keys of all bands in place of the line."""
    for part, lines in b.pieces(batches, "line", _BYTES):
        h, edges = shingles(lines)
        least = np.stack([np.minimum.reduceat(h * k, edges[:-1]) for k in _ORDERS])
        keys = np.stack([b.mix(b.chain_rows(least[band]) + np.uint64(i)) for i, band in enumerate(BANDS)], 1)
        keys = b.lists(keys.ravel().view(np.int64), np.arange(lines.n + 1) * len(BANDS), pa.int64())
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "doc_id", "b", "at")), keys], ["id", "doc_id", "b", "at", "keys"])


def _sets(lines: b.Texts) -> np.ndarray:
    """The different shingles of up to _PAIRS lines, sorted: the line's number in the upper byte, 56 bits of the hash below."""
    h, edges = shingles(lines)
    return np.unique(np.repeat(np.arange(lines.n, dtype=np.uint64) << np.uint64(56), np.diff(edges)) | h >> np.uint64(8))


def _alike(batches) -> Iterator[pa.RecordBatch]:
    """The pairs whose lines have a Jaccard similarity of at least ALIKE."""
    for batch in batches:
        for i in range(0, batch.num_rows, _PAIRS):
            part = batch.slice(i, _PAIRS)
            x, y = (_sets(b.Texts.of(part.column(c))) for c in ("u_line", "v_line"))
            each, common = (np.bincount((v >> np.uint64(56)).astype(np.int64), minlength=part.num_rows) for v in (np.concatenate([x, y]), np.intersect1d(x, y, assume_unique=True)))
            near = pa.array(common >= ALIKE * (each - common))
            yield pa.RecordBatch.from_arrays([part.column(c).filter(near) for c in ("u", "v")], ["u", "v"])


def _mapped(batches) -> Iterator[pa.RecordBatch]:
    """The number of different shingles of every line and their bitmap, in place of the line."""
    for part, lines in b.pieces(batches, "line", _BYTES):
        h, edges = shingles(lines)
        each = [np.unique(h[i:j]) for i, j in zip(edges, edges[1:])]
        size = np.array([len(x) for x in each], np.int64)
        bits = parities(np.concatenate(each), np.concatenate([[0], np.cumsum(size)]), BITS)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), b.lists(bits.ravel(), np.arange(lines.n + 1) * bits.shape[1], pa.int64())], ["id", "size", "bits"])


def line_kinds(docs: DataFrame) -> DataFrame:
    """id, n, first (place of the first such line) and keys (bands) of every different line."""
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "b", "at")
    lines = judged_lines(docs).select("id", "doc_id", "b", "at", "line")
    signed = lines.mapInArrow(_signed, StructType(lines.drop("line").schema.fields).add("keys", ArrayType(LongType())))
    return signed.groupBy("id").agg(F.count("*").alias("n"), F.min(first).alias("first"), F.first("keys").alias("keys"))


def _lines_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and line of every line whose id is in column ``term``, and of a few others."""
    return only_in(judged_lines(docs).select("id", "line"), "id", ids).groupBy("id").agg(F.min("line").alias("line"))


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates (u, v) that are alike."""
    found = _lines_of(docs, pairs.select(F.explode(F.array("u", "v")).alias("term")))
    left, right = (found.select(F.col("id").alias(c), F.col("line").alias(f"{c}_line")) for c in "uv")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "u_line", "v_line")
    return both.mapInArrow(_alike, "u long, v long")


def _pairs(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("u"), F.greatest(left, right).alias("v")]


def similar_lines(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Edges (u, v) between ids of different lines that are alike, enough of them to connect all that are linked."""
    dealt = kinds.select("id", F.explode("keys").alias("key"))
    mask = F.xxhash64("key")
    ends = dealt.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("low"), F.count("*").alias("n")).where("n > 1")
    met = keep(dealt.join(ends, "key").select("key", "id", F.col("low").bitwiseXOR(mask).alias("low"), "n"))
    edges = keep(_linked(docs, keep(met.where("id <> low").select(*_pairs("id", "low")).distinct())))
    roots = keep(components(edges))
    rooted = met.where("n > 2").join(roots, met["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    lists = keep(of_several(rooted))
    sets = keep(_lines_of(docs, lists.select(F.col("id").alias("term")).distinct()).mapInArrow(_mapped, "id long, size long, bits array<long>"))
    return edges.union(_linked(docs, keep(_outside(lists, sets))))


def _outside(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v), once: entries of different components in one bucket, one of them not at home, whose bitmaps allow them to be alike.

    A pair is listed in the first bucket that both are in. Unlike pairs mostly fall by their sizes or the first part of their bitmaps.
    """
    own = lists.groupBy("id").agg(F.collect_set("key").alias("keys"))
    still = keep(lists.join(keep(sets.join(own, "id")), "id"))
    other = still.select("key", *[F.col(c).alias(f"{c}_") for c in ("id", "root", "size", "bits", "keys")])
    total, percent = F.col("size") + F.col("size_"), round(100 * ALIKE)
    most = total - 2 * F.floor((percent * total + 99 + percent) / F.lit(100 + percent))
    near = percent * F.greatest("size", "size_") <= 100 * F.least("size", "size_")
    bit = lambda i: F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_", F.lit(i))))
    part = sum((bit(i) for i in range(1, 8)), bit(0))
    # over the arrays, not written out: code of 64 terms is too long to be compiled by the JVM
    whole = F.aggregate(F.zip_with("bits", "bits_", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    once = (F.col("root") != F.col("root_")) & ((F.col("root_") == F.col("home")) | (F.col("id") < F.col("id_")))
    first = F.array_min(F.array_intersect("keys", "keys_")) == F.col("s.key")
    met = still.where("root <> home").alias("s").join(other.alias("t"), (F.col("s.key") == F.col("t.key")) & once & near & (part <= most) & (whole <= most) & first)
    # a skewed join is split into many tasks with few pairs each; they are written in as many parts as any other exchange has
    return met.select(*_pairs("id", "id_")).coalesce(exchange_parts(met))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, b, removed): ascending numbers of the lines that fall, for rows that lose any."""
    kinds = keep(line_kinds(docs))
    roots = components(similar_lines(docs, kinds))
    classes = kinds.join(roots, kinds["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"), "n", "first")
    kept = classes.groupBy("root").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    where = classes.select("id", "root").join(kept, "root").select("id", F.col("first").alias("kept"))
    lines = judged_lines(docs).select("doc_id", "b", "at", "id")
    fall = lines.join(where, "id").where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("b") == F.col("kept.b")) & (F.col("at") == F.col("kept.at"))))
    return fall.groupBy("doc_id", "b").agg(F.array_sort(F.collect_set("at")).alias("removed"))


def _marked(docs: DataFrame, removed: str, *columns) -> DataFrame:
    """The given columns of every row, and in ``removed`` the numbers of the lines that fall."""
    a, c = spare(docs, f"{removed}_a", f"{removed}_b")
    gone = removed_lines(docs.select("doc_id", "text")).select(F.xxhash64("doc_id").alias(a), F.col("b").alias(c), F.col("removed").alias(removed))
    rows = docs.select(*columns, F.xxhash64("doc_id").alias(a), F.xxhash64(_text()).alias(c))
    return rows.join(gone, [a, c], "left").withColumn(removed, F.coalesce(removed, F.array().cast("array<int>")))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0) of every row."""
    rows = _marked(docs, "_removed", "doc_id", F.size(F.split(_text(), "\n")).cast("long").alias("n_lines"))
    return rows.select("doc_id", "n_lines", F.size("_removed").cast("long").alias("n_removed"), F.col("_removed").alias("removed"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, their columns as they are but for text, which has lost its repeated lines, and n_chars if there."""
    removed, split = spare(docs, "_removed", "_lines")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(removed))
    rows = _marked(docs, removed, *docs.columns).withColumn(split, F.when(F.size(removed) > 0, lines))
    text = F.when(F.col(split).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(split).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)
