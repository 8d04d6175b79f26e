"""MinHash near-duplicates: an inverted join over the coordinates of signatures.

A document's set holds its different shingles of ``SHINGLE`` words; equal sets are one entry. Its signature has one minimum for
each of COORDINATES orders of the shingles' hashes, and the entry is posted under every pair of coordinate and value. Two entries whose sets are at
least ALIKE per cent alike agree on MATCHES coordinates but for a chance of 3e-6, calculated. So a list of only one entry is dropped, each entry's
lists are put in order of length, and only its PREFIX shortest are merged: who agrees on MATCHES coordinates meets in one of them. The
long lists are skipped; what they would have counted is counted by comparing the signatures of each pair that met. Pairs with
MATCHES collisions are confirmed on their full sets.

A list is not merged into all its pairs. First every entry meets the list's leader (smallest in an order of the list's own).
What this links is one component each. In lists that still hold several components, the entries outside the list's largest one meet
the entries of other components. There a parity bitmap of BITS bits stands for each set: where two bitmaps differ, the sets do, so pairs whose
bitmaps differ in more places than two alike sets can are not even listed. A large group of near copies thus costs one pair an
entry, and no link between components is lost; what grows with a product is the comparison of bitmaps, outsiders by entries of a list.

Null and empty texts, and those of white space, have no shingles and link with nothing, not even each other. Null ids count
as larger than any id: a component of null ids alone has a null component_id, and ``kept`` compares nulls as equal. Repeated
rows and ids link by their texts as others do. Sets and shingles are told apart by 64-bit hashes. A text of n bytes takes
about 60 n bytes while it is cut. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import batches as b
from quantloom.llm.bits import only_in
from quantloom.llm.graph import components
from quantloom.llm.store import exchange_parts, keep

SHINGLE, ALIKE = 5, 85
COORDINATES, MATCHES, BITS = 64, 40, 1024
PREFIX = COORDINATES - MATCHES + 1
_ORDERS = b.mix(np.arange(1, COORDINATES + 1).astype(np.uint64)) | np.uint64(1)


def shingle_sets(raw: b.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different shingle hashes of every text, and the borders between texts."""
    texts = raw.lower()
    starts, ends = texts.words(b.UNSPACED)
    h, edges = texts.hashes(starts, ends), b.borders(texts.row_of(starts), texts.n)
    each = [np.unique(b.chain(h[i:j], min(SHINGLE, j - i))) if j > i else h[:0] for i, j in zip(edges, edges[1:])]
    return np.concatenate([h[:0], *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def signatures(held: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """32 bits of the minimum in every order, a row for each set that is not empty."""
    full = edges[:-1][np.diff(edges) > 0]
    if not len(full):
        return np.zeros((0, COORDINATES), np.uint32)
    return np.stack([(b.mix(np.minimum.reduceat(held * k, full)) >> np.uint64(32)).astype(np.uint32) for k in _ORDERS], 1)


def parities(held: np.ndarray, edges: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A bitmap for each set, as longs: whether an odd number of its hashes falls on the bit."""
    out = np.zeros((len(edges) - 1, bits // 8), np.uint8)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out[i] = np.packbits(np.bincount((held[lo:hi] % np.uint64(bits)).astype(np.int64), minlength=bits) & 1)
    return out.view(np.int64)


def _signed(batches) -> Iterator[pa.RecordBatch]:
    """n_shingles, the set's name, its signature (null if the set is empty) and bitmap in place of the text."""
    for part, texts in b.pieces(batches, "text"):
        held, edges = shingle_sets(texts)
        n, signs = np.diff(edges), signatures(held, edges)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b.mix(held))])
        name = b.mix(b.mix(total[edges[1:]] - total[edges[:-1]]) + n.astype(np.uint64))
        ends = np.concatenate([[0], np.cumsum(n > 0)]) * COORDINATES
        listed = b.lists(signs.ravel().view(np.int32), ends, pa.int32())
        bits = b.lists(parities(held, edges).ravel(), np.arange(texts.n + 1) * (BITS // 64), pa.int64())
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "a", "b")), pa.array(n), pa.array(name.view(np.int64)), listed, bits], ["doc_id", "a", "b", "n_shingles", "id", "signature", "bits"])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, a and b (hashes of id and text), n_shingles, id (the set's name), signature and bits of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("a"), F.xxhash64(text).alias("b"), text.alias("text"))
    return rows.mapInArrow(_signed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a long, b long, n_shingles long, id long, signature array<int>, bits array<long>")


def merged_lists(entries: DataFrame) -> DataFrame:
    """(key, id): the entries of the lists that are merged; a list is named by its coordinate and value."""
    posted = entries.select("id", F.posexplode("signature").alias("at", "value"))
    posted = posted.select("id", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = keep(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    own = posted.join(shared, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("lists"))
    # lists of one entry are the shortest: they use up places of the prefix and meet nobody
    left = F.lit(PREFIX - COORDINATES) + F.size("lists")
    return own.where(left > 0).select("id", F.explode(F.slice("lists", F.lit(1), left)).alias("x")).select("x.key", "id")


def _agreeing(batches) -> Iterator[pa.RecordBatch]:
    """The number of collisions in place of two signatures."""
    for part in batches:
        x, y = (np.asarray(part.column(c).flatten()).reshape(-1, COORDINATES) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), pa.array((x == y).sum(1))], ["u", "v", "n"])


def collisions(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, n): on how many coordinates the two entries of each pair agree."""
    x, y = (entries.select(F.col("id").alias(c), F.col("signature").alias(s)) for c, s in (("u", "x"), ("v", "y")))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_agreeing, "u long, v long, n long")


def _listed(batches) -> Iterator[pa.RecordBatch]:
    """The sorted set in place of the text."""
    for part, texts in b.pieces(batches, "text"):
        held, edges = shingle_sets(texts)
        yield pa.RecordBatch.from_arrays([part.column("id"), b.lists(held.view(np.int64), edges, pa.int64())], ["id", "held"])


def _alike(batches) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are alike."""
    for part in batches:
        x, y = (part.column(c) for c in "xy")
        near = []
        for i in range(part.num_rows):
            s, t = (np.asarray(c[i].values) for c in (x, y))
            common = len(np.intersect1d(s, t, assume_unique=True))
            near.append(100 * common >= ALIKE * (len(s) + len(t) - common))
        yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(near, pa.bool_())) for c in "uv"], ["u", "v"])


def confirmed(docs: DataFrame, entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are alike by the full sets of one row of each entry, read again from ``docs``."""
    used = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    rows = keep(entries.join(used, "id").select("id", "place.a", "place.b"))
    text = F.coalesce("text", F.lit(""))
    texts = only_in(docs.select(F.xxhash64("doc_id").alias("a"), F.xxhash64(text).alias("b"), text.alias("text")), "b", rows.select(F.col("b").alias("term")))
    once = texts.join(rows, ["a", "b"]).groupBy("id").agg(F.first("text").alias("text"))
    sets = keep(once.mapInArrow(_listed, "id long, held array<long>"))
    x, y = (sets.select(F.col("id").alias(c), F.col("held").alias(s)) for c, s in (("u", "x"), ("v", "y")))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_alike, "u long, v long")


def of_several(rooted: DataFrame) -> DataFrame:
    """The rows (key, id, root) of the lists that hold several components, with ``home``, the one that has most entries there."""
    tally = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    home = keep(tally.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("home"), F.count("*").alias("roots")).where("roots > 1"))
    return rooted.join(home.select("key", "home"), "key")


def outside_pairs(lists: DataFrame, sets: DataFrame, alike: int, bits: int = BITS) -> DataFrame:
    """(u, v), once: entries of one list and different components, one of them not at home, whose bitmaps allow a similarity of ``alike`` per cent.

    ``lists`` are from ``of_several``; ``sets`` has each entry's id, size and bitmap of so many ``bits``.
    """
    still = keep(lists.join(sets, "id"))
    other = still.select("key", *[F.col(c).alias(f"{c}_") for c in ("id", "root", "size", "bits")])
    total = F.col("size") + F.col("size_")
    most = total - 2 * F.floor((alike * total + 99 + alike) / F.lit(100 + alike))
    bit = lambda i: F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_", F.lit(i))))
    differ = sum((bit(i) for i in range(1, bits // 64)), bit(0))
    once = (F.col("root") != F.col("root_")) & ((F.col("root_") == F.col("home")) | (F.col("id") < F.col("id_")))
    met = still.where("root <> home").alias("s").join(other.alias("t"), (F.col("s.key") == F.col("t.key")) & once & (differ <= most))
    # a skewed join is split into many tasks with few pairs each; they are written in as many parts as any other exchange has
    met = met.select(F.least("id", "id_").alias("u"), F.greatest("id", "id_").alias("v"))
    return met.coalesce(exchange_parts(met)).distinct()


def links(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges (u, v) between entries that are alike, enough of them to connect all that are linked."""
    lists = merged_lists(entries)
    order = F.col("id").bitwiseXOR(F.xxhash64("key"))
    lead = keep(lists.groupBy("key").agg(F.min(order).alias("low"), F.count("*").alias("n")).where("n > 1"))
    met = keep(lists.join(lead, "key").select("key", "id", F.col("low").bitwiseXOR(F.xxhash64("key")).alias("low")))
    led = met.where("id <> low").select(F.least("id", "low").alias("u"), F.greatest("id", "low").alias("v")).distinct()
    edges = keep(confirmed(docs, entries, keep(collisions(entries, led).where(F.col("n") >= MATCHES).select("u", "v"))))
    roots = keep(components(edges))
    rooted = met.join(roots, met["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    lists = keep(of_several(rooted))
    more = keep(outside_pairs(lists, entries.select("id", F.col("n_shingles").alias("size"), "bits"), ALIKE))
    return edges.union(confirmed(docs, entries, keep(collisions(entries, more).where(F.col("n") >= MATCHES).select("u", "v"))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (whether that is its own) of every row."""
    rows = keep(signed(docs.select("doc_id", "text")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("least")
    entries = keep(rows.where("n_shingles > 0").groupBy("id").agg(least, F.first("signature").alias("signature"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct("a", "b")).alias("place")))
    roots = keep(components(links(docs, entries)))
    classes = keep(entries.join(roots, entries["id"] == roots["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root")))
    lowest = keep(classes.groupBy("root").agg(F.min("least").alias("lowest")))
    named = keep(classes.join(lowest, "root").select("id", F.col("lowest.doc_id").alias("component_id")))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = rows.join(named, "id", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
