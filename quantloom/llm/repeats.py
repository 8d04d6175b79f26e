"""Suffix-array dedup: remove every byte covered by a string of ``SPAN`` bytes that starts twice in the corpus.

Every window of SPAN bytes is named by its anchor, the ANCHOR-byte string inside it with the smallest hash (the leftmost of
equals), so equal windows have equal anchors. Windows in a row with one anchor form a stretch. Anchors seen once are
settled: nothing in their windows repeats. Of the others, a stretch seen twice repeats throughout, and the different
stretches of an anchor go to shards, where a suffix array made by induced sorting, and its permuted common prefixes, tell
which windows repeat. Stretches of one anchor beyond ``SHARD`` are split over several shards, and the windows that no
shard found twice are then compared across shards by their hashes.

A null text counts as empty, texts shorter than SPAN lose nothing, an empty table gives an empty result. Repeated rows are
documents of their own, so they remove each other. Equal stretches are recognised by two 64-bit hashes, rows are named
by doc_id and a 64-bit hash of the text; null ids are as good as others. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import batches as b
from quantloom.llm.store import keep
from quantloom.llm.suffixes import permuted_prefixes, suffix_array

#: Bytes of a repeated string, bytes of an anchor, most stretches of one anchor in a shard, bytes sorted at once.
SPAN, ANCHOR, SHARD, SORTED = 200, 40, 20_000, 1 << 21
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _stretches(texts: b.Texts) -> tuple[np.ndarray, ...]:
    """Anchor hash, stretch hash, row, first byte in the row and number of windows of every stretch."""
    data, n = texts.data, len(texts.data)
    if n < SPAN:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    power, back = b._powers(1 << max(10, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = b.mix((total[ANCHOR:] - total[:-ANCHOR]) * back[: n - ANCHOR + 1])
    least = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    reach, want = 1, SPAN - ANCHOR + 1
    while 2 * reach <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if want > reach:
        least = np.minimum(least[: reach - want], least[want - reach :])
    last = np.repeat(texts.offs[1:], np.diff(texts.offs))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + SPAN <= last)
    anchor = (least[at] & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
    start, size = at[first], np.diff(np.append(first, len(at)))
    end = start + size + SPAN - 1
    own = b.mix(b.mix((total[end] - total[start]) * back[start]) + size.astype(np.uint64))
    row = texts.row_of(start)
    return h[anchor[first]], own, row, start - texts.offs[row], size


def _named(batches) -> Iterator[pa.RecordBatch]:
    for part, texts in b.pieces(batches, "text"):
        h, d, row, start, size = _stretches(texts)
        own = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), part.column("k").take(own), part.column("g").take(own), pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["h", "d", "k", "g", "start", "n"])


def _cut(batches) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches asked of each row."""
    for part, texts in b.pieces(batches, "text"):
        asked = part.column("asked").combine_chunks() if isinstance(part.column("asked"), pa.ChunkedArray) else part.column("asked")
        row = np.repeat(np.arange(texts.n), asked.value_lengths().to_numpy())
        flat = asked.flatten()
        start = texts.offs[row] + flat.field("start").to_numpy()
        size = flat.field("n").to_numpy() + SPAN - 1
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(start, size)
        body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(texts.data[take].tobytes())])
        yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("h", "d", "n", "c", "shard", "shards")), body], ["h", "d", "n", "c", "shard", "shards", "body"])


def _sorted(batches) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows; for anchors over several shards also the windows to compare across them.

    Rows come ordered by anchor and shard. Whole groups are gathered until they hold SORTED bytes.
    """
    waiting, size = [], 0
    for batch in batches:
        key = np.stack([np.asarray(batch.column(c)) for c in ("h", "shard")])
        if waiting and size >= SORTED and batch.num_rows:
            last = waiting[-1]
            if (last.column("h")[last.num_rows - 1].as_py(), last.column("shard")[last.num_rows - 1].as_py()) != (key[0, 0], key[1, 0]):
                yield from _repeated(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        new = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [batch.num_rows]])
        bytes_to = np.concatenate([[0], np.cumsum(np.asarray(batch.column("n")) + SPAN - 1)])
        at = 0
        for j in new[1:-1]:
            if size + bytes_to[j] - bytes_to[at] >= SORTED:
                yield from _repeated(pa.Table.from_batches([*waiting, batch.slice(at, j - at)]))
                waiting, size, at = [], 0, j
        if at < batch.num_rows:
            waiting.append(batch.slice(at))
            size += int(bytes_to[-1] - bytes_to[at])
    if waiting:
        yield from _repeated(pa.Table.from_batches(waiting))


def _repeated(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    h, d, n, c, shards = (rows.column(x).to_numpy() for x in ("h", "d", "n", "c", "shards"))
    _, once = np.unique(np.stack([h, d]), axis=1, return_index=True)
    rows, (h, d, n, c, shards) = rows.take(pa.array(once)), (x[once] for x in (h, d, n, c, shards))
    size = n + SPAN - 1
    # bytes from 2 on, 1 after every stretch, 0 at the very end
    body = rows.column("body").combine_chunks().cast(pa.large_binary())
    body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    offs = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    raw = np.frombuffer(body.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    t = np.ones(begin[-1] + 1, np.int32)
    t[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw.astype(np.int32) + 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    before, length = permuted_prefixes(t, sa)
    again = length >= SPAN
    again[before[np.flatnonzero(length >= SPAN)]] = True
    out, told = {k: [] for k in ("h", "d", "lo", "hi", "w", "x")}, set()

    def put(**columns):
        for k, v in columns.items():
            out[k].append(v)

    for i in range(len(n)):
        own = again[begin[i] : begin[i] + n[i]]
        step = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        lo, hi = step[::2], step[1::2]
        none = np.zeros(len(lo), np.int64)
        put(h=none + h[i], d=none + d[i], lo=lo, hi=hi, w=none + d[i], x=lo)
        if shards[i] > 1:
            text = raw[offs[i] - offs[0] : offs[i + 1] - offs[0]].tobytes()
            # windows settled here only tell other shards of themselves, once, as rows with lo -1
            name = [xxhash.xxh3_128_intdigest(text[j : j + SPAN]) for j in range(n[i])]
            new = np.array([not own[j] or name[j] not in told for j in range(n[i])])
            told.update(name[j] for j in np.flatnonzero(own))
            w, x = (np.array([(v >> k) & (2**64 - 1) for v in name], np.uint64).view(np.int64)[new] for k in (0, 64))
            none = np.zeros(len(w), np.int64)
            put(h=none + h[i], d=none + d[i], lo=np.where(own, -1, np.arange(n[i]))[new], hi=none - 1, w=w, x=x)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[k]).astype(np.int64)) for k in out], list(out))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(k, g, lo, hi): byte ranges of the rows named by k, g whose windows repeat; ranges may overlap."""
    stretches = docs.select("k", "g", "text").mapInArrow(_named, "h long, d long, k long, g long, start int, n int")
    common = stretches.groupBy("h").agg(F.count("*").alias("seen")).where("seen > 1").select("h")
    found = keep(stretches.join(common, "h"))
    kinds = keep(found.groupBy("h", "d").agg(F.count("*").alias("c"), F.min(F.struct("k", "g", "start", "n")).alias("at")))
    contested = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    shards = F.ceil(F.col("kinds") / SHARD).cast("int")
    asked = kinds.join(contested, "h").select("at.k", "at.g", F.struct("at.start", "at.n", "h", "d", "c", F.pmod("d", shards).cast("int").alias("shard"), shards.alias("shards")).alias("one"))
    texts = docs.join(asked.groupBy("k", "g").agg(F.collect_list("one").alias("asked")), ["k", "g"])
    bodies = texts.mapInArrow(_cut, "h long, d long, n int, c long, shard int, shards int, body binary")
    arrays = bodies.repartition("h", "shard").sortWithinPartitions("h", "shard")
    told = arrays.mapInArrow(_sorted, "h long, d long, lo long, hi long, w long, x long")
    # a window is told once by a shard, so a group has a row for each shard of its anchor at most
    told = told.withColumn("seen", F.count("*").over(Window.partitionBy("w", "x")))
    runs = told.where("hi >= 0 OR (lo >= 0 AND seen > 1)").select("h", "d", "lo", F.when(F.col("hi") < 0, F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))
    copies = kinds.where("c > 1").select("h", "d", F.lit(0).cast("long").alias("lo"), F.col("at.n").cast("long").alias("hi"))
    return found.join(runs.union(copies), ["h", "d"]).select("k", "g", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + SPAN - 1).alias("hi"))


def _strip(batches) -> Iterator[pa.RecordBatch]:
    """What is left of each row without its ranges, and where these lie once they are joined."""
    for part, texts in b.pieces(batches, "text"):
        ranges = part.column("ranges")
        left, lo, hi, ends = [], [], [], [0]
        for i in range(texts.n):
            own = texts.data[texts.offs[i] : texts.offs[i + 1]]
            if ranges[i].is_valid:
                cover = np.zeros(len(own) + 1, np.int64)
                listed = ranges[i].values
                np.add.at(cover, listed.field("lo").to_numpy(), 1)
                np.add.at(cover, listed.field("hi").to_numpy(), -1)
                gone = np.cumsum(cover[:-1]) > 0
                step = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                lo.append(step[::2])
                hi.append(step[1::2])
                own = own[~gone]
            ends.append(ends[-1] + (len(lo[-1]) if ranges[i].is_valid else 0))
            left.append(own.tobytes())
        flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (lo, hi)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(texts.offs)), pa.array(left, pa.binary()), *(b.lists(x, np.array(ends), pa.int64()) for x in flat)],
            ["doc_id", "n_bytes", "kept", "starts", "ends"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes left, which may cut a character), starts and ends of the removed runs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("g"), text.alias("text"))
    ranges = repeated_runs(rows).groupBy("k", "g").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    return rows.join(ranges, ["k", "g"], "left").mapInArrow(_strip, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")

