"""A filter for 64-bit hashes that has one size however many it holds: small enough to send to every task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 4 MB at any number of entries.
FILTER_BITS = 1 << 25
_PAGE = 1 << 15


def bit_field(hashes: DataFrame) -> np.ndarray:
    """Bit field of the hashes in column ``term``; false hits are possible, misses are not."""
    at = F.pmod("term", F.lit(FILTER_BITS))
    pages = hashes.groupBy(F.floor(at / _PAGE).alias("page")).agg(F.bitmap_construct_agg((at % _PAGE).cast("long")).alias("bits")).collect()
    field = np.zeros(FILTER_BITS // 8, np.uint8)
    for page, bits in pages:
        field[page * _PAGE // 8 : (page + 1) * _PAGE // 8] = np.frombuffer(bits, np.uint8)
    return field


def only_in(rows: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``hashes``, and a few others: a join with the pages of the bit field, 4 MB in all."""
    at = lambda c: F.pmod(c, F.lit(FILTER_BITS))
    bits = F.bitmap_construct_agg((at("term") % _PAGE).cast("long"))
    pages = hashes.groupBy(F.floor(at("term") / _PAGE).alias("_page")).agg(bits.alias("_bits"))
    placed = rows.withColumns({"_page": F.floor(at(column) / _PAGE), "_bit": (at(column) % _PAGE).cast("int")})
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return placed.join(F.broadcast(pages), "_page").where(F.getbit(byte, F.col("_bit").bitwiseAND(7)) == 1).drop("_page", "_bit", "_bits")


def passes(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(FILTER_BITS)).astype(np.int64)
    return (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
