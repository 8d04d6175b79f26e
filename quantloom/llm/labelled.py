"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on at most: the smallest by a hash of doc_id.
SAMPLE = 4096
FOLDS, HELD = 5, 0


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from. A null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % FOLDS == HELD


def sample(docs: DataFrame, labels: DataFrame, target: str, text: str = "text", bound: int = SAMPLE, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, y, text, *more) of at most ``bound`` labelled rows outside the held-out fold.

    Of several labels of one document the largest counts, of several texts the smallest; null or other labels don't.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    chosen = marked.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), *more).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"), *[F.max(c).alias(c) for c in more])
