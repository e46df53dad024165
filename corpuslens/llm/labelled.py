"""Labelled rows for the classifiers: a bounded sample, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(fold: int, remainder: int):
    """True where crc32 of doc_id as text has this remainder; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, remainder: int, bound: int) -> DataFrame:
    """(doc_id, text, y): at most `bound` documents with a label outside the held-out fold; null labels don't count, repeated ones by the largest; of
    repeated ids the smallest text counts, so the sample is the same each time."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out(fold, remainder))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(bound)
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
