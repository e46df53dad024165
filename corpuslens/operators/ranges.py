"""Sums along an order, dealt over ranges: a key of any size never meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.sources.shared import new_path


def in_ranges(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """rows with `_range`: dealt by key and order, and stored, so that ranges stay as they are."""
    at = new_path(rows.sparkSession, "ranges")
    rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def running_sums(rows: DataFrame, size: Column, keys: list[str], order: list, most: int | None = None) -> DataFrame:
    """rows with `_sum`, each key's sizes up to and with the row, and `_total`, the key's all; with `most`, only rows whose sum is that at most.

    Rows are dealt into ranges by key and order. Sums of the ranges, one row each, tell what is ahead of a range; ranges that begin
    past `most` go, and the others' rows are summed up range by range.
    """
    dealt = in_ranges(rows.withColumn("_size", size), keys, order)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_size").alias("_here"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*keys, "_range", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_ahead"), F.sum("_here").over(Window.partitionBy(*keys)).alias("_total"))
    if most is not None:
        ahead = ahead.where(F.col("_ahead") <= most)
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(ahead, [*keys, "_range"]).withColumn("_sum", F.col("_ahead") + F.sum("_size").over(w))
    if most is not None:
        summed = summed.where(F.col("_sum") <= most)
    return summed.select(*rows.columns, "_sum", "_total")


def chains(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """rows with `_chain`, the place where a key's chain begins: a row that is `gap` or more behind the one before begins a new chain. Places are numbers, not null."""
    dealt = in_ranges(rows, [key], [at])
    inside, before = Window.partitionBy(key, "_range").orderBy(at), Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edges = dealt.groupBy(key, "_range").agg(F.max(at).alias("_last"))
    edges = edges.select(key, "_range", F.max("_last").over(before).alias("_reached"))
    ahead = dealt.join(edges, [key, "_range"]).withColumn("_reached", F.coalesce(F.lag(at).over(inside), "_reached"))
    begun = ahead.withColumn("_begin", F.when(F.col("_reached").isNull() | (F.col(at) - F.col("_reached") >= gap), F.col(at)))
    latest = begun.groupBy(key, "_range").agg(F.max("_begin").alias("_begun"))
    latest = latest.select(key, "_range", F.max("_begun").over(before).alias("_begun"))
    so_far = F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return begun.join(latest, [key, "_range"]).select(*rows.columns, F.coalesce(so_far, "_begun").alias("_chain"))
