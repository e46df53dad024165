"""Backup manifests, rolled up to what may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.options import LIMITS
from corpuslens.sources.corpora import read_manifest


def rollup(manifests: DataFrame) -> DataFrame:
    """count, objects, bytes and newest completion of each manifest (generated_at_ms, backups)."""
    sums = lambda field: F.aggregate("backups", F.lit(0).cast("long"), lambda s, x: s + x[field])
    return manifests.select(
        "*", F.size("backups").cast("long").alias("backup_count"), sums("object_count").alias("object_count"), sums("byte_count").alias("byte_count"), F.array_max(F.transform("backups", lambda x: x["completed_at_ms"])).alias("newest_completed_at_ms")
    ).drop("backups")


def state(generated: Column, now: Column, stale_after_ms: int | None) -> Column:
    """Stale where the manifest is older than the limit; a limit of 0 is a day."""
    age = F.greatest(now - generated, F.lit(0))
    return F.when(generated.isNull(), "unavailable").when(age > (stale_after_ms or LIMITS.backup_stale_after_ms), "stale").otherwise("available")


def availability(spark: SparkSession, path: str | None, now_ms: int, stale_after_ms: int | None = None) -> DataFrame:
    """One row, whatever there is: state, counts and newest completion; nothing else of the manifest."""
    if not path:
        return spark.range(1).select(F.lit("unconfigured").alias("state"), *[F.lit(0).cast("long").alias(c) for c in ("backup_count", "object_count", "byte_count")], F.lit(None).cast("long").alias("newest_completed_at_ms"))
    rows = rollup(read_manifest(spark, path))
    one = spark.range(1).join(rows, F.lit(True), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("backup_count", "object_count", "byte_count")]
    return one.select(state(F.col("generated_at_ms"), F.lit(now_ms), stale_after_ms).alias("state"), *counts, "newest_completed_at_ms")
