"""Host status, catalog and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import UNREADABLE_MESSAGE, safe_error, unreadable
from corpuslens.operators.registry import freshness


def rollup(flags: DataFrame) -> DataFrame:
    """host, ok, error of flags (host, ok, error): ok where every part is; the error is the smallest one."""
    return flags.groupBy("host").agg(F.bool_and("ok").alias("ok"), F.min("error").alias("error"))


def overall(status: DataFrame, truncated: Column | None = None) -> DataFrame:
    """One row: partial where any host isn't ok, failed where all aren't, truncated where any is."""
    cut = F.bool_or(truncated) if truncated is not None else F.lit(False)
    return status.agg(F.coalesce(F.bool_or(~F.col("ok")), F.lit(False)).alias("partial"), F.coalesce(F.bool_and(~F.col("ok")), F.lit(False)).alias("failed"), F.coalesce(cut, F.lit(False)).alias("truncated"))


def health(ok: Column, error: Column) -> Column:
    return F.when(ok, "healthy").when(F.coalesce(error, F.lit("")).startswith("Some configured paths"), "degraded").otherwise("offline")


def catalog(locations: DataFrame, status: DataFrame) -> DataFrame:
    """host, roots, health, last_error of every host that has a location or a status; a host without status is offline."""
    roots = locations.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("roots"))
    said = status.select("host", "ok", safe_error(F.col("error")).alias("said"), F.lit(True).alias("known"))
    rows = roots.join(said, "host", "full_outer")
    error = F.when(F.col("known"), F.col("said")).otherwise("Device did not report its catalog status.")
    rows = rows.withColumn("last_error", error)
    return rows.select("host", F.coalesce("roots", F.array().cast("array<string>")).alias("roots"), health(F.coalesce("ok", F.lit(False)), F.col("last_error")).alias("health"), "last_error")


def diagnostics(lines: DataFrame, key: str = "run") -> DataFrame:
    """key, message: a message where all non-blank lines only tell of unreadable paths, and there are any."""
    rows = lines.where(F.trim("line") != "").groupBy(key).agg(F.bool_and(unreadable(F.col("line"))).alias("usable"))
    return rows.select(key, F.when(F.col("usable"), UNREADABLE_MESSAGE).alias("message"))


def pending(targets: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Targets that haven't finished."""
    return targets.join(finished.select(*keys).distinct(), keys, "left_anti")


def first_per_host(status: DataFrame, order: str) -> DataFrame:
    """One row a host, the first one, in order of hosts."""
    w = Window.partitionBy("host").orderBy(order)
    return status.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").orderBy("host")


def node_status(status: DataFrame, files: DataFrame, states: DataFrame, registry: DataFrame, now_ms: int, order: str = "seq") -> DataFrame:
    """host, ok, error, indexed_files, index_state, generation, freshness of every host that reported, in order of hosts.

    status: (host, ok, error, and what orders a host's reports, of which the first counts); states: index.latest_state of roots named by host; a
    host without a state has no index yet, one without a registry row no freshness.
    """
    indexed = files.groupBy("host").agg(F.count("*").alias("indexed_files"))
    state = states.select(F.col("root").alias("host"), F.col("state").alias("index_state"), "generation")
    fresh = registry.select("host", freshness(F.col("fetched_at_ms"), F.col("expires_at_ms"), F.col("last_refresh_error"), F.lit(now_ms)).alias("freshness"))
    rows = first_per_host(status, order).join(indexed, "host", "left").join(state, "host", "left").join(fresh, "host", "left")
    return rows.select("host", "ok", "error", F.coalesce("indexed_files", F.lit(0)).alias("indexed_files"), F.coalesce("index_state", F.lit("missing")).alias("index_state"), F.coalesce("generation", F.lit(0)).alias("generation"), F.coalesce("freshness", F.lit("empty")).alias("freshness")).orderBy("host")


def unique_in_order(hosts: DataFrame, host: str = "host", position: str = "pos") -> DataFrame:
    """Each host at its first position."""
    return hosts.groupBy(host).agg(F.min(position).alias(position))
