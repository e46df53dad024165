"""Host registry: validation, freshness and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import absolute_url
from corpuslens.options import LIMITS


def _filled(items: Column) -> Column:
    return F.coalesce(F.forall(items, lambda x: F.trim(x) != ""), F.lit(True))


def failed_rules(rows: DataFrame) -> DataFrame:
    """rows with `reasons`: names of the rules that each breaks, among them a host that comes twice."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = [
        ("host", blank("host")),
        ("local_url", ~absolute_url(F.col("local_url"))),
        ("routable_url", ~absolute_url(F.col("routable_url"))),
        ("capabilities", ~_filled(F.col("capabilities"))),
        ("roots", ~_filled(F.col("roots"))),
        ("generation", F.coalesce(F.col("generation") <= 0, F.lit(True))),
        ("fetched_at_ms", F.coalesce(F.col("fetched_at_ms") <= 0, F.lit(True))),
        ("expires_at_ms", F.coalesce(F.col("expires_at_ms") <= 0, F.lit(True))),
        ("expires_before_fetched", F.coalesce(F.col("expires_at_ms") < F.col("fetched_at_ms"), F.lit(False))),
        ("last_refresh_error", F.coalesce(F.trim("last_refresh_error") == "", F.lit(False))),
    ]
    counts = rows.groupBy("host").agg(F.count("*").alias("_n"))
    rows = rows.join(counts, "host", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    labels = F.array(*[F.when(broken, name) for name, broken in rules], F.when(F.col("_n") > 1, "duplicate_host"))
    return rows.withColumn("reasons", F.filter(labels, lambda x: x.isNotNull())).drop("_n")


def freshness(fetched: Column, expires: Column, error: Column, now: Column, grace: int = LIMITS.registry_grace_ms) -> Column:
    return (
        F.when(fetched.isNull() | expires.isNull(), "empty")
        .when((now <= expires) & error.isNull(), "fresh")
        .when(now <= expires + grace, "stale_but_usable")
        .otherwise("expired")
    )


def generation(rows: DataFrame) -> DataFrame:
    return rows.agg(F.greatest(F.lit(1), F.coalesce(F.max("generation"), F.lit(1))).cast("long").alias("generation"))


def from_wire(wire: DataFrame, local_host: str, now_ms: int, ttl_ms: int = LIMITS.registry_ttl_ms) -> DataFrame:
    """Registry rows of a provider's nodes: either URL stands in for the other, the local host goes, every node has the newest generation."""
    newest = F.broadcast(generation(wire).withColumnRenamed("generation", "_newest"))
    remote = F.coalesce("peer_url", "advertise_url", "routable_url", "endpoint")
    rows = wire.where(F.col("host_id") != local_host).crossJoin(newest)  # one row
    empty = F.array().cast("array<string>")
    return rows.select(
        F.col("host_id").alias("host"),
        F.coalesce("local_url", remote).alias("local_url"),
        F.coalesce(remote, "local_url").alias("routable_url"),
        F.coalesce("capabilities", empty).alias("capabilities"),
        F.coalesce("roots", empty).alias("roots"),
        F.greatest(F.coalesce("generation", F.lit(0)), F.col("_newest")).alias("generation"),
        F.lit(now_ms).cast("long").alias("fetched_at_ms"),
        F.lit(now_ms + ttl_ms).cast("long").alias("expires_at_ms"),
        F.lit(None).cast("string").alias("last_refresh_error"),
    )


def merge(cached: DataFrame, provided: DataFrame) -> DataFrame:
    """The provider's rows replace all; a configured capability or root list that it leaves out stays. The registry's generation is the greatest
    that the cache or the provider has for any host, also one that goes: it never falls."""
    old = cached.select("host", F.col("capabilities").alias("_c"), F.col("roots").alias("_r"))
    newest = F.broadcast(generation(cached.select("generation").unionByName(provided.select("generation"))).withColumnRenamed("generation", "_newest"))  # one row
    rows = provided.join(old, "host", "left")
    kept = lambda new, was: F.when(F.coalesce(F.size(new), F.lit(0)) > 0, F.col(new)).otherwise(F.coalesce(was, new))
    rows = rows.withColumn("capabilities", kept("capabilities", "_c")).withColumn("roots", kept("roots", "_r"))
    return rows.crossJoin(newest).withColumn("generation", F.col("_newest")).select(*provided.columns)


def failed_refresh(cached: DataFrame, error: str) -> DataFrame:
    return cached.withColumn("last_refresh_error", F.coalesce("last_refresh_error", F.lit(error)))


def preferred(sources: DataFrame) -> DataFrame:
    """Rows of the best source there is, among (priority, ...): refreshed 0, cached 1, static 2."""
    best = sources.agg(F.min("priority").alias("priority"))
    return sources.join(F.broadcast(best), "priority").drop("priority")
