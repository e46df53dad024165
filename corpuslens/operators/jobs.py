"""Search jobs: results in order of arrival, pages, deadlines, eviction and durable results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import artifact_job
from corpuslens.operators.ranges import chains, running_sums
from corpuslens.operators.status import pending
from corpuslens.options import LIMITS
from corpuslens.sources.shared import delete_path, path_exists

HIT = ["host", "path", "line_number"]


def admit(arrivals: DataFrame, limit: int) -> DataFrame:
    """job_id, seq and hit: the first `limit` distinct hits of each job as they arrived."""
    first = arrivals.groupBy("job_id", *HIT).agg(F.min("arrival_ms").alias("arrival_ms"))
    w = Window.partitionBy("job_id").orderBy("arrival_ms", *HIT)
    return first.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= limit)


def page(results: DataFrame, cursor: int = 0, size: int | None = None) -> DataFrame:
    """Rows after the cursor; the next cursor is the largest seq."""
    size = min(max(LIMITS.page_size if size is None else size, 1), LIMITS.max_page_size)
    return results.where(F.col("seq") > cursor).orderBy("seq").limit(size)


def pages_of_jobs(results: DataFrame, cursor: int, size: int) -> DataFrame:
    """One page of every job at once, with `next_cursor` where rows remain."""
    size = min(max(size, 1), LIMITS.max_page_size)
    last = F.max("seq").over(Window.partitionBy("job_id"))
    rows = results.withColumn("last", last).where((F.col("seq") > cursor) & (F.col("seq") <= cursor + size))
    return rows.withColumn("next_cursor", F.when(F.col("last") > cursor + size, cursor + size)).drop("last")


def at_deadline(targets: DataFrame, arrivals: DataFrame, finished: DataFrame, timeout_ms: int) -> DataFrame:
    """job_id, host, ok, error, n_hits of every target (job_id, host, started_ms).

    A host that finished (job_id, host, finished_ms, error) by the deadline is as it said, with hits or without any; one that didn't is a timeout. Hits
    that arrived by the deadline count either way.
    """
    deadline = F.col("started_ms") + timeout_ms
    hits = targets.join(arrivals.select("job_id", "host", "arrival_ms"), ["job_id", "host"]).where(F.col("arrival_ms") <= deadline).groupBy("job_id", "host").agg(F.count("*").alias("n_hits"))
    done = finished.groupBy("job_id", "host").agg(F.min_by(F.struct("finished_ms", "error"), "finished_ms").alias("f"))
    rows = targets.join(done, ["job_id", "host"], "left").join(hits, ["job_id", "host"], "left")
    error = F.when(F.coalesce(F.col("f.finished_ms") <= deadline, F.lit(False)), F.col("f.error")).otherwise("overall timeout")
    rows = rows.withColumn("error", error)
    return rows.select("job_id", "host", F.col("error").isNull().alias("ok"), "error", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def late(arrivals: DataFrame, targets: DataFrame, foreground_ms: int = LIMITS.overall_timeout_ms, job_ms: int = LIMITS.job_timeout_ms) -> DataFrame:
    """job_id, n_foreground, n_job: what the caller saw, and what the job went on to admit."""
    rows = arrivals.join(targets.select("job_id", "host", "started_ms"), ["job_id", "host"]).withColumn("age", F.col("arrival_ms") - F.col("started_ms"))
    return rows.groupBy("job_id").agg(F.count_if(F.col("age") <= foreground_ms).alias("n_foreground"), F.count_if(F.col("age") <= job_ms).alias("n_job"))


def interrupted(targets: DataFrame, finished: DataFrame) -> DataFrame:
    """Status rows of hosts that a restart cut off."""
    return pending(targets, finished, ["job_id", "host"]).select("job_id", "host", F.lit(False).alias("ok"), F.lit("search interrupted by service restart").alias("error"))


def job_state(n_pending: Column, lost: Column, n_hosts: Column, n_ok: Column, durability_error: Column, known: Column | None = None) -> Column:
    """A job that isn't known (any more) is expired."""
    broken = durability_error.isNotNull()
    unknown = F.lit(False) if known is None else ~F.coalesce(known, F.lit(False))
    return F.when(unknown, "expired").when((n_pending > 0) & ~broken, "running").when(lost, "lost").when(broken | ((n_hosts > 0) & (n_ok == 0)), "failed").otherwise("complete")


def newest(rows: DataFrame, keep: int, keys: list[str], order: list) -> DataFrame:
    """The newest `keep` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")


def newest_within(rows: DataFrame, size: str, budget: int, keys: list[str], order: list) -> DataFrame:
    """The newest rows of each key whose sizes fit together: sums are dealt over ranges, so a key of any size never meets in one task."""
    return running_sums(rows, F.col(size), keys, order, budget).select(*rows.columns)


def unexpired(rows: DataFrame, now_ms: int, ttl_ms: int = LIMITS.job_ttl_ms) -> DataFrame:
    return rows.where(F.lit(now_ms) - F.col("created_ms") < ttl_ms)


def job_status(requests: DataFrame, jobs: DataFrame, hosts: DataFrame, results: DataFrame, now_ms: int, ttl_ms: int = LIMITS.job_ttl_ms) -> tuple[DataFrame, DataFrame]:
    """(status, pages) of polls (job_id, cursor, page_size: null for the start and the default size).

    status: job_id, state, partial, n_hosts, n_pending, n_rows, next_cursor, error. pages: the rows of results (job_id, seq, ...) after the cursor.
    jobs: job_id, created_ms, lost, durability_error; hosts: job_id, host, ok (null while it is searching). Unknown and expired jobs have no
    rows. A cursor goes on while a job runs, or rows remain.
    """
    cursor = F.coalesce("cursor", F.lit(0))
    size = F.least(F.greatest(F.coalesce("page_size", F.lit(LIMITS.page_size)), F.lit(1)), F.lit(LIMITS.max_page_size))
    polls = requests.select("job_id", cursor.cast("long").alias("cursor"), size.cast("long").alias("page_size"))
    live = unexpired(jobs, now_ms, ttl_ms).select("job_id", "lost", "durability_error", F.lit(True).alias("known"))
    flags = hosts.groupBy("job_id").agg(F.count("*").alias("n_hosts"), F.count_if(F.col("ok").isNull()).alias("n_pending"), F.count_if("ok").alias("n_ok"))
    last = results.groupBy("job_id").agg(F.max("seq").cast("long").alias("last"))
    rows = polls.join(live, "job_id", "left").join(flags, "job_id", "left").join(last, "job_id", "left").na.fill(0, ["n_hosts", "n_pending", "n_ok", "last"])
    state = job_state(F.col("n_pending"), F.coalesce("lost", F.lit(False)), F.col("n_hosts"), F.col("n_ok"), F.col("durability_error"), F.col("known"))
    rows = rows.withColumn("state", state)
    there = F.when(F.col("state") == "expired", 0).otherwise(F.greatest(F.least(F.col("last") - F.col("cursor"), F.col("page_size")), F.lit(0)))
    rows = rows.withColumn("n_rows", there.cast("long"))
    reached = F.col("cursor") + F.col("n_rows")
    more = (F.col("state") == "running") | ((F.col("state") != "expired") & (reached < F.col("last")))
    error = F.when(F.col("state") == "expired", "search job expired or was lost; start the search again").otherwise(F.col("durability_error"))
    partial = (F.col("state") == "running") | (F.col("n_ok") + F.col("n_pending") < F.col("n_hosts"))
    status = rows.select("job_id", "state", (partial & (F.col("state") != "expired")).alias("partial"), "n_hosts", "n_pending", "n_rows", F.when(more, reached).alias("next_cursor"), error.alias("error"))
    spans = rows.select("job_id", F.col("cursor").alias("_from"), reached.alias("_to")).where("_to > _from")
    pages = results.join(spans, "job_id").where("seq > _from and seq <= _to").drop("_from", "_to")
    return status, pages


def _accept(window_ms: int):
    def run(it):
        known, last = None, None
        for batch in it:
            names, times = batch["request_id"], batch["at_ms"].to_numpy()
            coded = names.dictionary_encode()
            codes, labels = np.asarray(coded.indices), coded.dictionary.to_pylist()
            edges = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
            keep = []
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if low == high:
                    continue
                if (name := labels[codes[low]]) != known or last is None:
                    known, at = name, low
                else:
                    at = low + int(np.searchsorted(times[low:high], last + window_ms))
                while at < high:
                    keep.append(at)
                    last = int(times[at])
                    at += int(np.searchsorted(times[at:high], last + window_ms))
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def accepted(requests: DataFrame, window_ms: int = LIMITS.replay_window_ms) -> DataFrame:
    """request_id, at_ms of accepted requests: a repeat is refused for a window after the last one accepted; a refused one doesn't count.

    The first request after a pause of a window is always accepted, so an id's times fall into chains between pauses, which tasks take apart. In a chain the one value
    kept is the last time accepted, so it takes no memory; a time that is asked for often counts once. Null ids and times are left out.
    """
    rows = requests.where("request_id is not null and at_ms is not null").select(F.col("request_id").cast("string"), F.col("at_ms").cast("long")).distinct()
    cut = chains(rows, "request_id", "at_ms", window_ms)
    rows = cut.repartition("request_id", "_chain").sortWithinPartitions("request_id", "_chain", "at_ms").drop("_chain")
    return rows.mapInArrow(_accept(window_ms), "request_id string, at_ms long")


def store_results(results: DataFrame, path: str) -> None:
    """Each job's results in a partition of their own, replaced as a whole."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def load_results(spark: SparkSession, path: str, job_id: str, jobs: DataFrame, now_ms: int, ttl_ms: int = LIMITS.job_ttl_ms) -> DataFrame:
    """The job's results; none where it is unknown or expired. Only its partition is read."""
    live = unexpired(jobs, now_ms, ttl_ms).where(F.col("job_id") == job_id).select("job_id")
    return spark.read.parquet(path).where(F.col("job_id") == job_id).join(F.broadcast(live.limit(1)), "job_id", "left_semi")


def stored_sizes(spark: SparkSession, path: str) -> DataFrame:
    """job_id, size of the results stored by store_results; only names and sizes are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", "/job_id=([^/]*)/[^/]*$", 1)
    # Partition names are escaped.
    plain = F.url_decode(F.replace("folder", F.lit("+"), F.lit("%2B")))
    return rows.where(name != "").groupBy(name.alias("folder")).agg(F.sum("length").alias("size")).select(plain.alias("job_id"), "folder", "size")


def prune_results(spark: SparkSession, path: str, jobs: DataFrame, now_ms: int, ttl_ms: int = LIMITS.job_ttl_ms, most_jobs: int = LIMITS.max_jobs, most_bytes: int | None = None) -> list[str]:
    """Deletes stored results: those of jobs past their time, then the oldest until at most `most_jobs` are left and they fit `most_bytes`; returns the jobs' ids.

    jobs: job_id, created_ms; of jobs of one age the larger id stays. Results of jobs that aren't known are left alone and not counted. Folders are deleted one
    by one, so a prune that was cut off is finished by the next.
    """
    if not path_exists(spark, path):
        return []
    known = jobs.groupBy(F.col("job_id").cast("string").alias("job_id")).agg(F.max("created_ms").alias("created_ms"))
    there = stored_sizes(spark, path).join(known, "job_id").withColumn("_all", F.lit(1))
    order = [F.col("created_ms").desc(), F.col("job_id").desc()]
    left = newest(unexpired(there, now_ms, ttl_ms), most_jobs, ["_all"], order)
    if most_bytes is not None:
        left = newest_within(left, "size", most_bytes, ["_all"], order)
    gone = there.join(left.select("job_id"), "job_id", "left_anti").orderBy("created_ms", "job_id").select("job_id", "folder").collect()  # a row a stored job
    for row in gone:
        delete_path(spark, f"{path}/job_id={row['folder']}")
    return [row["job_id"] for row in gone]


def artifacts(inventory: DataFrame) -> DataFrame:
    """job_id, path, size, modified_ms of the files of an inventory (rel_path, ...) whose names are those of stored results."""
    rows = inventory.withColumn("job_id", artifact_job(F.element_at(F.split("rel_path", "/"), -1)))
    return rows.where("job_id is not null").select("job_id", "path", "size", "modified_ms")
