"""Structured Streaming: index refresh, progressive search, replay suppression, registry refresh."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from corpuslens.operators import index_store
from corpuslens.operators.index import NAMES, POSTED, number_files, spread, without_files, write_posted, write_sorted
from corpuslens.operators.jobs import HIT
from corpuslens.operators.registry import failed_refresh, failed_rules
from corpuslens.operators.search import Search, find_hits
from corpuslens.sources.shared import path_exists

DEBOUNCE = "2 seconds"


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


INDEXED = "host string, path string, removed boolean, segment long, n int, generation int"


def refresh_index(stream: DataFrame, index: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """An index of arriving files (host, root, path, modified_ms, text, and optionally error and removed), a generation a batch.

    Under `index`: postings, the files each batch indexed or took away, and the log of its roots. A file with an error is not indexed (it keeps what
    there was) and leaves its root degraded; a removed one, and one whose new text has no grams, has no postings any more. A batch overwrites its own
    folders, so a repeated one changes nothing; a reader takes each file's newest generation (current_postings). The log tells of each batch by itself,
    root_states of all that came so far.
    """
    for name, kind in (("error", "string"), ("removed", "boolean")):
        if name not in stream.columns:
            stream = stream.withColumn(name, F.lit(None).cast(kind))

    def batch(rows: DataFrame, batch_id: int) -> None:
        generation = batch_id + 1
        rows = rows.withColumn("removed", F.coalesce("removed", F.lit(False))).persist(StorageLevel.DISK_ONLY)  # lost blocks are read again
        # Of a file that comes twice in a batch the newest row counts.
        newest = rows.where("error is null").groupBy("host", "path").agg(F.max_by(F.struct("removed", "text"), "modified_ms").alias("f")).select("host", "path", "f.*")
        save = lambda df, name: df.write.mode("overwrite").parquet(f"{index}/{name}/generation={generation}")
        save(number_files(newest.select("host", "path", "removed"), newest.count(), generation << 32), "files")
        names = rows.sparkSession.read.schema(INDEXED).parquet(f"{index}/files/generation={generation}").where("not removed").select("host", "path", "segment", "n")
        write_posted(newest.select("host", "path", "text").join(names, ["host", "path"]), f"{index}/postings/generation={generation}")
        seen = rows.groupBy("host", "root", "path").agg(
            F.max_by("removed", F.when(F.col("error").isNull(), F.struct("modified_ms"))).alias("removed"), F.max_by("error", F.struct("modified_ms", F.col("error").isNotNull())).alias("error")
        )
        save(seen, "states")
        log = rows.groupBy("root").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull() & ~F.col("removed")).alias("indexed_files"), F.max("modified_ms").alias("at_ms"))
        save(log.select("root", F.col("error").isNull().alias("ok"), "error", "indexed_files", "at_ms"), "log")
        rows.unpersist()

    return _start(stream, batch, checkpoint, once)


def _current(spark: SparkSession, index: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All stored posting rows, all files that have any, and the newest generation of the files that weren't removed (both NAMES)."""
    files = spark.read.schema(INDEXED).parquet(f"{index}/files")
    newest = files.groupBy("host", "path").agg(F.max_by(F.struct("removed", "segment", "n"), "generation").alias("f")).where("not f.removed")
    rows = spark.read.schema(POSTED).parquet(f"{index}/postings")
    names = [c.split()[0] for c in NAMES.split(", ")]
    return rows, files.where("not removed").select(*names), newest.select("host", "path", "f.segment", "f.n")


def current_postings(spark: SparkSession, index: str) -> DataFrame:
    """gram, host, path of each file's newest generation."""
    rows, _, newest = _current(spark, index)
    return spread(rows, newest)


STATES = "host string, root string, path string, removed boolean, error string, generation int"


def root_states(spark: SparkSession, index: str) -> DataFrame:
    """root, state, generation, indexed_files, last_error of all batches together, however the files came.

    A file counts where it was last read without an error and not removed; a root is degraded while the newest row of any of its files is an error.
    """
    rows = spark.read.schema(STATES).parquet(f"{index}/states")
    files = rows.groupBy("host", "root", "path").agg(
        F.max_by("removed", F.when(F.col("removed").isNotNull(), F.col("generation"))).alias("removed"), F.max_by("error", "generation").alias("error"), F.max("generation").alias("generation")
    )
    out = files.groupBy("root").agg(F.max("error").alias("last_error"), F.max("generation").alias("generation"), F.count_if(~F.col("removed")).alias("indexed_files"))
    return out.select("root", F.when(F.col("last_error").isNull(), "ready").otherwise("degraded").alias("state"), "generation", "indexed_files", "last_error")


def compact_index(spark: SparkSession, index: str, target: str) -> None:
    """The current postings as one table sorted by gram, to be read by index.load_postings."""
    rows, files, newest = _current(spark, index)
    newest.write.mode("overwrite").parquet(f"{target}/files")
    write_sorted(without_files(rows, files.join(newest, ["segment", "n"], "left_anti")), f"{target}/postings")


def progressive_search(stream: DataFrame, search: Search, limit: int, out: str, checkpoint: str, once: bool = False, ordered: bool = False) -> StreamingQuery:
    """Hits as files arrive: seq goes on from those there are, earlier hits stay as they are, the first `limit` are final.

    The number of earlier hits is counted from other batches' folders, so a batch that runs again writes the same rows.
    With `ordered`, a batch writes the `limit` smallest of its own hits; first_hits ranks those of all batches, so the result doesn't depend on how files come.
    """

    def batch(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        hits = find_hits(files, search).select(*HIT, "text").dropDuplicates(HIT)
        if ordered:
            hits.orderBy(*HIT).limit(limit).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            return
        taken = 0
        if path_exists(spark, out):
            before = spark.read.schema("seq int, host string, path string, line_number int, text string, batch int").parquet(out).where(F.col("batch") != batch_id)
            taken = before.count()
            hits = hits.join(before.select(*HIT), HIT, "left_anti")
        if taken >= limit:
            return
        new = hits.orderBy(*HIT).limit(limit - taken)  # at most the limit, so one task may number them
        numbered = new.selectExpr(f"cast(row_number() over (order by {', '.join(HIT)}) + {taken} as int) seq", *HIT, "text")
        numbered.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(stream, batch, checkpoint, once)


def first_hits(spark: SparkSession, out: str, limit: int) -> DataFrame:
    """seq, host, path, line_number, text: the `limit` smallest hits of an ordered progressive search so far; a later batch may move them."""
    rows = spark.read.schema("host string, path string, line_number int, text string, batch int").parquet(out)
    first = rows.groupBy(*HIT).agg(F.max_by("text", "batch").alias("text")).orderBy(*HIT).limit(limit)  # at most the limit, so one task may number them
    return first.selectExpr(f"cast(row_number() over (order by {', '.join(HIT)}) as int) seq", *HIT, "text")


def watch_files(spark: SparkSession, files: Callable[[], DataFrame], at: str, checkpoint: str, interval: str = "30 seconds", most_runs: int = 8) -> StreamingQuery:
    """Keeps the index at `at` (operators.index_store) up to date: at every interval the files there are, as `files` lists them, are compared with those that the index knows,
    and what was added, changed or removed becomes a run. Runs are merged when there are more than `most_runs`; readers of the generation before aren't disturbed."""

    def batch(_: DataFrame, batch_id: int) -> None:
        index_store.refresh(spark, at, files())
        if len(index_store.snapshot(spark, at).runs) > most_runs:
            index_store.merge_runs(spark, at, max(1, most_runs // 2))
            index_store.drop_old(spark, at, keep=2)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def accepted_requests(requests: DataFrame, window: str = "60 seconds") -> DataFrame:
    """Requests (request_id, ts) without repeats less than the window from one accepted; a refused one doesn't count.

    The state of an id is the times accepted that can still refuse another; it ends a window after the last one, when the watermark (a window behind the newest time
    seen) has passed. So there are only states of ids seen lately. Requests older than the watermark are dropped. Where an id's times
    come in order, batch by batch, these are the rows of jobs.accepted; an earlier one that comes later must keep clear of those
    accepted on both sides. Null times are dropped.
    """
    width = pd.Timedelta(window) // pd.Timedelta(microseconds=1)

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        kept, new = list(state.get[0]) if state.exists else [], []
        for t in sorted(t for pdf in batches for t in pdf["at"].tolist()):
            k = bisect_left(kept, t)
            if (k == 0 or t - kept[k - 1] >= width) and (k == len(kept) or kept[k] - t >= width):
                kept.insert(k, t)
                new.append(t)
        past = 1000 * state.getCurrentWatermarkMs() - width
        state.update(([t for t in kept[:-1] if t > past] + kept[-1:],))
        state.setTimeoutTimestamp(max((kept[-1] + width) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"request_id": pd.Series([key[0]] * len(new), dtype=object), "at": pd.Series(new, dtype="int64")})

    rows = requests.where("ts is not null").withWatermark("ts", window).select("request_id", "ts", F.unix_micros("ts").alias("at"))
    out = rows.groupBy("request_id").applyInPandasWithState(fold, "request_id string, at long", "times array<long>", "append", "EventTimeTimeout")
    return out.select("request_id", F.timestamp_micros("at").alias("ts"))


def refresh_registry(stream: DataFrame, merge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each batch of provider rows becomes a registry of its own, the folder refresh=N.

    A registry that breaks a rule (registry.failed_rules) is refused: the last good one stays, each row with the first broken rule as its error. Other
    failures are the batch's, which runs again.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark, target = rows.sparkSession, f"{out}/refresh={batch_id}"
        fresh = merge(rows).persist(StorageLevel.DISK_ONLY)
        broken = failed_rules(fresh).where("size(reasons) > 0").select("host", F.element_at("reasons", 1).alias("rule")).orderBy("host", "rule").first()
        if broken is None:
            fresh.write.mode("overwrite").parquet(target)
        else:
            error = f"registry refused: {broken['rule']} of {broken['host']}"
            last = fresh.limit(0)
            if path_exists(spark, out):
                before = spark.read.schema(StructType([*fresh.schema.fields, StructField("refresh", IntegerType())])).parquet(out).where(F.col("refresh") < batch_id)
                newest = before.agg(F.max("refresh")).first()[0]
                last = before.where(F.col("refresh") == (-1 if newest is None else newest)).select(*fresh.columns)
            failed_refresh(last, error).write.mode("overwrite").parquet(target)
        fresh.unpersist()

    return _start(stream, batch, checkpoint, once)
