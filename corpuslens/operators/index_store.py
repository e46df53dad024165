"""A stored trigram index that stays right while files change.

Under one folder: runs, each the postings of the files that a refresh found added or changed (sorted by gram) and the state of the files it
looked at; and manifests, each a list of runs and of the roots that are ready. A refresh writes a run and then a manifest, so it costs the change, not the
table. Readers take the newest manifest that is whole and keep to it: they see one generation whatever is written beside it. A file's newest run holds for it,
removals included. Merging puts several runs into one and lists that instead; folders that no kept manifest lists are deleted later.

A search asks the index only about files that it knows as they are: of same size and time, under a ready root. All others are scanned.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import binary, matches
from corpuslens.operators.index import POSTED, candidates, number_files, spread, without_files, write_posted, write_sorted
from corpuslens.sources.shared import delete_path, new_path, path_exists

STATE = "host string, path string, root string, size long, modified_ms long, removed boolean"
NUMBERED = f"{STATE}, segment long, n int"
MANIFEST = "run string, position int, ready array<string>, manifest int"
KEY = ["host", "path"]


@dataclass(frozen=True)
class Snapshot:
    """One generation of an index, as a reader sees it."""

    spark: SparkSession
    at: str
    generation: int
    runs: tuple[str, ...]  # oldest first
    ready: tuple[str, ...]

    def _tables(self, name: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema).withColumn("position", F.lit(0))
        for k, run in enumerate(self.runs):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.at}/runs/{run}/{name}").withColumn("position", F.lit(k)))
        return out

    def newest(self) -> DataFrame:
        """Each file's newest state, with the run's position."""
        rows = self._tables("files", NUMBERED)
        if len(self.runs) < 2:
            return rows
        last = rows.groupBy(*KEY).agg(F.max_by(F.struct("root", "size", "modified_ms", "removed", "segment", "n", "position"), "position").alias("s"))
        return last.select(*KEY, "s.*")

    def files(self) -> DataFrame:
        """host, path, root, size, modified_ms of the files that are indexed."""
        return self.newest().where("NOT removed").drop("removed", "position", "segment", "n")

    def postings(self) -> DataFrame:
        """gram, host, path of the newest run of each file."""
        return spread(self._tables("postings", POSTED), self.newest().where("NOT removed"))

    def posted(self) -> DataFrame:
        """The stored rows (gram, segment, files) without what newer runs have replaced or removed."""
        rows = self._tables("postings", POSTED).drop("position")
        if len(self.runs) < 2:
            return rows
        live = self.newest().where("NOT removed").select("segment", "n")
        return without_files(rows, self._tables("files", NUMBERED).where("NOT removed").select("segment", "n").join(live, ["segment", "n"], "left_anti"))

    def gram_counts(self) -> DataFrame:
        """gram, n_files."""
        return self.posted().groupBy("gram").agg(F.sum(F.size("files")).alias("n_files"))


def _manifests(spark: SparkSession, at: str) -> list[int]:
    """Numbers of whole manifests, newest first: few, as old ones are deleted."""
    if not path_exists(spark, f"{at}/manifests"):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/manifests")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in found]
    return sorted((int(n.split("=")[1]) for n in names if n.startswith("manifest=") and path_exists(spark, f"{at}/manifests/{n}/_SUCCESS")), reverse=True)


def snapshot(spark: SparkSession, at: str, generation: int | None = None) -> Snapshot:
    """The newest generation, or an older one that is kept; an index that isn't there knows nothing."""
    found = [n for n in _manifests(spark, at) if generation is None or n == generation]
    if not found:
        return Snapshot(spark, at, 0, (), ())
    rows = spark.read.schema(MANIFEST.rsplit(",", 1)[0]).parquet(f"{at}/manifests/manifest={found[0]}").orderBy("position").collect()  # a row a run
    return Snapshot(spark, at, found[0], tuple(r["run"] for r in rows if r["run"]), tuple(rows[0]["ready"]))


def _publish(spark: SparkSession, at: str, generation: int, runs: tuple[str, ...], ready: tuple[str, ...]) -> Snapshot:
    rows = [(run, k, list(ready)) for k, run in enumerate(runs)] or [(None, 0, list(ready))]
    spark.createDataFrame(rows, MANIFEST.rsplit(",", 1)[0]).coalesce(1).write.mode("errorifexists").parquet(f"{at}/manifests/manifest={generation}")
    return snapshot(spark, at, generation)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """host, path, root, size, modified_ms, removed of files (KEY, root, size, modified_ms) that were added, changed or removed; a removed one keeps what was known."""
    old = before.select(*KEY, F.struct("root", "size", "modified_ms").alias("old"))
    new = now.groupBy(*KEY).agg(F.min(F.struct("root", F.col("size").cast("long").alias("size"), F.col("modified_ms").cast("long").alias("modified_ms"))).alias("new"))
    rows = old.join(new, KEY, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    state = F.coalesce("new", "old")
    return rows.select(*KEY, state["root"].alias("root"), state["size"].alias("size"), state["modified_ms"].alias("modified_ms"), F.col("new").isNull().alias("removed"))


def refresh(spark: SparkSession, at: str, files: DataFrame, unready: tuple[str, ...] = ()) -> Snapshot:
    """Indexes what changed among files (host, root, path, size, modified_ms, text) since the newest generation; without change nothing is written.

    Only states are compared and only changed files' texts are read. Files under an unready root are left as they were known, and the root is
    not among the ready ones: searches scan it. Binary files have no postings. A file under several roots is indexed once, under the first.
    """
    last = snapshot(spark, at)
    now = files.where(~F.col("root").isin(*unready)) if unready else files
    before = last.files().where(~F.col("root").isin(*unready)) if unready else last.files()
    run = uuid.uuid4().hex
    there = f"{at}/runs/{run}"
    staged = new_path(spark, "changes")
    changes(before, now.select("host", "root", "path", "size", "modified_ms")).write.parquet(staged)
    found = spark.read.schema(STATE).parquet(staged)
    roots = tuple(sorted(r["root"] for r in now.select("root").distinct().collect() if r["root"] is not None))  # configured roots, few
    if not (n_files := found.count()):
        delete_path(spark, staged)
        return last if last.generation and roots == last.ready else _publish(spark, at, last.generation + 1, last.runs, roots)
    # Segments of a generation have numbers of their own, so runs can be merged as they are.
    number_files(found, n_files, (last.generation + 1) << 32).write.parquet(f"{there}/files")
    delete_path(spark, staged)
    changed = spark.read.schema(NUMBERED).parquet(f"{there}/files").where("NOT removed").select(*KEY, "root", "segment", "n")
    write_posted(now.where(~binary(F.col("text"))).join(changed, [*KEY, "root"]), f"{there}/postings")
    return _publish(spark, at, last.generation + 1, (*last.runs, run), roots)


def merge_runs(spark: SparkSession, at: str, most: int = 1) -> Snapshot:
    """All but the oldest `most - 1` runs become one, so at most `most` are left. What newer runs say of a file stays, removals only where an older run may know the file."""
    last = snapshot(spark, at)
    if len(last.runs) <= most:
        return last
    kept, merged = last.runs[: most - 1], Snapshot(spark, at, last.generation, last.runs[most - 1 :], last.ready)
    run = uuid.uuid4().hex
    state = merged.newest().drop("position")
    (state if kept else state.where("NOT removed")).write.parquet(f"{at}/runs/{run}/files")
    write_sorted(merged.posted(), f"{at}/runs/{run}/postings")
    return _publish(spark, at, last.generation + 1, (*kept, run), last.ready)


def drop_old(spark: SparkSession, at: str, keep: int = 1) -> None:
    """Deletes all but the newest `keep` manifests, and runs that none of those lists."""
    numbers = _manifests(spark, at)
    used = {run for n in numbers[:keep] for run in snapshot(spark, at, n).runs}
    gone = {run for n in numbers[keep:] for run in snapshot(spark, at, n).runs} - used
    for n in numbers[keep:]:
        delete_path(spark, f"{at}/manifests/manifest={n}")
    for run in gone:
        delete_path(spark, f"{at}/runs/{run}")


def files_to_read(files: DataFrame, index: Snapshot, query: str, mode: str = "literal") -> DataFrame:
    """(host, path) of files that may hold the query: candidates of the index among those that it knows as they are, and all that it doesn't.

    Only states take part, no texts.
    """
    states = files.select(*KEY, "root", F.col("size").cast("long").alias("size"), F.col("modified_ms").cast("long").alias("modified_ms")).distinct()
    found = candidates(index.postings(), query) if mode != "regex" and index.runs else None
    if found is None:
        return states.select(*KEY).distinct()
    ready = F.col("root").isin(*index.ready) if index.ready else F.lit(False)
    known = index.files().where(ready).select(*KEY, "size", "modified_ms", F.lit(True).alias("known"))
    rows = states.join(known, [*KEY, "size", "modified_ms"], "left").join(found.withColumn("found", F.lit(True)), KEY, "left")
    return rows.where("known IS NULL OR found").select(*KEY).distinct()


def search_files(files: DataFrame, index: Snapshot, query: str, mode: str = "literal") -> DataFrame:
    """Rows of files (host, root, path, size, modified_ms, text) that hold the query, whatever the index has missed; binary files don't."""
    return files.join(files_to_read(files, index, query, mode), KEY, "left_semi").where(matches(F.col("text"), query, mode) & ~binary(F.col("text")))
