"""Directory trees of mounted file systems, with kinds as the file system tells them.

Spark's own listing knows only files and follows links. Here tasks walk the tree: each round deals the directories that are still to be read over tasks, a task
walks down from its own until it has seen `budget` entries, and hands back the directories it didn't get to. So a deep or lopsided tree is shared out again
each round, no listing passes through the driver, and a lost task is walked again.
"""

from __future__ import annotations

import os
import re
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.patterns import exclude_regex
from corpuslens.options import all_excludes
from corpuslens.sources.shared import new_path

ENTRIES = "root string, base string, device long, path string, kind string, size long, modified_ms long, error string, todo boolean"
_NAMES = ["root", "base", "device", "path", "kind", "size", "modified_ms", "error", "todo"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
BATCH = 10_000


def _kind(mode: int) -> str:
    return "directory" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"


def _readable(path: str) -> bool:
    try:
        path.encode()
    except UnicodeEncodeError:
        return False
    return True


def _walk(regex: str | None, budget: int):
    """Entries under the directories of a partition, and directories left to be read (todo)."""
    bad = re.compile(regex.replace("(?s)", ""), re.S) if regex else None

    def entries(root, base, device, directory):
        """(row, directory or None) of each child; a directory that can't be read is one row with its error, one that is gone is none."""
        try:
            device = os.lstat(directory).st_dev if device is None else device
            with os.scandir(directory) as found:
                for entry in found:
                    if not _readable(entry.path) or (bad and bad.search(entry.path[len(base) :])):
                        continue
                    try:
                        said = entry.stat(follow_symlinks=False)
                    except FileNotFoundError:
                        continue
                    kind = _kind(said.st_mode)
                    only = lambda x, kind=kind: x if kind == "file" else None
                    row = (root, base, device, entry.path, kind, only(said.st_size), only(said.st_mtime_ns // 1_000_000), None, False)
                    yield row, entry.path if kind == "directory" and said.st_dev == device else None
        except FileNotFoundError:
            return
        except OSError as e:
            yield (root, base, device, directory, "directory", None, None, e.strerror or "unreadable", False), None

    def run(it):
        rows, todo, seen = [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
        for batch in it:
            todo += [tuple(r[c] for c in _NAMES[:4]) for r in batch.to_pylist()]
            while todo:
                at = todo.pop()
                if seen >= budget:
                    rows.append((*at, None, None, None, None, True))
                else:
                    for row, below in entries(*at):
                        rows.append(row)
                        seen += 1
                        if below:
                            todo.append((at[0], at[1], row[2], below))
                        if len(rows) >= BATCH:
                            yield pack()
                            rows.clear()
                if len(rows) >= BATCH:
                    yield pack()
                    rows.clear()
        if rows:
            yield pack()

    return run


def scan_tree(spark: SparkSession, host: str, roots: dict[str, str], excludes: tuple[str, ...] = (), budget: int = 200_000) -> DataFrame:
    """host, root, path, rel_path, kind (directory, file or other), size, modified_ms, error of all entries under named roots; size and time of files only.

    Links and devices are other; links are not followed, other file systems mounted below a root not entered, excluded directories not read. A directory that can't be
    read has a second row with the error. Names that aren't UTF-8 are left out. A root that isn't there has no entries. All executors must mount the roots.
    """
    starts = []
    for name, root in sorted(roots.items()):
        scheme, _, rest = root.rpartition("://")
        if scheme not in ("", "file"):
            raise ValueError(f"only mounted file systems tell kinds of files, not {scheme}")
        top = "/" + rest.strip("/")
        starts.append((name, top.rstrip("/") + "/", None, top))
    todo = spark.createDataFrame(starts, "root string, base string, device long, path string")
    walk, out = _walk(exclude_regex(all_excludes(excludes)), budget), None
    parts = spark.sparkContext.defaultParallelism
    while True:
        place = new_path(spark, "tree")
        todo.select(*_NAMES[:4]).repartition(4 * parts, "path").mapInArrow(walk, ENTRIES).write.parquet(place)
        found = spark.read.schema(ENTRIES).parquet(place)
        part = found.where("NOT todo")
        out = part if out is None else out.unionByName(part)
        todo = found.where("todo")
        if todo.isEmpty():
            break
    rel = F.expr("substring(path, length(base) + 1)")
    return out.select(F.lit(host).alias("host"), "root", "path", rel.alias("rel_path"), "kind", "size", "modified_ms", "error")


def regular_files(files: DataFrame, tree: DataFrame) -> DataFrame:
    """Files (host, root, path, ...) that are regular ones of the tree: what a listing reached through a link, and devices, are left out. Only paths are shuffled where a side is small enough."""
    return files.join(tree.where("kind = 'file' AND error IS NULL").select("host", "root", "path").distinct(), ["host", "root", "path"], "left_semi")
