"""Paths: search, listings, bounded reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.patterns import excluded, path_matches
from corpuslens.functions.text import ancestors, clamp, lines_of, sound, within
from corpuslens.operators.search import cap_per_host, effective_limit, select_hosts, select_roots, within_budget
from corpuslens.options import LIMITS, all_excludes


def find_paths(files: DataFrame, pattern: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """host, path, kind of files; only paths are read, never texts."""
    return files.where((F.col("kind") == "file") & ~excluded(F.col("rel_path"), all_excludes(excludes)) & path_matches(F.col("rel_path"), pattern)).select("host", "path", F.lit("file").alias("kind"))


def search_paths(files: DataFrame, pattern: str, hosts=("*",), roots=(), known_hosts: set[str] | None = None, known_roots: set[str] | None = None, limit: int | None = None, budget: int = LIMITS.response_bytes, excludes: tuple[str, ...] = ()) -> DataFrame:
    """host, path, kind, truncated: the first paths by host and path, at most `limit` (of a host too), within the byte budget."""
    files = select_hosts(files, hosts, known_hosts)
    if known_roots is not None:
        files = select_roots(files, roots, known_roots)
    limit = effective_limit(limit)
    found = cap_per_host(find_paths(files, pattern, excludes).distinct().withColumn("line_number", F.lit(0)), limit + 1)  # one more tells of truncation
    top = found.orderBy("host", "path").limit(limit + 1).withColumn("_all", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("_all").orderBy("host", "path"))
    top = top.withColumn("_k", rank).withColumn("_more", F.max("_k").over(Window.partitionBy("_all")) > limit).where(F.col("_k") <= limit)
    cut = within_budget(top, F.octet_length("path"), budget, ["_all"], ["host", "path"])
    return cut.select("host", "path", "kind", (F.col("truncated") | F.col("_more")).alias("truncated"))


def contained(paths: DataFrame, locations: DataFrame) -> DataFrame:
    """Paths (host, path) that are under one of their host's roots, by equal ancestors."""
    found = paths.select("host", "path").distinct().where(sound(F.col("path"))).select("host", "path", F.explode(ancestors(F.col("path"))).alias("_root")).join(_roots(locations), ["host", "_root"], "left_semi")
    return paths.join(found.select("host", "path").distinct(), ["host", "path"], "left_semi")


def _roots(locations: DataFrame) -> DataFrame:
    root = F.rtrim("path", F.lit("/"))
    return locations.select("host", F.when(root == "", "/").otherwise(root).alias("_root")).distinct()


def owners(paths: DataFrame, locations: DataFrame) -> DataFrame:
    """host, path, root of every path (host, path) that is under a root of its host (host, name, path): the longest one; of equal places the name by ordered_roots."""
    root = F.rtrim("path", F.lit("/"))
    places = ordered_roots(locations).select("host", F.when(root == "", "/").otherwise(root).alias("_root"), "rank", "name").groupBy("host", "_root").agg(F.min(F.struct("rank", "name"))["name"].alias("root"))
    rows = paths.select("host", "path").distinct().where(sound(F.col("path"))).select("host", "path", F.explode(ancestors(F.col("path"))).alias("_root")).join(places, ["host", "_root"])
    return rows.groupBy("host", "path").agg(F.max_by("root", F.length("_root")).alias("root"))


def owned(files: DataFrame, locations: DataFrame) -> DataFrame:
    """Files (host, root, path, ...) once each where roots overlap: the row of the root that owns the path. Only paths take part in the choice."""
    return files.join(owners(files, locations), ["host", "path", "root"], "left_semi")


def _children(files: DataFrame, directory: str, excludes: tuple[str, ...]) -> DataFrame:
    """host, name, path, kind, size, modified_ms, hidden of a directory's children; excluded ones are hidden. The directory itself, where files has a row of it, is a child without name."""
    base = directory.rstrip("/") + "/"
    itself = (F.col("path") == base.rstrip("/")) & (F.col("kind") == "directory")
    under = files.where(F.col("path").startswith(base) | itself).withColumn("rest", F.expr(f"substring(path, {len(base) + 1})"))
    under = under.withColumn("name", F.substring_index("rest", "/", 1)).withColumn("is_file", ~F.col("rest").contains("/"))
    one = under.groupBy("host", "name").agg(F.bool_and("is_file").alias("f"), F.max("kind").alias("k"), F.max("size").alias("s"), F.max("modified_ms").alias("m"))
    one = one.withColumn("kind", F.when(F.col("f"), F.col("k")).otherwise("directory"))
    when_file = lambda c: F.when(F.col("kind") == "file", F.col(c))
    hidden = excluded(F.concat(F.lit(base.lstrip("/")), F.col("name")), all_excludes(excludes))
    return one.select("host", "name", F.concat(F.lit(base), "name").alias("path"), "kind", when_file("s").alias("size"), when_file("m").alias("modified_ms"), hidden.alias("hidden"))


def list_directory(files: DataFrame, directory: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """host, name, path, kind, size, modified_ms of a directory's children; size and time for files only. Kinds are those of files, whose rows may be whole trees (sources.tree)."""
    return _children(files, directory, excludes).where("not hidden and name <> ''").drop("hidden")


def browse(files: DataFrame, locations: DataFrame, host: str, directory: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """A host's directory in order of names: name, path, kind, size, modified_ms, error. A directory outside of the host's roots, excluded, or
    that isn't one gives a single row with its error. Files and locations are read once each."""
    asked = F.lit(directory.rstrip("/") or "/")
    places = locations.where((F.col("host") == host) & within(asked, F.col("path")))
    said = places.agg((F.count("*") > 0).alias("inside"), F.coalesce(F.max(F.col("path") == asked), F.lit(False)).alias("is_root"))  # one row
    refused = F.when(~F.col("inside"), "outside the roots").when(excluded(F.lit(directory.strip("/")), all_excludes(excludes)), "excluded")
    said = said.select(refused.alias("refused"), "is_root")
    rows = said.join(_children(files.where(F.col("host") == host), directory, excludes).drop("host"), F.col("refused").isNull(), "left")
    error = F.coalesce("refused", F.when(F.col("name").isNull() & ~F.col("is_root"), "not a directory"))
    return rows.withColumn("error", error).where("error is not null or (not hidden and name <> '')").select("name", "path", "kind", "size", "modified_ms", "error").orderBy("name")


def read_lines(requests: DataFrame, files: DataFrame, max_bytes: int = LIMITS.max_file_bytes, excludes: tuple[str, ...] = (), locations: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """request_id, host, path, start_line, end_line, data, truncated, error for requests (request_id, host, path, start, end); end may be null.

    With locations, a path has to be under one of its host's roots. With a budget, data is cut after the last line that fits. Only files that
    are asked for go through the join; where the requests are small enough to broadcast, no text is shuffled.
    """
    readable = files.where(~excluded(F.col("rel_path"), all_excludes(excludes))).select("host", "path", "size", "text")
    readable = readable.join(requests.select("host", "path").distinct(), ["host", "path"], "left_semi").dropDuplicates(["host", "path"])  # a file under several roots is one
    rows = requests.join(readable, ["host", "path"], "left")
    outside = F.col("path").rlike(r"(^|/)\.\.(/|$)")
    if locations is not None:
        roots = locations.groupBy("host").agg(F.collect_set("path").alias("_roots"))  # a host's few roots
        rows = rows.join(roots, "host", "left")
        outside = outside | ~F.coalesce(F.exists("_roots", lambda r: within(F.col("path"), r)), F.lit(False))
    error = F.when(outside, "outside the roots").when(F.col("text").isNull(), "not found").when(F.col("size") > max_bytes, "too large")
    rows = rows.withColumn("error", error).withColumn("lines", F.when(F.col("error").isNull(), lines_of(F.col("text"))))
    n = F.size("lines")
    start = F.greatest(F.coalesce("start", F.lit(1)), F.lit(1))
    end = clamp(F.coalesce("end", n), start, F.greatest(n, start))
    rows = rows.withColumn("s", F.when(F.col("error").isNull(), start)).withColumn("e", F.when(F.col("error").isNull(), end))
    rows = rows.withColumn("lines", F.when(F.col("error").isNull(), F.slice("lines", F.col("s"), F.col("e") - F.col("s") + 1)))
    rows = rows.withColumn("truncated", F.lit(False))
    if budget is not None:
        add = lambda s, x: F.struct((s["bytes"] + F.octet_length(x) + 1).alias("bytes"), (s["n"] + F.when(s["bytes"] + F.octet_length(x) + 1 <= budget, 1).otherwise(0)).alias("n"))
        fits = F.aggregate("lines", F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n")), add)["n"]
        rows = rows.withColumn("fits", fits).withColumn("truncated", F.coalesce(F.col("fits") < F.size("lines"), F.lit(False))).withColumn("lines", F.slice("lines", F.lit(1), F.col("fits")))
        rows = rows.withColumn("e", F.when(F.col("truncated"), F.col("s") + F.col("fits") - 1).otherwise(F.col("e")))
    return rows.select("request_id", "host", "path", F.col("s").cast("int").alias("start_line"), F.col("e").cast("int").alias("end_line"), F.array_join("lines", "\n").alias("data"), "truncated", "error")


def ordered_roots(locations: DataFrame) -> DataFrame:
    """host, path, name: a path once, under the first of home, opt, etc, local or any other name, with its rank."""
    rank = F.expr("case name when 'home' then 0 when 'opt' then 1 when 'etc' then 2 when 'local' then 3 else 4 end")
    firsts = locations.groupBy("host", "path").agg(F.min(F.struct(rank.alias("rank"), F.col("name"))).alias("first"))
    return firsts.select("host", "path", F.col("first.name").alias("name"), F.col("first.rank").alias("rank"))
