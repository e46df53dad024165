"""Line search: hits, context, merged ranges, caps, budgets and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.patterns import PatternError, check_regex, exclude_regex, excluded, ignore_glob, included
from corpuslens.functions.text import binary, lines_of, loc, match_column, matches
from corpuslens.operators import index_store
from corpuslens.operators.ranges import running_sums
from corpuslens.options import LIMITS, all_excludes
from corpuslens.sources.shared import new_path

ORDER = ["host", "path", "line_number"]


@dataclass(frozen=True)
class Search:
    query: str
    mode: str = "literal"
    hosts: tuple[str, ...] = ("*",)
    roots: tuple[str, ...] = ()
    path_globs: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()  # added to the fixed ones
    context_lines: int = LIMITS.context_lines
    limit: int | None = None
    max_file_bytes: int = LIMITS.max_file_bytes


def select_hosts(files: DataFrame, hosts: tuple[str, ...], known: set[str] | None = None, local: str = "local") -> DataFrame:
    """'*' alone is every host; an unknown one, and '*' among others, is an error where the known ones are given."""
    if tuple(hosts) == ("*",):
        return files
    wanted = list(dict.fromkeys(local if h == "local" else h for h in hosts))
    if known is not None and (bad := [h for h in wanted if h not in known]):
        raise ValueError(f"unknown host {bad[0]}")
    return files.where(F.col("host").isin(wanted))


def select_roots(files: DataFrame, roots: tuple[str, ...], known: set[str], strict: bool = False) -> DataFrame:
    """Roots by name or by an absolute path; none, or any unknown name, is every root but 'local'."""
    unknown = [r for r in roots if r not in known and not r.startswith("/")]
    if strict and unknown:
        raise ValueError(f"unknown root {unknown[0]}")
    if not roots or unknown:
        return files.where(F.col("root") != "local")
    keep = F.lit(False)
    for r in roots:
        keep = keep | (F.col("root") == r if r in known else (F.col("path") == r) | F.col("path").startswith(r.rstrip("/") + "/"))
    return files.where(keep)


def candidate_files(files: DataFrame, search: Search) -> DataFrame:
    """Files that may have a hit. A literal without a newline that a line holds is held by its file too, so the test
    on whole texts is added below the split, where the scan can use it."""
    if not search.query.strip():
        raise ValueError("the query is blank")
    if search.mode == "regex":
        check_regex(files.sparkSession, search.query)
    files = select_hosts(files, search.hosts)
    files = files.where(~excluded(F.col("rel_path"), all_excludes(search.excludes)) & included(F.col("rel_path"), search.path_globs))
    if search.max_file_bytes:
        files = files.where(F.col("size") <= search.max_file_bytes)
    files = files.where(~binary(F.col("text")))
    if search.mode != "regex" and "\n" not in search.query:
        files = files.where(matches(F.col("text"), search.query, search.mode))
    return files


def find_hits(files: DataFrame, search: Search) -> DataFrame:
    """host, root, path, line_number, text, column, context of every matching line."""
    rows = candidate_files(files, search).select("host", "root", "path", lines_of(F.col("text")).alias("lines"))
    rows = rows.select("*", F.posexplode("lines").alias("k", "text")).where(matches(F.col("text"), search.query, search.mode))
    column = match_column(F.col("text"), search.query, search.mode).alias("column")
    return rows.select("host", "root", "path", (F.col("k") + 1).cast("int").alias("line_number"), "text", column, _context(F.col("k"), search.context_lines).alias("context"))


def _context(k: Column, c: int) -> Column:
    """Numbered lines around the line at k, of the array `lines`."""
    first = F.greatest(k - c, F.lit(0))
    texts = F.slice("lines", first + 1, k - first + 1 + c)
    return F.transform(texts, lambda x, i: F.struct((first + i + 1).cast("int").alias("line_number"), x.alias("text")))


def hit_keys(files: DataFrame, search: Search) -> DataFrame:
    """host, path, line_number of every matching line: nothing else of a hit is carried along."""
    rows = candidate_files(files, search).select("host", "path", F.posexplode(lines_of(F.col("text"))).alias("k", "line"))
    return rows.where(matches(F.col("line"), search.query, search.mode)).select("host", "path", (F.col("k") + 1).cast("int").alias("line_number"))


def with_context(keys: DataFrame, files: DataFrame, search: Search) -> DataFrame:
    """Hits (as find_hits gives them) at these few keys, LIMITS.max_results at most: only their files are read again.

    The keys are known on the driver, so that their paths are a filter of the scan. A file under several roots is read under the first of them.
    """
    found = keys.select(*ORDER).limit(LIMITS.max_results).collect()
    few = F.broadcast(files.sparkSession.createDataFrame([tuple(r) for r in found], keys.select(*ORDER).schema).groupBy("host", "path").agg(F.collect_list("line_number").alias("numbers")))
    rows = files.where(F.col("path").isin(sorted({r["path"] for r in found})) & F.col("host").isin(sorted({r["host"] for r in found}))).select("host", "root", "path", "text").join(few, ["host", "path"])
    rows = rows.groupBy("host", "path").agg(F.min(F.struct("root", "text")).alias("f"), F.first("numbers").alias("numbers")).select("host", "f.root", "path", lines_of(F.col("f.text")).alias("lines"), F.explode("numbers").alias("line_number"))
    rows = rows.withColumn("text", F.element_at("lines", F.col("line_number")))
    column = match_column(F.col("text"), search.query, search.mode).alias("column")
    return rows.select("host", "root", "path", "line_number", "text", column, _context(F.col("line_number") - 1, search.context_lines).alias("context"))


def join_context(hits: DataFrame, lines: DataFrame, c: int) -> DataFrame:
    """Hits with the lines around them, where lines are stored.

    Line numbers are dealt into bands as wide as a context, so a hit's context lies in two bands at most: files and bands meet by equality, and a
    file of any length costs what its hits do.
    """
    width = 2 * c + 1
    band = lambda n: F.floor(n / F.lit(width))
    near = lines.select("host", "path", band(F.col("line_number")).alias("_band"), F.col("line_number").alias("context_line"), F.col("text").alias("context_text"))
    bands = F.explode(F.sequence(band(F.col("line_number") - c), band(F.col("line_number") + c)))
    met = hits.withColumn("_band", bands).join(near, ["host", "path", "_band"]).drop("_band")
    return met.where(F.col("context_line").between(F.col("line_number") - c, F.col("line_number") + c))


def dedup_hits(hits: DataFrame) -> DataFrame:
    """One row for each host, path and line; the smallest text."""
    w = Window.partitionBy(*ORDER).orderBy("text")
    return hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def cap_per_host(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("host").orderBy("path", "line_number")
    return hits.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def effective_limit(limit: int | None, max_results: int = LIMITS.max_results) -> int:
    return min(max_results if limit is None else limit, max_results)


def top_hits(hits: DataFrame, limit: int | None = None, max_results: int = LIMITS.max_results) -> DataFrame:
    return hits.orderBy(*ORDER).limit(effective_limit(limit, max_results))


def truncated_hosts(hits: DataFrame, k: int) -> DataFrame:
    """(host, n_hits, truncated): truncated where more than k match."""
    return hits.groupBy("host").agg(F.count("*").alias("n_hits")).withColumn("truncated", F.col("n_hits") > k)


def within_budget(rows: DataFrame, size: Column, budget: int, keys: list[str], order: list) -> DataFrame:
    """The longest prefix of each key's rows whose sizes fit, and `truncated` for the key. Rows should be capped before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum(size).over(w))
    return summed.withColumn("truncated", F.max("_sum").over(Window.partitionBy(*keys)) > budget).where(F.col("_sum") <= budget).drop("_sum")


def within_budget_spread(rows: DataFrame, size: Column, budget: int, keys: list[str], order: list) -> DataFrame:
    """within_budget() of rows that weren't capped before: sums are dealt over ranges of a key."""
    return running_sums(rows, size, keys, order, budget).withColumn("truncated", F.col("_total") > budget).drop("_sum", "_total")


def compact(hits: DataFrame) -> DataFrame:
    """host, path, start_line, end_line, loc, data: hits with context merged where they touch; each line once.

    Islands: a range opens where it starts after every earlier end by more than a line.
    """
    spans = hits.select("host", "path", F.element_at("context", 1)["line_number"].alias("start"), F.element_at("context", -1)["line_number"].alias("end"), "context")
    w = Window.partitionBy("host", "path").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= before + 1, 0).otherwise(1)
    islands = spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = islands.groupBy("host", "path", "island").agg(F.min("start").cast("int").alias("start_line"), F.max("end").cast("int").alias("end_line"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("context")))).alias("lines"))
    return ranges.select("host", "path", "start_line", "end_line", loc(F.col("start_line"), F.col("end_line")).alias("loc"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("data"))


def compact_spread(hits: DataFrame) -> DataFrame:
    """compact() where a file may have more hits than a task should hold.

    Spans are dealt into ranges by file and start. What a range must know of the ones before it, the furthest end and the number of islands opened, is a
    row a range; so islands that go on over ranges are stitched, and only the lines of one island come together, as its text.
    """
    spans = hits.select("host", "path", F.element_at("context", 1)["line_number"].alias("start"), F.element_at("context", -1)["line_number"].alias("end"), "context")
    at = new_path(hits.sparkSession, "spans")
    spans.repartitionByRange("host", "path", "start", "end").withColumn("_range", F.spark_partition_id()).write.parquet(at)  # stored, so that ranges stay as they are
    dealt, file = hits.sparkSession.read.parquet(at), ["host", "path"]
    earlier = Window.partitionBy(*file).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*file, "_range").agg(F.max("end").alias("_far")).withColumn("_far", F.max("_far").over(earlier))
    here = Window.partitionBy(*file, "_range").orderBy("start", "end")
    before = F.greatest(F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    opened = dealt.join(ends, [*file, "_range"]).withColumn("opens", F.when(F.col("start") <= before + 1, 0).otherwise(1))
    sums = opened.groupBy(*file, "_range").agg(F.sum("opens").alias("_n")).withColumn("_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    islands = opened.join(sums, [*file, "_range"]).withColumn("island", F.col("_n") + F.sum("opens").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    lines = islands.select(*file, "island", F.explode("context").alias("line")).distinct()
    ranges = lines.groupBy(*file, "island").agg(F.min("line.line_number").cast("int").alias("start_line"), F.max("line.line_number").cast("int").alias("end_line"), F.array_sort(F.collect_list("line")).alias("lines"))
    return ranges.select(*file, "start_line", "end_line", loc(F.col("start_line"), F.col("end_line")).alias("loc"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("data"))


def show_hosts(ranges: DataFrame) -> DataFrame:
    """`host` only where its path is found on several hosts."""
    many = ranges.groupBy("path").agg(F.count_distinct("host").alias("n_hosts"))
    return ranges.join(many, "path").withColumn("shown_host", F.when(F.col("n_hosts") > 1, F.col("host"))).drop("n_hosts")


def preview(lines: DataFrame, hits: DataFrame, max_lines: int = LIMITS.preview_lines, max_bytes: int = LIMITS.preview_bytes) -> DataFrame:
    """host, path, from_line, n_lines, n_bytes, truncated: what a preview from each hit's line shows."""
    # A line more than are shown tells whether there is more. Lines and hits meet by bands of so many lines.
    band = lambda n: F.floor(n / F.lit(max_lines + 1))
    first = F.col("line_number")
    start = hits.select("host", "path", first.alias("from_line"), F.explode(F.sequence(band(first), band(first + max_lines))).alias("_band"))
    rows = lines.withColumn("_band", band(first)).join(start, ["host", "path", "_band"]).drop("_band").where((F.col("line_number") >= F.col("from_line")) & (F.col("line_number") <= F.col("from_line") + max_lines))
    w = Window.partitionBy("host", "path", "from_line").orderBy("line_number")
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("bytes", F.sum(F.octet_length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("k") <= max_lines) & (F.col("bytes") <= max_bytes)
    return rows.groupBy("host", "path", "from_line").agg(F.count_if(fits).alias("n_lines"), F.coalesce(F.max(F.when(fits, F.col("bytes"))), F.lit(0)).alias("n_bytes"), F.bool_or(~fits).alias("truncated"))


def _pieces(text: Column, n: int) -> Column:
    """Distinct pieces of n letters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


#: Of a query: what every line that holds it has among its own keys of that kind. Words inside a query are whole words of such a line; shorter ones go by pieces.
_QUERY_KEYS = {
    "word": lambda q: F.array_distinct(F.filter(F.slice(F.split(q, " "), F.lit(2), F.greatest(F.size(F.split(q, " ")) - 2, F.lit(0))), lambda x: x != "")),
    "three": lambda q: _pieces(q, 3),
    "two": lambda q: F.array(q),
    "one": lambda q: F.array(q),
}
_LINE_KEYS = {"word": lambda t: F.array_distinct(_words(t)), "three": lambda t: _pieces(t, 3), "two": lambda t: _pieces(t, 2), "one": lambda t: _pieces(t, 1)}


def _meet(texts: DataFrame, rows: DataFrame, few) -> DataFrame:
    """query and the columns of every row (text) that holds it. A query stands for itself by its rarest three letters, counted on the rows, or as a whole where it is shorter."""
    length = F.length("query")
    out = None
    for name, some in (("three", length > 2), ("two", length == 2), ("one", length == 1)):
        keyed = texts.where(some).select("query", F.explode(_QUERY_KEYS[name](F.col("query"))).alias("key"))
        if name == "three":
            counts = rows.select(F.explode(_LINE_KEYS[name](F.col("text"))).alias("key")).join(few(keyed.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
            # A query with a key that no row has matches nothing.
            keyed = keyed.join(counts, "key", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("rarest")).where("rarest.n > 0").select("query", "rarest.key")
        met = rows.withColumn("key", F.explode(_LINE_KEYS[name](F.col("text")))).join(few(keyed), "key").where(F.contains("text", "query")).drop("key")
        out = met if out is None else out.unionByName(met)
    return out


def _stored(df: DataFrame, name: str) -> DataFrame:
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def multi_search(queries: DataFrame, lines: DataFrame, letters: int = 8_000_000) -> DataFrame:
    """query_id, host, path, line_number, text of every line that holds a literal query (query_id, query); blank queries, and such with a newline, match nothing.

    The lines' words are counted once. A query stands for itself by its rarest word inside it; where it has none, by all words that hold its rarest part, which are looked
    for among the distinct words and not on the lines. Lines meet the queries by an equal word and are verified. Queries are only broadcast while they have at most `letters` letters.
    """
    wanted = queries.where("trim(query) <> '' and not contains(query, '\n')").select("query_id", "query").distinct()
    texts = wanted.select("query").distinct()
    lines = lines.select("host", "path", "line_number", "text")
    size = texts.agg(F.sum(F.length("query"))).first()[0]
    if size is None:
        return lines.withColumn("query", F.lit("")).limit(0).join(wanted, "query").select("query_id", *lines.columns)
    few = (lambda df: F.broadcast(df)) if size <= letters else (lambda df: df)
    words = _stored(lines.select(F.explode(_LINE_KEYS["word"](F.col("text"))).alias("text")).groupBy("text").agg(F.count("*").alias("n")), "words")
    inside = _QUERY_KEYS["word"](F.col("query"))
    rarest = lambda rows, c: rows.groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), c)).alias("rarest")).where("rarest.n > 0").select("query", f"rarest.{c}")
    whole = rarest(texts.select("query", F.explode(inside).alias("key")).join(words.withColumnRenamed("text", "key"), "key", "left"), "key")
    parts = texts.where(F.size(inside) == 0).select("query", F.explode(F.array_distinct(_words(F.col("query")))).alias("part"))
    held = _stored(_meet(parts.select(F.col("part").alias("query")).distinct(), words, few).withColumnsRenamed({"query": "part", "text": "key"}), "held")
    best = rarest(parts.join(held.groupBy("part").agg(F.sum("n").alias("n")), "part", "left"), "part")
    keyed = _stored(whole.withColumn("part", F.lit(None).cast("string")).unionByName(best.join(held.select("part", "key"), "part").select("query", "key", "part")), "keyed")
    size = keyed.agg(F.sum(F.length("query") + F.length("key"))).first()[0] or 0
    met = lines.withColumn("key", F.explode(_LINE_KEYS["word"](F.col("text")))).join(F.broadcast(keyed) if size <= letters else keyed, "key").where(F.contains("text", "query"))
    # Of a line's words that hold a part, the first one counts.
    first = F.filter(_words(F.col("text")), lambda x: F.contains(x, F.col("part")))[0]
    met = met.where(F.col("part").isNull() | (F.col("key") == first)).drop("key", "part")
    return met.join(few(wanted), "query").select("query_id", *lines.columns)


def request_error(search: Search, spark) -> str | None:
    """What is wrong with a request's patterns; None where nothing is."""
    try:
        if search.mode == "regex":
            check_regex(spark, search.query)
        for glob in search.path_globs:
            ignore_glob(glob)
        exclude_regex(search.excludes)
    except PatternError as e:
        return str(e)
    return None


def search_text(
    files: DataFrame, search: Search, known_roots: set[str] | None = None, known_hosts: set[str] | None = None, budget: int = LIMITS.response_bytes, verbose: bool = False,
    index: index_store.Snapshot | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, status): the first hits by host, path and line, merged to ranges within the byte budget, or as they are (`verbose`);
    and of each host, in order: host, ok, error, n_hits, truncated.

    A blank query, and a host that isn't known, are errors. A bad regex or glob is a failed status of every host, without results. Hits are
    found, capped and ordered as keys; lines around them are read for those that are left. With an index, files that it knows as they are, under a root that is ready, are only
    read where they are among its candidates; all others are scanned.
    """
    if not search.query.strip():
        raise ValueError("the query is blank")
    limit = effective_limit(search.limit)
    files = select_hosts(files, search.hosts, known_hosts)
    if known_roots is not None:
        files = select_roots(files, search.roots, known_roots)
    everywhere = files.select("host").distinct()
    if error := request_error(search, files.sparkSession):
        status = everywhere.select("host", F.lit(False).alias("ok"), F.lit(error).alias("error"), F.lit(0).cast("long").alias("n_hits"), F.lit(False).alias("truncated"))
        rows = find_hits(files, Search("x", context_lines=search.context_lines)).limit(0)
        return (rows if verbose else show_hosts(compact(rows)).withColumn("truncated", F.lit(False))), status.orderBy("host")
    if index is not None:
        files = files.join(index_store.files_to_read(files, index, search.query, search.mode), index_store.KEY, "left_semi").select(*files.columns)
    keys = hit_keys(files, search).distinct()  # a file under several roots counts once
    counts = everywhere.join(truncated_hosts(keys, limit), "host", "left")
    status = counts.select("host", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("truncated", F.lit(False)).alias("truncated")).orderBy("host")
    hits = with_context(top_hits(cap_per_host(keys, limit), limit), files, search)
    if verbose:
        return within_budget(hits.withColumn("_all", F.lit(1)), F.octet_length("text"), budget, ["_all"], ORDER).drop("_all"), status
    ranges = show_hosts(compact(hits))
    ranges = within_budget(ranges.withColumn("_all", F.lit(1)), F.octet_length("data"), budget, ["_all"], ["host", "path", "start_line"]).drop("_all")
    return ranges, status
