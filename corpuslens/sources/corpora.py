"""Corpora as one table of files: host, root, path, rel_path, kind, size, modified_ms, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.patterns import excluded
from corpuslens.functions.text import lines_of, strip_cr
from corpuslens.options import LIMITS, all_excludes
from corpuslens.sources.shared import new_path

FILES = ["host", "root", "path", "rel_path", "kind", "size", "modified_ms", "text"]


def scan_files(spark: SparkSession, host: str, roots: dict[str, str], excludes: tuple[str, ...] = (), max_bytes: int = LIMITS.max_file_bytes, with_content: bool = True) -> DataFrame:
    """Regular files under named roots. Excluded and larger files go before their content is read; binary and non-UTF-8 ones after.

    with_content=False lists files only: the content column isn't read at all.
    """
    out = None
    for name, root in sorted(roots.items()):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)  # one may go while others are read
        at = F.regexp_replace("path", "^[a-zA-Z]+:/{1,3}", "/")
        base = "/" + root.split("://", 1)[-1].strip("/") + "/"
        files = files.withColumn("path", at).withColumn("rel_path", F.expr(f"substring(path, {len(base) + 1})"))
        files = files.where(~excluded(F.col("rel_path"), all_excludes(excludes)))
        if max_bytes:
            files = files.where(F.col("length") <= max_bytes)
        text = F.lit(None).cast("string")
        if with_content:
            files = files.where(F.is_valid_utf8(F.col("content").cast("string")) & (F.locate("\0", F.col("content").cast("string")) == 0))
            text = F.col("content").cast("string")
        part = files.select(F.lit(host).alias("host"), F.lit(name).alias("root"), "path", "rel_path", F.lit("file").alias("kind"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), text.alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def scan_lines(spark: SparkSession, host: str, roots: dict[str, str], excludes: tuple[str, ...] = ()) -> DataFrame:
    """host, root, path, line_number, text of every line of text files under named roots, of any size: files are read in splits, never as a row.

    A line's number is its place in its split and the lines of the file's earlier splits. Lines are stored with their split first, so that splits stay as they
    were read. Files with a NUL, or that aren't UTF-8, have no lines. Line ends are those of lines_of.
    """
    out = None
    for name, root in sorted(roots.items()):
        rows = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(root)
        base = "/" + root.split("://", 1)[-1].strip("/") + "/"
        # The file name is a URI: blanks and the like are escaped in it.
        at = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^[a-zA-Z]+:/{1,3}", "/"), F.lit("+"), F.lit("%2B")))
        rows = rows.select(at.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("k"), "value")
        rows = rows.where(~excluded(F.expr(f"substring(path, {len(base) + 1})"), all_excludes(excludes)))
        part = rows.select(F.lit(name).alias("root"), "path", "start", "k", "value", (~F.is_valid_utf8("value") | (F.locate("\0", "value") > 0)).alias("bad"))
        out = part if out is None else out.unionByName(part)
    place = new_path(spark, "lines")
    out.write.parquet(place)
    stored = spark.read.schema(out.schema).parquet(place)
    file = ["root", "path"]
    splits = stored.groupBy(*file, "start").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.bool_or("bad").alias("bad"))
    earlier = Window.partitionBy(*file).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("root", "path", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.bool_or("bad").over(Window.partitionBy(*file)).alias("_bad"))
    # Within a split ids go on by one: a task reads it from end to end. Splits are a row each, so that lines stay where they are.
    rows = stored.drop("bad").join(F.broadcast(splits.where("NOT _bad")), [*file, "start"])
    return rows.select(F.lit(host).alias("host"), "root", "path", (F.col("before") + F.col("k") - F.col("first") + 1).cast("int").alias("line_number"), strip_cr(F.col("value")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rel = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("source").alias("host"),
        F.col("lang").alias("root"),
        F.concat(F.lit("/corpus/"), F.col("lang"), F.lit("/"), rel).alias("path"),
        rel.alias("rel_path"),
        F.lit("file").alias("kind"),
        F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 1000).alias("modified_ms"),
        "text",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a page: the URL's host, its first segment as root, its path without query."""
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)(/[^?#]*)?", 2)
    root = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)", 1)
    rel = F.concat(F.expr("substring(p, length(r) + 3)"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    table = table.withColumn("p", at).withColumn("r", root)
    return table.select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.col("r").alias("root"), F.concat(F.lit("/"), "r", F.lit("/"), rel).alias("path"), rel.alias("rel_path"), F.lit("file").alias("kind"), F.octet_length("html").cast("long").alias("size"), (F.col("page_id") * 1000).alias("modified_ms"), F.col("html").alias("text"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host (role), path, line_number, text: a turn is a line."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return table.select(F.col("role").alias("host"), F.concat(F.lit("/chat/"), F.col("conv_id").cast("string"), F.lit(".log")).alias("path"), (F.col("turn") + 1).cast("int").alias("line_number"), "text")


def lines(files: DataFrame) -> DataFrame:
    """host, root, path, line_number, text of every line."""
    numbered = files.select("host", "root", "path", F.posexplode(lines_of(F.col("text"))).alias("k", "text"))
    return numbered.select("host", "root", "path", (F.col("k") + 1).cast("int").alias("line_number"), "text")


def locations(spark: SparkSession, hosts: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(host, name, path) of configured named roots."""
    rows = [(host, name, path) for host, roots in hosts.items() for name, paths in roots.items() for path in paths]
    return spark.createDataFrame(rows, "host string, name string, path string")


def corpus_locations(files: DataFrame) -> DataFrame:
    """(host, name, path): the roots that files are under."""
    prefix = F.expr("substring(path, 1, length(path) - length(rel_path) - 1)")
    return files.select("host", F.col("root").alias("name"), prefix.alias("path")).distinct()


MANIFEST = "schema_version int, generated_at_ms long, backups array<struct<completed_at_ms: long, object_count: long, byte_count: long>>, _corrupt_record string"
REGISTRY = "host_id string, local_url string, peer_url string, advertise_url string, routable_url string, endpoint string, capabilities array<string>, roots array<string>, generation long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's row; none where the file is missing, malformed or lacks a required field."""
    try:
        rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST).drop("_corrupt_record")
    return rows.where("_corrupt_record is null and schema_version is not null and generated_at_ms is not null and backups is not null").drop("_corrupt_record")


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A provider's nodes: one JSON array, or a node a line; fields that aren't known are left out."""
    return spark.read.schema(REGISTRY).option("multiLine", not lines).json(path)
