"""Line dedup by site-relative frequency, in DataFrame functions only.

A page's distinct lines count once; a line is boilerplate of its host where the share of the host's pages
that have it exceeds `ratio`. A line that only one page has repeats nowhere and stays, on a host of one page too. Lines are counted by their
64-bit hash, with partial counts before the shuffle, so a host of any size spreads over lines. A host's list has fewer than
(mean lines of a page / ratio) hashes, whatever its size. The list joins the pages by host: broadcast only where its measured
size allows, else a join that splits hot hosts. A page meets the list by hashing, and its lines only what is in both.

Rows: null text: no lines, text stays null. Empty and blank lines are never boilerplate. Null host: no site, nothing dropped. Repeated
rows are pages of their own. A page of boilerplate only becomes an empty text. Very long texts: whole. Ties (a share of just `ratio`): the line
stays. Empty table: no rows. All columns stay, whatever their names; `n_lines`, `n_dropped` are added (in place of such).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stage

RATIO = 0.05


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float) -> DataFrame:
    """(host, drop): the hashes of each host's boilerplate lines."""
    rows = pages.where(F.col(f"`{host}`").isNotNull()).select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    lines = rows.select("host", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where(F.trim("line") != "")
    seen = lines.groupBy("host", F.xxhash64("line").alias("hash")).agg(F.count("*").alias("n")).where("n > 1")
    often = seen.join(totals, "host").where(F.col("n") > F.col("pages") * F.lit(ratio))
    return often.groupBy("host").agg(F.collect_set("hash").alias("drop"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, counts: bool = True) -> DataFrame:
    """pages without their hosts' boilerplate lines; `counts` adds n_lines and n_dropped."""
    lists = stage(boilerplate(pages, host, text, ratio), "boilerplate")
    pages = pages.drop("n_lines", "n_dropped") if counts else pages
    said = lambda name: F.col("page").getField(name)  # noqa: E731  a page is one column, so that its names meet no others
    joined = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page")).join(lists, said(host) == F.col("host"), "left")
    joined = joined.withColumn("lines", F.split(said(text), "\n", -1))
    joined = joined.withColumn("bad", F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), "drop"))
    kept = F.filter("lines", lambda x: ~F.array_contains("bad", F.xxhash64(x)) | (F.trim(x) == ""))
    out = joined.withColumn("kept", F.when(F.size("bad") > 0, kept).otherwise(F.col("lines")))
    rest = [(F.array_join("kept", "\n") if c == text else said(c)).alias(c) for c in pages.columns]
    if not counts:
        return out.select(*rest)
    n_lines, n_kept = (F.coalesce(F.when(said(text).isNotNull(), F.size(c)), F.lit(0)) for c in ("lines", "kept"))
    return out.select(*rest, n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped"))
