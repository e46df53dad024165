"""Substring dedup: seed and extend.

Seeds: winnowing with GRAM-word grams and windows of `length - GRAM + 1` grams gives every `length`-word window
exactly one anchor (its smallest gram hash), which depends on the window's words alone: equal windows have equal anchors.
An anchor stands for a run of windows. Documents are joined on their anchors: each occurrence meets the anchor's first one.

Extension: occurrences of one document that meet one document on the same diagonal are a chain. Its words and those on
the other side are laid side by side, and the matches go on to both sides of the anchors as far as the words are equal; maximal
repeats of `length` words or more are cut.

No pairs within a group are made, so a window that isn't equal to its anchor's first occurrence may still be equal to another one.
Such windows (and the first occurrence's own of that run) meet by 128 bits of a cryptographic hash of their words, each one
with the smallest document among the equal ones: no repeat is lost.

Rows: null doc_id: the row comes back whole and is never a copy's original. Null or empty text: no words. Very long texts: whole.
Repeated rows: each comes back; equal doc_ids (ties) aren't smaller than each other. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Rolling, batches, raw, stage, unstage, word_hashes

GRAM = 18
#: Where a chain's words begin and end on the other side is rounded to this, so that many chains ask for the same words.
ROUND = 64


def anchors(words: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """hash, first window, number of windows and place (of the first window's anchor), for every run of windows with one anchor.

    A window's anchor is the smallest hash of its grams; of equal ones the first.
    """
    n = len(words)
    place = np.arange(n - gram + 1)
    least, wide, have = Rolling(words).span(place, place + gram), length - gram + 1, 1
    while have < wide:
        step = min(have, wide - have)
        left = least[:-step] <= least[step:]
        least, place = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:])
        have += step
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[first], first, np.diff(np.concatenate([first, [len(least)]])), place[first]


def _scan(length: int):
    def run(it):
        for batch in batches(it):
            counts, shas, parts, ends = [], [], [], [0]
            for text in raw(batch["text"]):
                words = text.split()
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) >= length:
                    parts.append(anchors(word_hashes(text), length))
                ends.append(ends[-1] + (len(parts[-1][0]) if len(words) >= length else 0))
            h, start, n, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else np.empty((4, 0), np.uint64)
            items = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (start, n, at))], ["h", "start", "n", "at"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tkey"], pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["doc_id", "tkey", "n_words", "sha", "anchors"])

    return run


RUNS = "array<struct<start:int,n:int,rstart:int,rn:int>>"
REGION = f"doc_id long, tkey long, rdoc long, rtkey long, rlow int, rhigh int, low int, diagonal int, runs {RUNS}, words binary"


def _regions(it):
    """The words between each need's bounds, joined by a space."""
    names = ["doc_id", "tkey", "rdoc", "rtkey", "rlow", "rhigh", "low", "diagonal", "runs"]
    for batch in batches(it):
        take, words, ends = [], [], np.asarray(batch["needs"].value_lengths())
        needs = batch["needs"].flatten()
        bounds = iter(zip(needs.field("low").to_pylist(), needs.field("high").to_pylist(), strict=True))
        for text, n in zip(raw(batch["text"]), ends.tolist(), strict=True):
            every = text.split()
            for low, high in (next(bounds) for _ in range(n)):
                words.append(b" ".join(every[max(low, 0) : high]))
        take = pa.array(np.repeat(np.arange(len(ends)), ends))
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["tkey"].take(take), *(needs.field(c) for c in names[2:]), pa.array(words, pa.binary())], [*names, "words"])


def _extend(length: int):
    """(doc_id, tkey, start, size): maximal repeats; and with a hash instead of a size the windows that are still to meet others."""

    def run(it):
        for batch in batches(it):
            out = []
            for r in batch.to_pylist():
                diagonal, mine, theirs = r["diagonal"], r["words"].split(), r["rwords"].split()
                low, rlow = max(r["low"], 0), max(r["rlow"], 0)
                start, stop = max(low, rlow + diagonal), min(low + len(mine), rlow + len(theirs) + diagonal)
                equal = np.zeros(max(stop - start, 0) + 2, bool)
                equal[1:-1] = [a == b for a, b in zip(mine[start - low : stop - low], theirs[start - diagonal - rlow :], strict=False)]
                edges = np.flatnonzero(equal[1:] != equal[:-1]) + start
                repeats = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= length]
                if r["doc_id"] > r["rdoc"]:
                    out += [(r["doc_id"], r["tkey"], a, b - a, None) for a, b in repeats]
                for x in r["runs"]:
                    left = set(range(x["start"], x["start"] + x["n"]))
                    for a, b in repeats:
                        left.difference_update(range(a, b - length + 1))
                    if left:
                        own = [(r["doc_id"], r["tkey"], k, mine[k - low : k - low + length]) for k in left]
                        first = [(r["rdoc"], r["rtkey"], k, theirs[k - rlow : k - rlow + length]) for k in range(x["rstart"], x["rstart"] + x["rn"])]
                        out += [(d, t, k, None, hashlib.blake2b(b" ".join(ws), digest_size=16).digest()) for d, t, k, ws in own + first]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], ["doc_id", "tkey", "start", "size", "wh"])

    return run


def _cut(keep_text: bool):
    def run(it):
        for batch in batches(it):
            removed, shas, texts = [], [], []
            for text, spans in zip(raw(batch["text"]), batch["spans"].to_pylist(), strict=True):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, [s["start"] for s in spans], 1)
                np.add.at(step, [s["start"] + s["size"] for s in spans], -1)
                keep = np.cumsum(step[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                removed.append(int(len(words) - keep.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept if keep_text else None)
            columns = [batch["doc_id"], batch["tkey"], pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary()).cast(pa.string())] * keep_text, ["doc_id", "tkey", "cut", "cut_sha"] + ["cut_text"] * keep_text)

    return run


def _chains(seeds: DataFrame, length: int) -> DataFrame:
    """Of each document, the other one, the diagonal and the runs on it, and the bounds of the words to lay side by side."""
    shared = seeds.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct("doc_id", "tkey", "start", "n", "at")).alias("r")).where("most > least")
    shared = stage(shared.select("h", "r"), "shared")
    met = seeds.join(shared, "h").where("not (doc_id = r.doc_id and tkey = r.tkey and start = r.start)")
    met = met.select("doc_id", "tkey", F.col("r.doc_id").alias("rdoc"), F.col("r.tkey").alias("rtkey"), (F.col("at") - F.col("r.at")).alias("diagonal"), "start", "n", F.col("r.start").alias("rstart"), F.col("r.n").alias("rn"))
    low, high = F.least("start", F.col("rstart") + F.col("diagonal")), F.greatest(F.col("start") + F.col("n"), F.col("rstart") + F.col("rn") + F.col("diagonal")) + length
    chains = met.groupBy("doc_id", "tkey", "rdoc", "rtkey", "diagonal").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.collect_list(F.struct("start", "n", "rstart", "rn")).alias("runs"))
    down, up = F.floor((F.col("low") - F.col("diagonal")) / ROUND) * ROUND, F.ceil((F.col("high") - F.col("diagonal")) / ROUND) * ROUND
    return stage(chains.withColumn("rlow", down.cast("int")).withColumn("rhigh", up.cast("int")), "chains")


def _repeats(docs: DataFrame, seeds: DataFrame, length: int) -> DataFrame:
    """(doc_id, tkey, start, size): what is to be cut."""
    chains = _chains(seeds, length)
    need = F.struct("rdoc", "rtkey", "rlow", "rhigh", "low", "high", "diagonal", "runs")
    theirs = chains.select(F.col("rdoc").alias("doc_id"), F.col("rtkey").alias("tkey"), "rlow", "rhigh").distinct()
    # The other side's own need names no other document.
    empty = theirs.select("doc_id", "tkey", F.struct(F.lit(None).cast("long").alias("rdoc"), F.lit(None).cast("long").alias("rtkey"), "rlow", "rhigh", F.col("rlow").alias("low"), F.col("rhigh").alias("high"), F.lit(0).alias("diagonal"), F.lit(None).cast(RUNS).alias("runs")).alias("need"))
    needs = chains.select("doc_id", "tkey", need.alias("need")).unionByName(empty).groupBy("doc_id", "tkey").agg(F.collect_list("need").alias("needs"))
    regions = stage(docs.join(needs, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "needs").mapInArrow(_regions, REGION), "regions")
    firsts = regions.where("rdoc is null").groupBy(F.col("doc_id").alias("rdoc"), F.col("tkey").alias("rtkey"), "rlow", "rhigh").agg(F.first("words").alias("rwords"))
    both = regions.where("rdoc is not null").join(stage(firsts, "firsts"), ["rdoc", "rtkey", "rlow", "rhigh"])
    extended = stage(both.mapInArrow(_extend(length), "doc_id long, tkey long, start int, size int, wh binary"), "extended")
    unstage(regions)
    windows = extended.where("wh is not null")
    lows = stage(windows.groupBy("wh").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("most > least").select("wh", "least"), "lows")
    parts = windows.join(lows, "wh").where("doc_id > least").select("doc_id", "tkey", "start", F.lit(length).alias("size"))
    return extended.where("wh is null").drop("wh").unionByName(parts)


def dedup_substrings(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), "text")
    found = stage(docs.mapInArrow(_scan(length), "doc_id long, tkey long, n_words long, sha string, anchors array<struct<h:long,start:int,n:int,at:int>>"), "anchors")
    # Copies of a whole word sequence repeat all of the first one; only the first goes on.
    first = stage(found.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length)).groupBy("sha").agg(F.min("doc_id").alias("first_id")), "first")
    rows = found.drop("anchors").join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    first_rows = found.where(F.col("n_words") >= length).join(first.withColumnRenamed("first_id", "doc_id"), ["sha", "doc_id"], "left_semi").dropDuplicates(["doc_id", "tkey"])
    seeds = stage(first_rows.select("doc_id", "tkey", F.inline("anchors")), "seeds")
    spans = _repeats(docs, seeds, length).groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    schema = "doc_id long, tkey long, cut long, cut_sha string" + ", cut_text string" * with_text
    cut = docs.join(spans, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "spans").mapInArrow(_cut(with_text), schema)
    cut = cut.dropDuplicates(["doc_id", "tkey"])
    out = rows.join(cut, ["doc_id", "tkey"], "left")
    copy = F.col("copy")
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256")]
    if with_text:
        plain = docs.dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", "text")
        out = out.join(plain, ["doc_id", "tkey"], "left")
        columns.append(F.when(copy, F.lit("")).otherwise(F.coalesce("cut_text", "text", F.lit(""))).alias("kept_text"))
    return out.select(*columns)
