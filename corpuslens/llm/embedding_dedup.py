"""Embedding near-dedup by sorted projection passes.

Each pass has its own random hyperplanes; a vector's hash is the sign before each of them, in order. A pass orders all vectors by label,
concatenated hashes and id, numbers them, and compares each one with its next WINDOW neighbours; verified pairs are united over
the passes. Vectors that agree in the first `bits` hashes stand in one run, and `bits` grows with the logarithm of the rows so that runs
fit the window; the number of passes follows from the recall wanted for pairs exactly at the threshold. Where a run is
longer than the window (many near copies), its rows farther apart than the window are compared too, block by block: nothing is left
out, at a cost of run / WINDOW copies of each of its rows.

Only (label, hash, id) are sorted. A row then carries its place in every pass, so two rows can tell alone whether an
earlier pass compared them: a pair is counted once, and no pairs leave a task, only counts and one row per vector to the
smallest vector of its component there. Passes run one after the other: a vector is sent once in each (and a second
time in the first WINDOW of every BLOCK windows). Equal vectors (by 128 bits of hash) are one node with a count.

Rows: a vector is compared with those of its label and its own size. Null label, null, empty or zero vectors,
and such with null or non-finite components, link with nothing (n_links 0, their own component). Null vec_id: likewise, component null. Repeated
rows: each row comes back and counts as another vector. Ties in order: by id. Very long vectors: whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import connected_components, stage, unstage

WINDOW = 1024
#: Windows that a task compares.
BLOCK = 8
#: Share of the pairs exactly at the threshold that some pass finds; those above it have more.
RECALL = 0.9995
#: Hashes by which a pass orders vectors; a run agrees in the first ones.
HASHES = 40
MET = "node long, links long, root long"


def plan_passes(rows: int, threshold: float, recall: float = RECALL, window: int | None = None) -> tuple[int, int]:
    """(hashes of a run, passes): a hash agrees with probability 1 - angle / pi."""
    bits = max(0, min(HASHES, math.ceil(math.log2(max(1, rows / (window or WINDOW))))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind).reshape(len(column), -1)


def _hashes(passes: int, seed: int):
    """(node, label, turn, code) of each vector in each pass."""

    def run(it):
        planes: dict[int, np.ndarray] = {}
        for batch in it:
            sizes = np.asarray(batch["e"].value_lengths())
            for size in np.unique(sizes).tolist():
                rows = pa.array(np.flatnonzero(sizes == size))
                if size not in planes:
                    planes[size] = np.random.default_rng(seed).standard_normal((size, passes * HASHES))
                signs = (_matrix(batch["e"].take(rows), float) @ planes[size] > 0).reshape(-1, HASHES)
                codes = signs @ (1 << np.arange(HASHES, dtype=np.int64)[::-1])
                every = rows.take(pa.array(np.repeat(np.arange(len(rows)), passes)))
                yield pa.RecordBatch.from_arrays([batch["node"].take(every), batch["label"].take(every), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(rows))), pa.array(codes)], ["node", "label", "turn", "code"])

    return run


def _number(it):
    """Adds the partition and the place in it."""
    at = 0
    for batch in it:
        n, part = batch.num_rows, TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "k"])
        at += n


def _places(unit: DataFrame, bits: int, passes: int, seed: int) -> DataFrame:
    """(node, ranks, runs) by pass: a row's place in the order, and the first place and length of its run where that is longer than WINDOW."""
    order = ["turn", "label", "code", "node"]
    hashed = unit.select("node", "label", "e").mapInArrow(_hashes(passes, seed), "node long, label string, turn int, code long")
    ordered = stage(hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, "node long, label string, turn int, code long, part int, k long"), "ordered")
    ahead, rows = 0, []
    for part, n in sorted(map(tuple, ordered.groupBy("part").count().collect())):  # one row a partition
        rows.append((part, ahead))
        ahead += n
    offsets = unit.sparkSession.createDataFrame(rows, "part int, ahead long")
    ranked = ordered.join(F.broadcast(offsets), "part").select("node", "label", "turn", F.shiftright("code", HASHES - bits).alias("prefix"), (F.col("ahead") + F.col("k")).alias("rank"))
    runs = ranked.groupBy("turn", "label", "prefix").agg(F.min("rank").alias("low"), F.count("*").alias("n")).where(F.col("n") > WINDOW)
    ranked = ranked.join(stage(runs, "runs"), ["turn", "label", "prefix"], "left")
    per_turn = F.array_sort(F.collect_list(F.struct("turn", "rank", F.struct("low", "n").alias("run"))))
    nodes = ranked.groupBy("node").agg(per_turn.alias("t"))
    out = stage(nodes.select("node", F.transform("t", lambda x: x["rank"]).alias("ranks"), F.transform("t", lambda x: x["run"]["low"]).alias("lows"), F.transform("t", lambda x: x["run"]["n"]).alias("lengths")), "places")
    unstage(ordered)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n by the links a[k] - b[k]."""
    least = np.arange(n)
    while True:
        new = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


class _Rows:
    """Rows of one label, in a pass's order."""

    def __init__(self, table: pa.Table):
        self.node, self.copies = table["node"].to_numpy(), table["copies"].to_numpy()
        x = _matrix(table["e"].combine_chunks(), float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        self.exact = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.short = self.exact.astype(np.float32)
        self.ranks = _matrix(table["ranks"].combine_chunks(), np.int64)
        self.lows = _matrix(table["lows"].combine_chunks(), float)  # nan, which equals nothing, outside of long runs


def _links(rows: _Rows, turn: int, window: int, threshold: float, wanted) -> pa.Table:
    """Counts and components of the pairs at the threshold that no earlier pass compared; wanted(a, b): which pairs of rows are this task's."""
    n, tile = len(rows.node), 512
    margin = 1e-4 + rows.short.shape[1] * 1e-6  # what single precision may be off by
    found = []
    for low in range(0, n, tile):
        last = min(low + tile, n)
        # Rows are in order: those past the window of the tile's last one are no neighbours.
        stop = n if wanted.everything else int(np.searchsorted(rows.ranks[:, turn], rows.ranks[last - 1, turn] + window, "right"))
        near = rows.short[low:last] @ rows.short[low:stop].T
        a, b = np.nonzero(near >= threshold - margin)
        close = near[a, b]
        a, b = a + low, b + low
        keep = (a < b) & wanted(a, b)
        a, b, close = a[keep], b[keep], close[keep]
        unsure = np.flatnonzero(close < threshold + margin)
        keep = np.ones(len(a), bool)
        keep[unsure] = np.einsum("ij,ij->i", rows.exact[a[unsure]], rows.exact[b[unsure]]) >= threshold
        for before in range(turn):
            keep &= (np.abs(rows.ranks[a, before] - rows.ranks[b, before]) > window) & (rows.lows[a, before] != rows.lows[b, before])
        found.append((a[keep], b[keep]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else np.empty((2, 0), np.int64)
    links = np.bincount(a, rows.copies[b], n).astype(np.int64) + np.bincount(b, rows.copies[a], n).astype(np.int64)
    root = rows.node[_roots(n, a, b)]
    out = links > 0
    return pa.table([pa.array(x[out]) for x in (rows.node, links, root)], ["node", "links", "root"])


class _Near:
    """Pairs at most a window apart whose first row is of the block itself."""

    everything = False

    def __init__(self, rank: np.ndarray, block: int, size: int, window: int):
        self.rank, self.own, self.window = rank, rank // size == block, window

    def __call__(self, a, b):
        return self.own[a] & (self.rank[b] - self.rank[a] <= self.window)


class _Far:
    """Pairs of two blocks of a run that are more than a window apart."""

    everything = True

    def __init__(self, rank: np.ndarray, side: np.ndarray, window: int):
        self.rank, self.side, self.window = rank, side, window

    def __call__(self, a, b):
        return (self.side[a] != self.side[b]) & (self.rank[b] - self.rank[a] > self.window)


def _compare(turn: int, threshold: float, window: int, size: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, block, other = (k.as_py() for k in key)
        table = table.sort_by([("rank", "ascending")])
        out = []
        labels = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        for label in np.unique(labels).tolist():
            at = np.flatnonzero(labels == label)
            rows = _Rows(table.take(pa.array(at)))
            rank = rows.ranks[:, turn]
            wanted = _Near(rank, block, size, window) if low < 0 else _Far(rank, (rank - low) // window, window)
            out.append(_links(rows, turn, window, threshold, wanted))
        return pa.concat_tables(out)

    return run


def _pass(placed: DataFrame, turn: int, threshold: float) -> DataFrame:
    """(node, links, root) of the pairs that this pass is the first to compare."""
    size = BLOCK * WINDOW
    rows = placed.withColumn("rank", F.col("ranks")[turn]).withColumn("low", F.col("lows")[turn]).withColumn("n", F.col("lengths")[turn]).drop("lengths")
    block = F.floor(F.col("rank") / size)
    # A block's first window goes to the block before it as well.
    near = rows.withColumn("block", F.explode(F.when(F.col("rank") % size < WINDOW, F.array(block, block - 1)).otherwise(F.array(block)))).where("block >= 0")
    near = near.withColumn("low", F.lit(-1).cast("long")).withColumn("other", F.lit(-1).cast("long"))
    # Of a run longer than the window, all pairs of its blocks that hold rows farther apart.
    own = F.floor((F.col("rank") - F.col("low")) / WINDOW)
    far = rows.where("low is not null").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / WINDOW)))).where("i <> j")
    far = far.withColumn("block", F.least("i", "j")).withColumn("other", F.greatest("i", "j"))
    columns = ["low", "block", "other", "node", "label", "copies", "e", "rank", "ranks", "lows"]
    return near.select(*columns).unionByName(far.select(*columns)).groupBy("low", "block", "other").applyInArrow(_compare(turn, threshold, WINDOW, size), MET)


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("e"), F.col("label").cast("string"))
    rows = rows.withColumn("label", F.concat(F.size("e"), F.lit(" "), "label"))  # vectors of different sizes are never compared
    good = F.expr("vec_id is not null and label is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)")
    keys = ["label", "h", "g"]
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("h", F.xxhash64("e")).withColumn("g", F.xxhash64(F.lit(7), "e"))
    unit = stage(rows.where("good").groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("e").alias("e")), "unit")
    of_vector = unit.drop("e")
    per_label = unit.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, passes = plan_passes(per_label, threshold)
    placed = stage(unit.select("node", "label", "copies", "e").join(_places(unit, bits, passes, seed), "node"), "placed")
    met = None
    for turn in range(passes):
        part = stage(_pass(placed, turn, threshold), "met")
        met = part if met is None else met.unionByName(part)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(met.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Back to the rows: a row finds its node through its vector's hash. Staged, so that AQE can split the join of a hot one.
    known = stage(of_vector.join(links, "node", "left").join(parts, "node", "left"), "known")
    found = rows.where("good").select("vec_id", *keys).join(known, keys, "left")
    found = found.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    other = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    unstage(unit, placed)
    return found.unionByName(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
