"""What several operators share: staging, whole-text words, hashes, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.shared import delete_path, new_path

#: Entries that a Python worker keeps in a cache of words; then it starts anew.
CACHE = 600_000


def release() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def stage(df: DataFrame, name: str, block: int = 128 << 20) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there and no executor's loss undoes it. Rows of many bytes take a small block, as a reader holds one."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", block).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in tables:
        delete_path(df.sparkSession, df.staged_at)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores as set it apart from these columns."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


#: Bits of the map of perhaps_known, and of a row of it (bitmap_construct_agg's size).
SPOTS, CELL = 1 << 24, 1 << 15


def perhaps_known(df: DataFrame, key: Column, known: DataFrame, own: Column, flag: str) -> DataFrame:
    """df with a boolean `flag`: false only where `key` (a 64-bit hash) is none of `own` in `known`, and for nearly all those rows while known has fewer keys than SPOTS.

    Keys set bits of one map, which is broadcast and is 2 MB at most, however many they are. Rows told apart by it need not be shuffled with their texts for a join.
    """
    cell, bits = free_name([*df.columns, flag], "cell"), free_name([*df.columns, flag], "bits")
    spots = known.select(F.pmod(own, F.lit(SPOTS)).alias("spot")).select(F.expr(f"spot div {CELL}").alias(cell), F.expr(f"spot % {CELL}").alias("bit"))
    cells = spots.repartition(cell).groupBy(cell).agg(F.bitmap_construct_agg("bit").alias(bits))
    spot = F.pmod(key, F.lit(SPOTS))
    out = df.withColumn(cell, F.floor(spot / CELL).cast("long")).withColumn(flag, spot % CELL).join(F.broadcast(cells), cell, "left")
    byte = F.conv(F.hex(F.substring(bits, F.floor(F.col(flag) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.withColumn(flag, F.coalesce(F.getbit(byte, (F.col(flag) % 8).cast("int")) == 1, F.lit(False))).select(*df.columns, flag)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words [^\\x20\\x09-\\x0D]+ of texts, each word's place among them, and where each text's words end."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    ends, words = np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64), lists.flatten().dictionary_encode()
    codes, empty = np.asarray(words.indices), pc.index(words.dictionary, "").as_py()
    if empty >= 0:  # around white space at a text's ends
        real = codes != empty
        ends, codes = np.concatenate([[0], np.cumsum(real)])[ends], codes[real]
    return words.dictionary, codes, ends


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's end)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Cache from a word's bytes to a value that `make` gives; emptied when it has `limit` entries."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = self.make(word)
        return value


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Prefix sums over 64-bit symbols, from which the hash of any span follows."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(Rolling.up) <= n:
            size = max(1 << 15, 2 * n)
            Rolling.up, Rolling.down = (np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_ODD, _INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * Rolling.up[:n], dtype=np.uint64)])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling.down[start])


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, and where its words [^\\x20\\x09-\\x0D]+ start and end; as bytes.split() finds them."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the text, in order."""
    data, starts, ends = word_spans(text)
    return Rolling(_BYTE[data]).span(starts, ends)


def batches(it: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of `rows` rows and about `size` bytes at most (a row is never cut), so that long texts don't pile up as Python objects."""
    for batch in it:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() > size and batch.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b: long); component is the smallest node reachable.

    Alternating large-star and small-star rounds, each a few joins and a staged table; a round at most
    keeps the number of edges, and rounds go on until nothing changes (about the logarithm of the longest way). Each node's least
    neighbour is staged before it joins the edges, so that both sides come straight from a shuffle, where AQE splits a hub's.
    Loops and repeated edges do no harm; nodes without edges don't come back.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = stage(edges.select(hi, lo).where("hi <> lo").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "large")
        lowest = stage(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = stage(small.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        unstage(now, least, large, lowest)
        now = new
    roots = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
