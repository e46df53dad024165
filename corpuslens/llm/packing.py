"""Best-fit packing of token pieces into sequences by best-two-fit.

Pieces of one length are interchangeable, so what has to be packed is a histogram of at most `size` lengths,
however many documents there are; it is all that reaches the driver. Bins are planned as patterns: the longest
piece left, then greedily the longest that fits; after that the bin's smallest piece is taken out again
wherever two unpacked pieces fill the wider gap more tightly. A pattern is used as often as its lengths last,
which uses up a length each time, so there are few patterns. Every piece then finds its place from
its number within its length: numbering runs in Spark within hashed shares of each length.

Rows: null or empty text: the end token alone. Null doc_id: packed like others. Repeated rows: each is packed;
their rows differ in sequence_id or offset only. Ties (pieces of one length): by doc_id, piece. Very long texts: whole, a slice of
their own. Other columns are ignored. Empty table: no sequences.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import batches, stage

_SPACE = r"[\s\pZ\x0B\x1C-\x1F\x{85}]"
_SOLID = r"[^\s\pZ\x0B\x1C-\x1F\x{85}]"
#: A space amid other white space, where splitting at spaces would change the tokens; NUL marks places to split at.
_ODD = rf"{_SPACE} {_SPACE}|^ {_SPACE}|\x00"
_LATIN = r"[a-zA-Z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
_MARK = r"[!-&(-/:-@\[-`{-~]"
#: Bytes of text that are encoded at once, and of those the ones that one call gets.
SLICE, ROW, CALL = 8_000_000, 16_000, 16


def _parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list array's values, and where its rows begin and end among them."""
    ends = np.asarray(lists.offsets).astype(np.int64)
    return lists.flatten(), ends - ends[0]


def join_rows(ids: pa.Array, codes: pa.Array, ends: np.ndarray) -> pa.Array:
    """ids[codes], the bytes of each row's put in a row."""
    taken = ids.take(codes)
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + taken.offset + 1)[taken.offset :][ends] if len(taken) else np.zeros(len(ends), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), taken.buffers()[2] or pa.py_buffer(b"")])


class Encoder:
    """ids of texts, as little-endian bytes.

    Byte-level BPE splits before a space between words, between letters and the marks after them, and at a single newline
    between words. So a text's ids are those of such pieces in a row, and each distinct piece of a slice of texts is encoded once.
    Texts with a space amid other white space, or with an added token in them, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.width[k] = len(token)  # a letter stands for a byte

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _row(self, pieces: pa.Array) -> pa.Array:
        """ids of pieces that begin with one space or newline at most and hold no other white space at their ends: encoded in a row, cut by their bytes."""
        bare = np.asarray(pc.invert(pc.match_substring_regex(pieces, "^[ \n]")).cast(pa.uint8())).astype(bool)
        pieces = pc.binary_join_element_wise(pc.if_else(pa.array(bare), "\n", ""), pieces, "").cast(pa.large_string())
        ends = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1)
        data = memoryview(pieces.buffers()[2] or b"")
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], ROW)), len(pieces)))
        rows = [str(data[ends[i] : ends[j]], "utf-8") for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        found = [np.array(e.ids, "<u4") for k in range(0, len(rows), CALL) for e in self.tokenizer.encode_batch_fast(rows[k : k + CALL], add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, "<u4"), *found])
        reached = np.cumsum(self.width[ids])
        at = np.searchsorted(reached, ends[1:])
        if len(pieces) and (at[-1] != len(ids) - 1 or (reached[at] != ends[1:]).any()):
            raise ValueError("the tokenizer does not split between words")
        first = np.concatenate([[0], at + 1])
        kept = np.ones(len(ids), bool)
        kept[first[:-1][bare]] = False  # the newline put in front
        offsets = 4 * (first - np.concatenate([[0], np.cumsum(bare)]))
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids[kept]))])

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(pieces, rf"(?s)^[ \n]?{_SOLID}(.*{_SOLID})?$")
        other = pieces.filter(pc.invert(plain)).to_pylist()
        ids = pa.concat_arrays([self._row(pieces.filter(plain)), pa.array([self.whole(x) for x in other], pa.large_binary())])
        mask = np.asarray(plain.cast(pa.uint8())).astype(bool)
        place = np.where(mask, np.cumsum(mask) - 1, mask.sum() + np.cumsum(~mask) - 1)
        return ids.take(pa.array(place))

    def _words(self, words: pa.Array) -> pa.Array:
        words = pc.replace_substring_regex(words, f"({_LATIN})({_MARK})", "\\1\x00\\2")
        words = pc.replace_substring_regex(words, f"({_SOLID})\n({_SOLID})", "\\1\x00\n\\2")
        pieces, ends = _parts(pc.split_pattern(words, "\0"))
        coded = pieces.dictionary_encode()
        return join_rows(self._pieces(coded.dictionary), coded.indices, ends)

    def texts(self, texts: pa.Array) -> list[bytes]:
        """ids of each text (string; a null is empty)."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        words, ends = _parts(pc.split_pattern(texts.filter(pc.invert(odd)), " "))
        coded = words.dictionary_encode()
        codes, first = np.array(coded.indices), ends[:-1]  # a text's first word has no space before it
        heads = coded.dictionary.take(pa.array(codes[first])).dictionary_encode()
        codes[first] = len(coded.dictionary) + np.asarray(heads.indices)
        spaced = pc.binary_join_element_wise("", coded.dictionary, " ")
        ids = join_rows(self._words(pa.concat_arrays([spaced, heads.dictionary])), pa.array(codes), ends)
        plain = iter(ids.to_pylist())
        return [self.whole(t.as_py()) if o else next(plain) for t, o in zip(texts, odd.to_pylist(), strict=True)]


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, size: int, end: int, with_ids: bool):
    last = np.array([end], "<u4").tobytes()

    def run(it):
        for batch in batches(it, 20_000, SLICE):
            doc, piece, starts, lengths, crcs, ids = [], [], [], [], [], []
            for k, data in enumerate(_encoder(path).texts(batch["text"])):
                data += last
                n = len(data) // 4
                first = (n - 1) % size + 1
                for number, start in enumerate([0, *range(first, n, size)]):
                    stop = start + size if number else first
                    part = data[4 * start : 4 * stop]
                    doc.append(k)
                    piece.append(number)
                    starts.append(start)
                    lengths.append(stop - start)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch["doc_id"].take(pa.array(doc, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            pa.default_memory_pool().release_unused()

    return run


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """[(lengths in a bin, number of such bins)] for counts[length] pieces, by best-two-fit."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    plan = []

    def longest(limit: int, used: list[int]) -> int:
        at = bisect_right(lengths, limit)
        while at and left[lengths[at - 1]] <= used.count(lengths[at - 1]):
            at -= 1
        return lengths[at - 1] if at else 0

    while lengths:
        used = [lengths[-1]]
        while more := longest(size - sum(used), used):
            used.append(more)
        if len(used) > 1 and sum(used) < size:
            smallest, rest = used[-1], used[:-1]
            gap, best = size - sum(rest), (smallest,)
            for x in lengths[: bisect_right(lengths, gap)][::-1]:
                if 2 * x <= sum(best) or sum(best) == gap:
                    break
                # Both must be unpacked: the smallest document leaves the bin, it isn't one of the two.
                if left[x] > used.count(x) and (y := longest(min(x, gap - x), [*used, x])) and x + y > sum(best):
                    best = (x, y)
            used = [*rest, *best]
            while more := longest(size - sum(used), used):
                used.append(more)
        times = min(left[x] // used.count(x) for x in set(used))
        plan.append((used, times))
        for x in used:
            left[x] -= times
            if not left[x]:
                lengths.remove(x)
    return plan


def _places(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length, ranges of its pieces' numbers: `first` number, bins from `bin`, `each` in a bin, `offset` of the first one there."""
    rows, seen, base = [], {}, 0
    for used, times in plan:
        ordered, at = sorted(used, reverse=True), 0
        for length in dict.fromkeys(ordered):
            each = ordered.count(length)
            rows.append((length, seen.get(length, 0), base, each, at))
            seen[length] = seen.get(length, 0) + each * times
            at += each * length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "bin", "each", "offset"]).sort_values(["length", "first"], ignore_index=True)


def _place(plan: list[tuple[list[int], int]]):
    table = _places(plan)
    by = {int(k): (g["first"].to_numpy(), g["bin"].to_numpy(), g["each"].to_numpy(), g["offset"].to_numpy()) for k, g in table.groupby("length")}

    def run(it):
        for pdf in it:
            length, number = pdf["length"].to_numpy(), pdf.pop("number").to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for k in np.unique(length):
                first, base, each, at = by[int(k)]
                rows = np.flatnonzero(length == k)
                r = np.searchsorted(first, number[rows], "right") - 1
                within = number[rows] - first[r]
                sequence[rows] = base[r] + within // each[r]
                offset[rows] = at[r] + within % each[r] * k
            yield pdf.assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of docs (doc_id, text)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, size, end, with_ids), schema), "pieces")
    spark = docs.sparkSession
    shares = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("share", F.expr(f"cast(pmod(xxhash64(doc_id, piece), {shares}) as int)"))
    counts = stage(pieces.groupBy("length", "share").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).select("length", "share", "before")
    order = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = pieces.withColumn("k", F.row_number().over(order)).join(before, ["length", "share"]).withColumn("number", F.col("before") + F.col("k") - 1).drop("before", "k", "share")
    numbered = numbered.select(*(c for c in pieces.columns if c != "share"), "number")
    return numbered.mapInPandas(_place(plan_bins(histogram, size)), schema + ", sequence_id long, offset long")
