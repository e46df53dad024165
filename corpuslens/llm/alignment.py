"""Alignment of two tokenizers' tokens over the same bytes, by merging their ends along equal pieces of the merge path.

Both tokenizers read a space and the text. The ends of a slice of texts' A tokens and of its B tokens are two rising lists; merging them
(A first where both end) is a path of as many steps as there are tokens. Binary searches on diagonals cut the path into pieces of `steps` steps
each, whatever the texts' lengths; pieces are rows of a staged table, each with its own ids and one more of each side, so any task can merge any
piece. A step is an overlap of the two tokens that are open, unless it only closes what the step before has reached: there a group ends. A text that lies in one
piece is done there; of one that goes on, pieces give fragments: their group still open at the front, closed groups, the group left open at the
end. Fragments are stitched in order as a stream, so no task holds more than one of them.

Counts of id pairs come from all texts: a piece gives each of its pairs with the number of its whole texts that hold it, fragments give theirs
once for each text. Pieces then ask for the counts of their own distinct pairs by a join on the pair; nothing is broadcast.

Rows: null or empty texts, and texts that A or B doesn't give back byte by byte, have no tokens: zeros and ''. Repeated rows and null ids are
rows of their own, each counts as a document. Equal counts: all links with an A id's highest count are best. Very long texts: whole, over as many pieces as they take.
Other columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import bpe
from corpuslens.llm.common import Words, batches, release, stage, unstage
from corpuslens.llm.packing import join_rows

#: Steps of the merge path in a piece; bytes of text whose paths are cut together.
STEPS, SLICE = 1 << 20, 4_000_000
#: Words that a task keeps ids of, for each side.
CACHED = 150_000


class PieceEncoder:
    """ids of texts by a piece model, as little-endian bytes.

    Where no piece has a space after another letter, no merge crosses the place before a space that follows a letter, so a text's ids are those of its words in
    a row, each with its space, and each distinct word is encoded once. Texts with other spaces than single ones between words, or with the letter that stands for one, are encoded whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.token = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.words = Words(self.whole, CACHED)

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text)).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words that the cache doesn't hold, many at a time."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.words.limit:
            self.words.clear()
            new = words
        for at in range(0, len(new), 1 << 14):
            part = new[at : at + (1 << 14)]
            self.words.update(zip(part, (array("I", ids).tobytes() for ids in self.model.encode(part, num_threads=1)), strict=True))

    def texts(self, texts: pa.Array) -> list[bytes]:
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, "  |▁|^ | $|^$") if self.apart else pa.array(np.ones(len(texts), bool))
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        ends, coded = np.asarray(lists.offsets).astype(np.int64), lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        ids = pa.array(map(self.words.__getitem__, words), pa.large_binary())
        plain = iter(join_rows(ids, coded.indices, ends - ends[0]).to_pylist())
        return [self.whole(t.as_py()) if o else next(plain) for t, o in zip(texts, odd.to_pylist(), strict=True)]


@functools.cache
def _piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


class Sides:
    """Both vocabularies: bytes and widths of their tokens, and their ids as text with the separator that follows."""

    def __init__(self, a: str, b: str):
        self.tokens = [pa.array(t, pa.large_binary()) for t in (bpe.token_bytes(a), _piece_encoder(b).token)]
        self.widths = [np.asarray(pc.binary_length(t)).astype(np.int64) for t in self.tokens]
        self.sizes = [len(t) for t in self.tokens]
        self.kind = "<u2" if max(self.sizes) <= 1 << 16 else "<u4"  # of stored ids
        self.digits = pa.array([f"{k}{end}".encode() for n, ends in zip(self.sizes, (",|", ",;"), strict=True) for end in ends for k in range(n)], pa.large_binary())


@functools.cache
def _byte_encoder(path: str) -> bpe.RankArrays:
    out = bpe.RankArrays(path, True)
    out.words.limit = CACHED
    return out


@functools.cache
def _sides(a: str, b: str) -> Sides:
    return Sides(a, b)


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of a's ends are among the first `at` steps of the merge of a and b (a first where they are equal): one binary search for each diagonal, all at once."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        taken = np.zeros(len(at), bool)
        taken[open_] = a[mid[open_]] <= b[at[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & taken, mid + 1, low), np.where(open_ & ~taken, mid, high)
    return low


PIECE = "piece long, rows array<long>, ids array<long>, a_counts array<long>, b_counts array<long>, begins boolean, ends boolean, skew long, a binary, b binary"
_PIECE = pa.schema([("piece", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("a_counts", pa.list_(pa.int64())), ("b_counts", pa.list_(pa.int64())), ("begins", pa.bool_()), ("ends", pa.bool_()), ("skew", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _encoded(batch: pa.RecordBatch, a_path: str, b_path: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """ids of all the slice's tokens of each side, and each text's number of them."""
    texts, sides = batch["text"].fill_null(""), _sides(a_path, b_path)
    spaced = pc.binary_join_element_wise("", texts, " ")
    coded = [_byte_encoder(a_path).texts(spaced), _piece_encoder(b_path).texts(texts)]
    good = np.asarray(pc.binary_length(texts)) > 0
    wanted = spaced.cast(pa.large_binary()).to_pylist()
    for table, ids in zip(sides.tokens, coded, strict=True):
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
        whole = join_rows(table, pa.array(np.frombuffer(b"".join(ids), "<u4")), ends).to_pylist()
        good &= np.array([x == y for x, y in zip(whole, wanted, strict=True)], bool)
    coded = [[x if g else b"" for x, g in zip(ids, good, strict=True)] for ids in coded]
    return [np.frombuffer(b"".join(ids), "<u4") for ids in coded], [np.array([len(x) // 4 for x in ids], np.int64) for ids in coded]


def _packed(ids: np.ndarray) -> bytes:
    """Ids byte by byte, compressed, as they go through a staged table and a shuffle."""
    return zstandard.compress(ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _cut(a_path: str, b_path: str, steps: int):
    def run(it):
        here, made, row = TaskContext.get().partitionId() << 40, 0, 0
        widths, kind = _sides(a_path, b_path).widths, _sides(a_path, b_path).kind
        for batch in batches(it, 20_000, SLICE):
            (a, b), (na, nb) = _encoded(batch, a_path, b_path)
            ends = [np.cumsum(w[x]) for w, x in zip(widths, (a, b), strict=True)]
            total = len(a) + len(b)
            at = np.append(np.arange(0, max(total, 1), steps), total)
            i = diagonals(*ends, at)
            j = at - i
            done = np.concatenate([[0], np.cumsum(na + nb)])  # steps before each text
            done_a, done_b = (np.concatenate([[0], np.cumsum(n)]) for n in (na, nb))
            for k in range(len(at) - 1):
                # Texts with steps in the piece, and those without any up to its end.
                first = int(np.searchsorted(done[1:], at[k], "right" if k else "left"))
                last = int(max(np.searchsorted(done[1:], at[k + 1], "right"), np.searchsorted(done[:-1], at[k + 1], "left")))
                cut = lambda d, x: np.diff(np.clip(d[first : last + 1], x[k], x[k + 1])).tolist()  # noqa: B023, E731
                start = [e[x - 1] if x else 0 for e, x in zip(ends, (i[k], j[k]), strict=True)]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "piece": here + made, "rows": list(range(here + row + first, here + row + last)), "ids": batch["doc_id"].slice(first, last - first).to_pylist(),
                            "a_counts": cut(done_a, i), "b_counts": cut(done_b, j), "begins": bool(done[first] >= at[k]), "ends": bool(done[last] <= at[k + 1]),
                            "skew": int(start[1] - start[0]), "a": _packed(a[i[k] : i[k + 1] + 1].astype(kind)), "b": _packed(b[j[k] : j[k + 1] + 1].astype(kind)),
                        }
                    ],
                    _PIECE,
                )
                made += 1
            row += batch.num_rows
            release()
        _byte_encoder(a_path).words.clear()
        _piece_encoder(b_path).words.clear()
        release()  # this worker goes on with other stages

    return run


class Piece:
    """A piece of the path, merged: links as pairs (with their texts) and where groups close."""

    def __init__(self, row: dict, sides: Sides):
        self.rows, self.ids, self.na, self.nb = (np.array(row[c], object if c == "ids" else np.int64) for c in ("rows", "ids", "a_counts", "b_counts"))
        a, b = (_unpacked(row[c], sides.kind).astype(np.int64) for c in "ab")
        n, m = int(self.na.sum()), int(self.nb.sum())
        self.sides, self.a, self.b = sides, a[:n], b[:m]
        self.a_ends, self.b_ends = np.cumsum(sides.widths[0][self.a]), np.cumsum(sides.widths[1][self.b]) + row["skew"]
        self.whole = np.ones(len(self.rows), bool)
        self.begins, self.ends = row["begins"], row["ends"]
        if len(self.rows):
            self.whole[0] &= self.begins
            self.whole[-1] &= self.ends
        texts = np.arange(len(self.rows))
        a_text, b_text = np.repeat(texts, self.na), np.repeat(texts, self.nb)
        other = np.searchsorted(self.b_ends, self.a_ends, "left")  # B's open token while A's ends
        passed = np.searchsorted(self.a_ends, self.b_ends, "right")
        closes = np.concatenate([[0], self.a_ends])[passed] == self.b_ends  # the A token before has ended there too
        self.closed = self.b_ends[closes]
        self.n_groups = np.bincount(b_text[closes], minlength=len(self.rows))
        lone = ~closes
        pair = np.concatenate([self.a * sides.sizes[1] + b[other], a[passed[lone]] * sides.sizes[1] + self.b[lone]])
        text = np.concatenate([a_text, b_text[lone]])
        every = sides.sizes[0] * sides.sizes[1]
        held, self.times = np.unique(text * every + pair, return_counts=True)
        self.text, self.pair = held // every, held % every

    def groups(self) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
        """The groups as text, where each token's part of it starts (A's of a group, then B's), and each group's number of A and B tokens; the last group is open."""
        n = len(self.closed) + 1
        ga, gb = (np.searchsorted(self.closed, e, "left") for e in (self.a_ends, self.b_ends))
        count_a, count_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        before = np.cumsum(count_a + count_b) - count_a - count_b
        first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        codes = np.empty(len(ga) + len(gb), np.int64)
        va, vb = self.sides.sizes
        in_a, in_b = np.arange(len(ga)) - first_a[ga], np.arange(len(gb)) - first_b[gb]
        codes[before[ga] + in_a] = self.a + np.where(in_a == count_a[ga] - 1, va, 0)
        codes[before[gb] + count_a[gb] + in_b] = 2 * va + self.b + np.where(in_b == count_b[gb] - 1, vb, 0)
        taken = self.sides.digits.take(pa.array(codes))
        if not len(codes):
            return memoryview(b""), np.zeros(1, np.int64), count_a, count_b
        return memoryview(taken.buffers()[2]), np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1), count_a, count_b


HELD = "piece long, pair long, n long, row long"


def _held(a_path: str, b_path: str):
    """A piece's distinct pairs: of its whole texts with how many of them hold it, of each other text by its row."""

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                p = Piece(row, _sides(a_path, b_path))
                whole = p.whole[p.text] if len(p.rows) else np.zeros(0, bool)
                pairs, n = np.unique(p.pair[whole], return_counts=True)
                part, owner = p.pair[~whole], p.rows[p.text[~whole]]
                columns = [np.full(len(pairs) + len(part), row["piece"]), np.concatenate([pairs, part]), np.concatenate([n, np.ones(len(part), np.int64)])]
                rows = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(owner, pa.int64())])
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), rows], ["piece", "pair", "n", "row"])

    return run


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
PART = "row long, piece long, whole boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, head_a binary, head_b binary, closes boolean, body binary, tail_a binary, tail_b binary"
_PART = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in PART.split(", "))])


def _parts(a_path: str, b_path: str):
    """Of each text in a piece its numbers, and its groups' hash or, of a part of a text, its groups."""

    def run(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        row = pieces.to_pylist()[0]
        p = Piece(row, _sides(a_path, b_path))
        pairs, n, best = (np.asarray(answers[c].combine_chunks()) for c in ("pair", "n", "best"))
        order = np.argsort(pairs)
        at = order[np.searchsorted(pairs, p.pair, sorter=order)] if len(p.pair) else np.zeros(0, np.int64)
        add = lambda x: np.rint(np.bincount(p.text, weights=x, minlength=len(p.rows))).astype(np.int64)
        links, n_best, sums = add(p.times), add(p.times * best[at]), np.zeros(len(p.rows), np.int64)
        np.add.at(sums, p.text, p.times * n[at])
        data, offsets, count_a, count_b = p.groups()
        stop = np.cumsum(p.na + p.nb)
        out = []
        for k in range(len(p.rows)):
            one = {"row": p.rows[k], "piece": row["piece"], "whole": p.whole[k], "doc_id": p.ids[k], "n_a": p.na[k], "n_b": p.nb[k], "n_groups": p.n_groups[k], "n_links": links[k], "n_best": n_best[k], "count_sum": sums[k]}
            low, high = stop[k] - p.na[k] - p.nb[k], stop[k]
            if p.whole[k]:
                one["groups_sha256"] = hashlib.sha256(data[offsets[low] : offsets[high] - 1]).hexdigest() if high > low else ""
            else:
                text = lambda x, y: bytes(data[offsets[x] : offsets[y]])
                head = k == 0 and not p.begins
                if head:
                    x, y = low + count_a[0], low + count_a[0] + count_b[0]
                    one |= {"head_a": text(low, x)[:-1], "head_b": text(x, y)[:-1], "closes": bool(p.n_groups[k])}
                    low = y
                if k == len(p.rows) - 1 and not p.ends and not (head and not p.n_groups[k]):
                    x, y = high - count_a[-1] - count_b[-1], high - count_b[-1]
                    one |= {"tail_a": text(x, y)[:-1], "tail_b": text(y, high)[:-1]}
                    high = x
                one["body"] = text(low, high)[:-1]
            out.append(one)
        del p, row, pairs, n, best, order, at, data, offsets
        release()
        return pa.Table.from_pylist(out, _PART)

    return run


def _stitch(it):
    """One row for each text of parts that come by row and piece; its groups go through the hash part by part."""
    now, sums, sha, open_, some = None, [], None, [], False

    def feed(groups: bytes) -> None:
        nonlocal some
        sha.update(b";" + groups if some else groups)
        some = True

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums] + [pa.array([sha.hexdigest()])], [*OUT, "groups_sha256"])

    for batch in it:
        for k in range(batch.num_rows):
            part = batch.slice(k, 1).to_pylist()[0]
            if part["row"] != now:
                if now is not None:
                    yield done()
                now, sums, sha, open_, some = part["row"], [part["doc_id"], *[0] * 6], hashlib.sha256(), [[], []], False
            sums[1:] = [x + part[c] for x, c in zip(sums[1:], OUT[1:], strict=True)]
            for side, c in zip(open_, ("head_a", "head_b"), strict=True):
                side.extend([part[c]] if part[c] else [])
            if part["closes"]:
                feed(b",".join(open_[0]) + b"|" + b",".join(open_[1]))
                open_ = [[], []]
            if part["body"]:
                feed(part["body"])
            for side, c in zip(open_, ("tail_a", "tail_b"), strict=True):
                side.extend([part[c]] if part[c] else [])
    if now is not None:
        yield done()


def cut_pieces(docs: DataFrame, a_path: str, b_path: str, steps: int = STEPS) -> DataFrame:
    """The staged pieces of the merge paths of docs (doc_id, text)."""
    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(a_path, b_path, steps), PIECE), "pieces", block=8 << 20)


def pair_counts(held: DataFrame, b_size: int) -> DataFrame:
    """pair, n: how many texts hold the A and B ids of pair (A id x b_size + B id) linked; best: no pair of that A id has more."""
    whole = held.where("row IS NULL").select("pair", "n")
    parts = held.where("row IS NOT NULL").select("pair", "row").distinct().select("pair", F.lit(1).cast("long").alias("n"))
    counts = whole.unionByName(parts).groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(b_size)))  # at most b_size rows each
    return counts.withColumn("best", F.max("n").over(of_a) == F.col("n"))


def align(docs: DataFrame, a_path: str, b_path: str, steps: int = STEPS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    pieces = cut_pieces(docs, a_path, b_path, steps)
    held = stage(pieces.mapInArrow(_held(a_path, b_path), HELD), "held")
    counts = pair_counts(held, _sides(a_path, b_path).sizes[1])
    answers = held.select("piece", "pair").distinct().join(counts.hint("merge"), "pair").select("piece", "pair", "n", "best")
    parts = stage(pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(_parts(a_path, b_path), PART), "parts")
    unstage(pieces, held)
    broken = parts.where("NOT whole").repartition("row").sortWithinPartitions("row", "piece")
    stitched = broken.mapInArrow(_stitch, ", ".join(f"{c} long" for c in OUT) + ", groups_sha256 string")
    return parts.where("whole").select(*OUT, "groups_sha256").unionByName(stitched)
