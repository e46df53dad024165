"""Byte-level BPE, encoded and decoded, from a tokenizer file's vocabulary and merges alone.

A text is split into words by the byte-level pattern. A short word is merged over two contiguous arrays: the boundaries of its
parts and the ranks of neighbouring parts. The least rank is looked for again and again; the boundary between its parts is deleted and
the ranks beside it are looked up anew. A slice's new words go through these steps together, each a row of both arrays. Longer words, where
scanning would cost the square of their length, take their ranks from a heap over linked parts, which gives the same merges in the same order. Each distinct word is merged once while
a worker's cache holds it. Decoding joins the tokens' bytes; what isn't UTF-8 becomes U+FFFD.

Rows: null and empty texts have no ids and decode to ''. Repeated rows and null ids come back as often as they are there. Equal ranks: the
leftmost pair. Very long texts and words: whole. Other columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Words, batches
from corpuslens.llm.packing import Encoder, join_rows

#: Splits as the file's byte-level pre-tokenizer does (a fixed value of such tokenizers).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of a word up to which its ranks are scanned; widths of the arrays in which words go together; fewer words than these go one by one.
SHORT, WIDTHS, FEW = 64, (8, 16, 32, 64), 200
#: Bytes of text that are encoded at once, and words that a worker keeps the ids of.
SLICE, CACHED = 4_000_000, 300_000
#: No merge: over every rank.
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: visible Latin-1 for itself, the others from U+0100 on in their order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a tokenizer file; an id that the file doesn't have has none."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    letters, vocabulary = byte_letters(), known["model"]["vocab"] | {t["content"]: t["id"] for t in known["added_tokens"]}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


class RankArrays(Encoder):
    """ids of texts, as little-endian bytes; `plain`: added tokens' strings are text like any other."""

    def __init__(self, path: str, plain: bool = False):
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        model, split = known["model"], known["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or known["normalizer"] or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError(f"{path} isn't a byte-level BPE")
        self.path, self.token = path, token_bytes(path)
        vocabulary = model["vocab"]
        self.id = {self.token[k]: k for k in vocabulary.values()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(self.token[vocabulary[a]], self.token[vocabulary[b]]): k for k, (a, b) in enumerate(pairs)}
        self.first = [NEVER] * (1 << 16)  # ranks of two bytes
        for (a, b), k in self.rank.items():
            if len(a) == len(b) == 1:
                self.first[a[0] << 8 | b[0]] = k
        self.first_row = np.array(self.first, np.int64)
        self.byte = np.array([self.id[bytes([b])] for b in range(256)], np.int64)
        known_pairs = sorted((self.id[a] << 32 | self.id[b], k, self.id[a + b]) for (a, b), k in self.rank.items())
        self.pair, self.pair_rank, made = np.array([*known_pairs, (1 << 62, NEVER, 0)], np.int64).T.copy()
        self.made = np.zeros(len(known_pairs), np.int64)
        self.made[self.pair_rank[:-1]] = made[:-1]
        special = {} if plain else {t["content"]: t["id"] for t in known["added_tokens"]}
        self.added, self.special = list(special), {t: np.array([k], "<u4").tobytes() for t, k in special.items()}
        self.cuts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words = Words(lambda word: array("I", self.merge(word.encode())).tobytes(), CACHED)

    def merge(self, word: bytes) -> list[int]:
        bounds = self._scan(word) if len(word) <= SHORT else self._heap(word)
        return [self.id[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids."""
        wanted = left << 32 | right
        at = np.searchsorted(self.pair, wanted)
        return np.where(self.pair[at] == wanted, self.pair_rank[at], NEVER)

    def _scan_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """ids of words of at most `width` bytes, as little-endian bytes; each word is a row."""
        n, size = len(words), np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        token = self.byte[data]  # id of the part that starts at a byte
        bounds = np.minimum(np.arange(width + 1), size[:, None])
        columns = np.arange(width + 1)
        ranks = np.where(columns[1:-1] < size[:, None], self.first_row[data[:, :-1].astype(np.uint16) << 8 | data[:, 1:]], NEVER)
        live, count = np.arange(n), size.copy()
        while len(live):
            k = ranks[live].argmin(axis=1)
            least = ranks[live, k]
            live, k, least = (x[least < NEVER] for x in (live, k, least))
            token[live, bounds[live, k]] = self.made[least]
            bounds[live] = np.take_along_axis(bounds[live], np.minimum(columns + (columns > k[:, None]), width), axis=1)
            ranks[live] = np.take_along_axis(np.concatenate([ranks[live], np.full((len(live), 1), NEVER)], axis=1), columns[:-2] + (columns[:-2] >= k[:, None]), axis=1)
            count[live] -= 1
            for at, rows in ((k - 1, k > 0), (k, k < count[live] - 1)):
                r, c = live[rows], at[rows]
                ranks[r, c] = self._look(token[r, bounds[r, c]], token[r, bounds[r, c + 1]])
        ids = np.take_along_axis(token, np.minimum(bounds[:, :-1], width - 1), axis=1)[columns[:-1] < count[:, None]].astype("<u4").tobytes()
        ends = 4 * np.cumsum(count)
        return [ids[a:b] for a, b in zip((ends - 4 * count).tolist(), ends.tolist(), strict=True)]

    def learn(self, words: set[str]) -> None:
        """Merges words that the cache doesn't hold."""
        new = [w for w in words if w not in self.words]
        if len(new) < FEW:
            return
        if len(self.words) + len(new) > self.words.limit:
            self.words.clear()
            new = list(words)
        groups = [([], []) for _ in WIDTHS]
        for w in new:
            data = w.encode()
            if 0 < len(data) <= WIDTHS[-1]:
                names, bytes_ = groups[bisect_left(WIDTHS, len(data))]
                names.append(w)
                bytes_.append(data)
        for width, (names, bytes_) in zip(WIDTHS, groups, strict=True):
            for at in range(0, len(names), 1 << 15):
                self.words.update(zip(names[at : at + (1 << 15)], self._scan_rows(bytes_[at : at + (1 << 15)], width), strict=True))

    def _scan(self, word: bytes) -> list[int]:
        """Boundaries of the word's parts, after all merges."""
        rank, first = self.rank.get, self.first
        bounds = list(range(len(word) + 1))
        ranks = [first[a << 8 | b] for a, b in zip(word, word[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            k = ranks.index(least)
            del bounds[k + 1], ranks[k]
            a, b = bounds[k], bounds[k + 1]
            part = word[a:b]
            if k:
                ranks[k - 1] = rank((word[bounds[k - 1] : a], part), NEVER)
            if k < len(ranks):
                ranks[k] = rank((part, word[b : bounds[k + 2]]), NEVER)
        return bounds

    def _heap(self, word: bytes) -> list[int]:
        """The same by a heap of (rank, where the left part starts); a part's entry counts while its rank is the one noted."""
        n, rank = len(word), self.rank
        after, before, now = list(range(1, n + 1)), list(range(-1, n)), {}
        heap = []

        def look(k: int) -> None:
            m = after[k]
            r = rank.get((word[k:m], word[m : after[m]]), NEVER) if m < n else NEVER
            now[k] = r
            if r < NEVER:
                heapq.heappush(heap, (r, k))

        for k in range(n - 1):
            look(k)
        while heap:
            r, k = heapq.heappop(heap)
            if now.get(k) != r:
                continue
            gone = after[k]
            after[k] = after[gone]
            before[after[k]] = k
            now.pop(gone, None)
            look(k)
            if before[k] >= 0:
                look(before[k])
        bounds = [0]
        while bounds[-1] < n:
            bounds.append(after[bounds[-1]])
        return bounds

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and not text.isprintable() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Letters that came into Unicode after this Python: only the tokenizer's own tables tell which are letters for it.
            return _pre_tokenizer(self.path, text)
        return PATTERN.findall(text)

    def _text(self, text: str) -> bytes:
        words = self._split(text)
        if len(words) >= FEW:
            self.learn(set(words))
        return b"".join(map(self.words.__getitem__, words))

    def whole(self, text: str) -> bytes:
        parts = self.cuts.split(text) if self.cuts else [text]
        return b"".join(self.special[x] if k % 2 else self._text(x) for k, x in enumerate(parts))

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        # Most pieces are one word of plain letters or digits, which the pattern leaves whole.
        whole = pc.match_substring_regex(pieces, "^ ?(?:[A-Za-z]+|[0-9]+)$")
        single, split = pieces.filter(whole).to_pylist(), [self._split(t) for t in pieces.filter(pc.invert(whole)).to_pylist()]
        self.learn({w for words in split for w in words}.union(single))
        get = self.words.__getitem__
        ids = pa.concat_arrays([pa.array(map(get, single), pa.large_binary()), pa.array((b"".join(map(get, words)) for words in split), pa.large_binary())])
        mask = np.asarray(whole.cast(pa.uint8())).astype(bool)
        return ids.take(pa.array(np.where(mask, np.cumsum(mask) - 1, mask.sum() + np.cumsum(~mask) - 1)))


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


def _pre_tokenizer(path: str, text: str) -> list[str]:
    return [text[a:b] for _, (a, b) in _library(path).pre_tokenize_str(text)]


@functools.cache
def encoder(path: str, plain: bool = False) -> RankArrays:
    return RankArrays(path, plain)


@functools.cache
def token_table(path: str) -> pa.Array:
    return pa.array(token_bytes(path), pa.large_binary())


def _encode(path: str, plain: bool):
    def run(it):
        for batch in batches(it, 20_000, SLICE):
            ids = encoder(path, plain).texts(batch["text"])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])
            pa.default_memory_pool().release_unused()

    return run


def _text(data: bytes | None) -> bytes:
    try:
        str(data or b"", "utf-8")
        return data or b""
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()


def _decode(path: str):
    def run(it):
        table = token_table(path)
        for batch in batches(it, 20_000, SLICE):
            lists = batch["ids"].fill_null([])
            ends = np.asarray(lists.offsets).astype(np.int64)
            ids = lists.flatten()
            known = pa.array(np.where((np.asarray(ids) >= 0) & (np.asarray(ids) < len(table)), np.asarray(ids), len(table)))
            rows = join_rows(pa.concat_arrays([table, pa.array([b""], pa.large_binary())]), known, ends - ends[0])
            texts = pa.array([_text(x) for x in rows.to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], texts], ["doc_id", "ids", "text"])
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, path: str, plain: bool = False) -> DataFrame:
    """doc_id, ids of every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(path, plain), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of every row of encoded (doc_id, ids); ids without a token have no text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids array<int>, text string")
