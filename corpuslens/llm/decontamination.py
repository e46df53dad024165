"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK walk copies a word sequence to one three times as long, at each step going on to the next word or
staying, as a random function of step and word says; sequences at a small edit distance then have a small Hamming
distance. LSH keys are the symbols at SAMPLED random places of independent walks. How many walks there are follows from the recall
wanted: for each size of an item, from how often keys of sequences at the largest edit distance allowed are equal. A window of an item's size
with a key of the item's is verified exactly: the fewest word edits (insert, delete, replace) between the item and
any passage there. It is a leak at distance <= (1 - similarity) * item words.

A window is keyed only where it can still match: k edits leave an item of n words n - 1 - 2k of its word pairs at least, so windows
with fewer of them are no match (a necessary condition, nothing is lost). Lists from each pair to its items give the places
in a text where an item's pairs are; their order alone tells where enough of them are within the item's size.
A text that is shorter than the item, by the edits at most, is one window, verified without keys. Items under LEAST words, which
no edit is allowed, are looked up as they are.

Items are the stated query set, taken in blocks of BLOCK; a block is broadcast (a few numbers for each of its words), and every pass reads all
texts. Of several blocks, each but the last one's result is staged before the next one is made, so the driver holds two at most.
Words are lower-cased (A-Z) and stripped of punctuation around them.

Rows: null or empty text: no leak. Null doc_id: found with a null id. Items with null id or text, or without words: never found. Very long
texts: whole. Ties: the first shortest passage. Repeated documents each come back; repeated items give one row each. Empty tables: no
leaks. Other columns are ignored by find_leaks, and kept by drop_leaks.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import batches, mix, split_words, stage

SIMILARITY = 0.8
RECALL = 0.995
LEAST = 5
SAMPLED = 2
BLOCK = 5000
EDGES = b".,;:!?%$&#*|()[]{}<>\"'`-_/\\"


def normal(word: bytes) -> bytes:
    return word.lower().strip(EDGES)


def _symbol(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 3) >> 1 or 1


def cgk_keys(windows: np.ndarray, repeats: int, seed: int = 17) -> np.ndarray:
    """[window, repeat]: LSH keys of windows (word symbols, one row each)."""
    count, n = windows.shape
    steps = 3 * n
    random = np.random.default_rng(seed + n)
    sampled = np.stack([np.isin(np.arange(steps), random.choice(steps, SAMPLED, replace=False)) for _ in range(repeats)])
    salts = random.integers(1, 1 << 62, (steps, repeats), dtype=np.int64).astype(np.uint64)
    padded = np.concatenate([windows.astype(np.uint64), np.zeros((count, 1), np.uint64)], axis=1)
    at, key = np.zeros((count, repeats), np.int64), np.zeros((count, repeats), np.uint64)
    key += mix(np.arange(1, repeats + 1))
    rows = np.arange(count)[:, None]
    for step in range(steps):
        symbol = padded[rows, at]
        if (take := sampled[:, step]).any():
            key[:, take] = mix(key[:, take] ^ symbol[:, take])
        at = np.minimum(at + (mix(symbol ^ salts[step]) & np.uint64(1)).astype(np.int64), n)
    return key


@functools.cache
def repeats_for(n: int, edits: int, recall: float) -> int:
    """Walks by which a sequence of n words and one that is `edits` random edits away share a key with probability `recall`, by 24 such pairs with 48 walks each."""
    if not edits:
        return 1
    r, pairs, trials = np.random.default_rng(n), 24, 48
    made = []
    for _ in range(pairs):
        item = r.integers(1, 1 << 62, n).tolist()
        other = list(item)
        for kind in r.integers(0, 3, edits).tolist():
            at = int(r.integers(0, len(other)))
            other[at : at + (kind > 0)] = [int(r.integers(1, 1 << 62))] * (kind < 2)  # insert, replace, delete
        made += [item, (other + r.integers(1, 1 << 62, n).tolist())[:n]]
    keys = cgk_keys(np.array(made, np.int64), trials)
    shared = ((keys[::2] == keys[1::2]).sum(axis=1) + 0.5) / (trials + 1)
    repeats = 1
    while (1 - (1 - shared) ** repeats).mean() < recall:
        repeats += 1
    return repeats


def _ends(item: list[int], text: list[int]) -> list[int]:
    """Fewest edits between the item and a passage of the text that ends before each place: a column of the table as two bit vectors."""
    at: dict[int, int] = {}
    for k, word in enumerate(item):
        at[word] = at.get(word, 0) | 1 << k
    full, top, distance = (1 << len(item)) - 1, 1 << (len(item) - 1), len(item)
    up, down, out = full, 0, [distance]  # where the column rises and falls from one item word to the next
    for word in text:
        match = at.get(word, 0)
        zero = (((match & up) + up) ^ up) | match | down
        rise, fall = down | (full & ~(zero | up)), up & zero
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | (full & ~(zero | rise)), rise & zero
        out.append(distance)
    return out


def edit_distance(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(distance, start, end): fewest word edits between the item and any passage of the text; the shortest first one that has them."""
    ends = _ends(item, text)
    distance = min(ends)
    end = ends.index(distance)
    return distance, end - _ends(item[::-1], text[:end][::-1]).index(distance), end


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, `count` of them, in a row."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, recall: float = RECALL):
        if similarity <= 0.6:
            raise ValueError("at a similarity of 0.6 or less an item need not keep any of its word pairs")
        self.words: dict[bytes, int] = {}
        self.items = []
        #: Of items under LEAST words: ids by size and words.
        self.short: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            words = [normal(w) for w in text.encode().split()]
            if not any(words):
                continue
            numbers = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            if len(words) >= LEAST:
                self.items.append((item_id, numbers))
            else:
                self.short[len(words)][tuple(numbers)].append(item_id)
        self.short = {n: dict(found) for n, found in self.short.items()}
        self.symbols = np.array([0, *(_symbol(w) for w in self.words)], np.uint64)
        self.base = len(self.words) + 1
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.edits = np.array([int((1 - similarity) * n + 1e-9) for n in self.sizes.tolist()], np.int64)
        self.need = self.sizes - 1 - 2 * self.edits
        # From each word pair to its items: those of pairs[k] are holders[first[k] : first[k + 1]].
        pairs = [np.unique(np.array(w[:-1], np.int64) * self.base + np.array(w[1:], np.int64)) for _, w in self.items]
        every, holders = (np.concatenate(pairs), np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(every, kind="stable")
        self.pairs, first = np.unique(every[order], return_index=True)
        self.holders, self.first = holders[order], np.append(first, len(order))
        # An item's rarest pairs among these items: an edit undoes two at most, so one of 2 edits + 1 of them is in every passage within the distance.
        held, rare = np.diff(self.first), []
        self.own = [np.searchsorted(self.pairs, p) for p in pairs]
        for (_, w), edits in zip(self.items, self.edits.tolist(), strict=True):
            places = np.searchsorted(self.pairs, np.array(w[:-1], np.int64) * self.base + np.array(w[1:], np.int64))
            rare.append(np.unique(places[np.lexsort((places, held[places]))[: 2 * edits + 1]]))
        every, holders = (np.concatenate(rare), np.repeat(np.arange(len(rare)), [len(p) for p in rare])) if rare else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(every, kind="stable")
        self.rare, self.rare_first = holders[order], np.searchsorted(every[order], np.arange(len(self.pairs) + 1))
        #: Of each item, its keys; by size as many as its recall takes.
        self.keys: dict[int, np.ndarray] = {}
        for n in np.unique(self.sizes).tolist():
            ks = np.flatnonzero(self.sizes == n)
            keys = cgk_keys(self.symbols[np.array([self.items[k][1] for k in ks])], repeats_for(n, int(self.edits[ks[0]]), recall))
            self.keys |= zip(ks.tolist(), keys, strict=True)

    def search(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, words) in texts laid end to end; ids: numbers of words, 0 for unknown ones; ends: where texts end."""
        if not len(ids):
            return []
        return self._short(ids, ends) + (self._long(ids, ends) if self.items else [])

    def _short(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Exact passages of the items under LEAST words, the first one in each text."""
        out: dict[tuple[int, int, tuple], int] = {}
        for n, items in self.short.items():
            wanted, by = np.array(list(items), np.int64), mix(np.arange(1, n + 1)).view(np.int64)
            start = np.flatnonzero(np.isin(ids[: max(len(ids) - n + 1, 0)], wanted[:, 0]))
            doc = np.searchsorted(ends, start, "right")
            start, doc = start[start + n <= ends[doc]], doc[start + n <= ends[doc]]
            windows = ids[start[:, None] + np.arange(n)]
            here = np.isin(windows @ by, wanted @ by)
            for at, d, words in zip(start[here].tolist(), doc[here].tolist(), windows[here].tolist(), strict=True):
                if tuple(words) in items:
                    out.setdefault((d, n, tuple(words)), at)
        return [(d, item_id, 0, at - (int(ends[d - 1]) if d else 0), n) for (d, n, words), at in out.items() for item_id in self.short[n][words]]

    def _places(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of all word pairs of items, where enough of any are near each other; in order."""
        last = np.zeros(len(ids) + 1, bool)
        last[ends - 1] = True  # no pair crosses texts (an end of 0 falls on the place behind the last word)
        maybe = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[maybe] * self.base + ids[maybe + 1]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        known = (self.pairs[at] == code) & ~last[maybe]
        place, pair = maybe[known], at[known]
        near = np.zeros(len(place), bool)
        for n, need in sorted({*zip(self.sizes.tolist(), self.need.tolist(), strict=True)}):
            if len(place) >= need:
                dense = np.flatnonzero(place[need - 1 :] - place[: len(place) - need + 1] <= n - 2)
                step = np.zeros(len(place) + 1, np.int64)
                np.add.at(step, dense, 1)
                np.add.at(step, dense + need, -1)
                near |= np.cumsum(step[:-1]) > 0
        place, pair = place[near], pair[near]
        # (text, item) where one of the item's rare pairs is; of those alone all places are looked up.
        count = self.rare_first[pair + 1] - self.rare_first[pair]
        item = self.rare[_ranges(self.rare_first[pair], count)]
        doc = np.searchsorted(ends, place, "right")
        met = np.unique(np.repeat(doc, count) * len(self.items) + item)
        doc_of, item = met // len(self.items), met % len(self.items)
        # Places by text and pair; an item's pairs are found among its text's.
        code = doc * (len(self.pairs) + 1) + pair
        order = np.argsort(code, kind="stable")
        sizes = np.array([len(x) for x in self.own], np.int64)[item]
        wanted = np.repeat(doc_of, sizes) * (len(self.pairs) + 1) + (np.concatenate([self.own[k] for k in item.tolist()]) if len(item) else np.empty(0, np.int64))
        low, high = (np.searchsorted(code[order], wanted, side) for side in ("left", "right"))
        item, place = np.repeat(np.repeat(item, sizes), high - low), place[order[_ranges(low, high - low)]]
        order = np.lexsort((place, item))
        return item[order], place[order]

    def _long(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        text_of = lambda at: np.searchsorted(ends, at, "right")
        item, place = self._places(ids, ends)
        seen = set()
        lengths = np.diff(ends, prepend=0)
        # Texts shorter than the item: the pairs in them are counted.
        doc = text_of(place)
        shorter = (lengths[doc] < self.sizes[item]) & (lengths[doc] >= (self.sizes - self.edits)[item])
        both, counted = np.unique(np.stack([item[shorter], doc[shorter]], axis=1), axis=0, return_counts=True)
        seen.update((int(ends[d] - lengths[d]), k) for k, d in both[counted >= self.need[both[:, 0]]].tolist())
        # Others: the windows that hold `need` places of the item, from the last one's end to the first one's start.
        last = np.arange(len(item)) + self.need[item] - 1
        fits = np.flatnonzero(last < len(item))
        fits = fits[(item[last[fits]] == item[fits]) & (place[last[fits]] - place[fits] <= self.sizes[item[fits]] - 2) & (doc[last[fits]] == doc[fits])]
        low = np.maximum(place[last[fits]] - self.sizes[item[fits]] + 2, (ends - lengths)[doc[fits]])
        high = np.minimum(place[fits], ends[doc[fits]] - self.sizes[item[fits]])
        count = np.maximum(high - low + 1, 0)
        starts = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        met = np.unique(np.stack([np.repeat(item[fits], count), starts], axis=1), axis=0)
        for n in np.unique(self.sizes[met[:, 0]]).tolist():
            mine = met[self.sizes[met[:, 0]] == n]
            for part in np.array_split(mine, len(mine) // 20_000 + 1):
                windows = ids[part[:, 1][:, None] + np.arange(n)]
                _, first, where = np.unique(windows @ mix(np.arange(n)).view(np.int64), return_index=True, return_inverse=True)
                keys = cgk_keys(self.symbols[windows[first]], len(self.keys[int(part[0, 0])]))[where]  # equal windows have equal keys
                equal = (keys == np.stack([self.keys[k] for k in part[:, 0].tolist()])).any(axis=1)
                seen.update((at, k) for k, at in part[equal].tolist())
        spans = defaultdict(list)  # neighbouring windows of one text and item are verified at once
        for start, k in sorted(seen):
            n, doc = len(self.items[k][1]), int(text_of(start))
            low, high = max(start - int(self.edits[k]), int(ends[doc - 1]) if doc else 0), min(start + n + int(self.edits[k]), int(ends[doc]))
            mine = spans[doc, k]
            if mine and low <= mine[-1][1] and high - mine[-1][0] <= 4 * n:
                mine[-1][1] = high
            else:
                mine.append([low, high])
        out = []
        for (doc, k), regions in spans.items():
            item_id, words = self.items[k]
            found = min((d, low + s, e - s) for low, high in regions for d, s, e in [edit_distance(words, ids[low:high].tolist())])
            if found[0] <= self.edits[k]:
                out.append((doc, item_id, found[0], found[1] - (int(ends[doc - 1]) if doc else 0), found[2]))
        return out


def _found(items: Items, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    distinct, codes, ends = split_words(texts)
    known = pc.index_in(pc.utf8_trim(pc.ascii_lower(distinct), EDGES.decode()), pa.array([w.decode() for w in items.words], pa.string()))
    ids = np.asarray(known.fill_null(-1)).astype(np.int64) + 1  # as `normal` gives them; 0 where no item has the word
    return items.search(ids[codes], ends)


def _report(shared: Broadcast):
    def run(it):
        items = shared.value
        for batch in batches(it):
            rows = _found(items, batch["text"])
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(columns[0], pa.int32())), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "distance", "start_word", "n_words"])

    return run


def _clean(shared: Broadcast):
    def run(it):
        items = shared.value
        for batch in batches(it):
            bad = {row[0] for row in _found(items, batch["text"])}
            yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

    return run


def item_blocks(benchmark: DataFrame, similarity: float, recall: float = RECALL, block: int = BLOCK):
    """Blocks of items, one at a time, broadcast."""
    rows = []

    def made():
        return benchmark.sparkSession.sparkContext.broadcast(Items(rows, similarity, recall))

    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        if len(rows) == block:
            yield made()
            rows = []
    if rows:
        yield made()


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, start_word, n_words: the best passage of each item in each document that has one within the distance."""
    rows, schema = docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, item_id long, distance long, start_word long, n_words long"
    out, last = docs.sparkSession.createDataFrame([], schema), None
    for items in item_blocks(benchmark, similarity, recall, block):
        if last:
            out = out.unionByName(stage(rows.mapInArrow(_report(last), schema), "leaks"))
            last.destroy()
        last = items
    return out.unionByName(rows.mapInArrow(_report(last), schema)) if last else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay."""
    schema, last = docs.schema, None
    for items in item_blocks(benchmark, similarity, recall, block):
        if last:
            docs = stage(docs.mapInArrow(_clean(last), schema), "clean")
            last.destroy()
        last = items
    return docs.mapInArrow(_clean(last), schema) if last else docs
