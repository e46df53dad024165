"""LM scoring by cross-entropy difference.

Two matched bigram models, target and background, share one vocabulary and one smoothing: every word and every bigram of the corpus
is counted, none is pruned. The background counts every text, the target the texts it names.

Texts are numbered in chunks of about CHUNK words. A chunk asks for the corpus's counts of its own distinct words and bigrams, each key
(a 64-bit hash) in the bucket that its first bits give; a bucket sums what all chunks have of its keys and answers each chunk in
the order it asked. So the counts stay dealt out over buckets, whose number grows with the corpus, a task holds one chunk or one bucket,
and a frequent key takes no more than one place a chunk. Only totals (words, distinct words) reach the driver.

p(w | h) = (1 - L) p(w) + L c(h, w) / c(h), p(w) with one added to each count. A text's score is
(sum of -log p_target + log p_background) / words: lower is nearer to the target.

Rows: null or empty text: 0 words, entropies and score 0. Null doc_id: scored, never in the target. Repeated rows: each counted and
scored; repeated target ids name their texts once. Very long texts: whole, a chunk is never smaller than its longest text. Ties: equal texts have equal scores.
No target rows: a model of added ones. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import batches, mix, raw, stage, word_hashes

#: Words of a chunk of texts (a text is never cut), and of the corpus for each bucket of counts.
CHUNK = 2_000_000
BUCKET = 4_000_000
MIXED = 0.6
#: The head of a text's first word.
START = mix(np.array([0x57A57], np.uint64))[0]
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of keys, and how many counts each has: words (as words and as heads, in all texts and in the target's), bigrams (the two of them).
WORDS, PAIRS = 0, 1
COUNTS = {WORDS: 4, PAIRS: 2}


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that those which are small or near each other get short."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if x.size else b""


def _unpack(data: bytes, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size).T).reshape(-1).view(kind)


def _chunks(it):
    """(chunk, ids, sizes, n_words, words, n_tokens, tokens) of a partition's texts: words are sorted hashes, tokens places among them."""
    made, tokens, ids, held = 0, 0, [], []

    def out():
        words, at = np.unique(np.concatenate([[START], *held]), return_inverse=True)
        row = [TaskContext.get().partitionId() << 32 | made, list(ids), _pack(np.array([len(x) for x in held], np.int64)), len(words), _pack(np.diff(words, prepend=np.uint64(0))), tokens, _pack(at[1:].astype(np.uint32))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        ids.clear()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["chunk", "ids", "sizes", "n_words", "words", "n_tokens", "tokens"])

    for batch in batches(it):
        for doc_id, text in zip(batch["doc_id"].to_pylist(), raw(batch["text"]), strict=True):
            ids.append(doc_id)
            held.append(word_hashes(text.lower()))
            tokens += len(held[-1])
            if tokens >= CHUNK or len(ids) >= CHUNK // 8:
                yield out()
                made, tokens = made + 1, 0
    if ids:
        yield out()


class Chunk:
    """A chunk's row, read again: its words, and of each token the word, the head and the bigram."""

    def __init__(self, row: dict):
        self.ids, self.words = row["ids"], np.cumsum(_unpack(row["words"], np.uint64, row["n_words"]), dtype=np.uint64)
        self.sizes = _unpack(row["sizes"], np.int64, len(self.ids))
        self.tokens = _unpack(row["tokens"], np.uint32, row["n_tokens"]).astype(np.int64)
        self.heads = np.roll(self.tokens, 1)
        self.heads[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = np.searchsorted(self.words, START)
        self.pairs, self.pair = np.unique(mix(self.words[self.heads] * _ODD + self.words[self.tokens]), return_inverse=True)

    def counts(self, hits: list[int]) -> dict[int, np.ndarray]:
        """Of each key: its occurrences in all texts and in those at the places `hits`."""
        chosen = np.zeros(len(self.ids), bool)
        chosen[hits] = True
        chosen = np.repeat(chosen, self.sizes)
        count = lambda at, n: [np.bincount(x, minlength=n) for x in (at, at[chosen])]
        words = len(self.words)
        return {WORDS: np.stack(count(self.tokens, words) + count(self.heads, words)), PAIRS: np.stack(count(self.pair, len(self.pairs)))}


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted keys have rising buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask(buckets: int):
    """(bucket, chunk, kind, size, keys, counts) of every bucket in which a chunk has keys."""

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk, out = Chunk(row), []
                for kind, counts in chunk.counts(row["hits"] or []).items():
                    keys = chunk.words if kind == WORDS else chunk.pairs
                    there, first = np.unique(_bucket(keys, buckets), return_index=True)
                    for b, low, high in zip(there.tolist(), first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True):
                        out.append((b, row["chunk"], kind, high - low, _pack(np.diff(keys[low:high], prepend=np.uint64(0))), _pack(counts[:, low:high].astype(np.uint32))))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "chunk", "kind", "size", "keys", "counts"])

    return run


ANSWER = "chunk long, kind int, bucket long, size long, counts binary, n long, t long"


def _answer(asked: pa.Table) -> pa.Table:
    """A bucket's sums, for each question in its order; and in a row without chunk its distinct words and their occurrences."""
    out, rows = [], asked.to_pylist()
    for kind, columns in COUNTS.items():
        mine = [r for r in rows if r["kind"] == kind]
        if not mine:
            continue
        keys = np.concatenate([np.cumsum(_unpack(r["keys"], np.uint64, r["size"]), dtype=np.uint64) for r in mine])
        distinct, where = np.unique(keys, return_inverse=True)
        counts = np.concatenate([_unpack(r["counts"], np.uint32, columns * r["size"]).reshape(columns, -1) for r in mine], axis=1)
        sums = np.stack([np.bincount(where, weights=c, minlength=len(distinct)).astype(np.int64) for c in counts])
        at = 0
        for r in mine:
            out.append((r["chunk"], kind, r["bucket"], r["size"], _pack(sums[:, where[at : at + r["size"]]]), 0, 0))
            at += r["size"]
        if kind == WORDS:
            out.append((None, kind, mine[0]["bucket"], int((sums[0] > 0).sum()), None, int(sums[0].sum()), int(sums[1].sum())))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk", "kind", "bucket", "size", "counts", "n", "t"])


def _score(words: int, totals: tuple[int, int]):
    """Scores of a chunk's texts, given the answers to it; totals: words of the target's texts and of all."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, rows = Chunk(chunks.to_pylist()[0]), sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        known = {kind: np.concatenate([_unpack(r["counts"], np.int64, n * r["size"]).reshape(n, -1) for r in rows if r["kind"] == kind] or [np.zeros((n, 0), np.int64)], axis=1) for kind, n in COUNTS.items()}
        text = np.repeat(np.arange(len(chunk.ids)), chunk.sizes)
        entropies = []
        for model, total in ((1, totals[0]), (0, totals[1])):
            alone = (known[WORDS][model] + 1) / (total + words + 2)
            heads = np.maximum(known[WORDS][2 + model], 1)
            nats = -np.log((1 - MIXED) * alone[chunk.tokens] + MIXED * known[PAIRS][model][chunk.pair] / heads[chunk.heads])
            entropies.append(np.bincount(text, weights=nats, minlength=len(chunk.ids)) / np.maximum(chunk.sizes, 1))
        t, b = entropies
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes), pa.array(t), pa.array(b), pa.array(t - b)], ["doc_id", "n_words", "target_entropy", "background_entropy", "score"])

    return run


def score_lm(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, target_entropy, background_entropy, score of every row of docs (doc_id, text); target: doc_id of the in-domain texts."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    chunks = stage(rows.mapInArrow(_chunks, "chunk long, ids array<long>, sizes binary, n_words long, words binary, n_tokens long, tokens binary"), "chunks")
    buckets = (chunks.agg(F.sum("n_tokens")).first()[0] or 0) // BUCKET + 1
    # Target ids grow with the corpus: the join is a shuffle at every size. Of the texts only the ids take part in it.
    mine = target.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    hits = chunks.select("chunk", F.posexplode("ids").alias("at", "doc_id")).join(mine.hint("merge"), "doc_id").groupBy("chunk").agg(F.collect_list("at").alias("hits"))
    asked = chunks.join(hits.hint("merge"), "chunk", "left").mapInArrow(_ask(buckets), "bucket long, chunk long, kind int, size long, keys binary, counts binary")
    answers = stage(asked.groupBy("bucket").applyInArrow(_answer, ANSWER), "answers")
    words, n, t = (x or 0 for x in answers.where("chunk is null").agg(F.sum("size"), F.sum("n"), F.sum("t")).first())
    there = answers.where("chunk is not null").select("chunk", "kind", "bucket", "size", "counts").groupBy("chunk")
    return chunks.groupBy("chunk").cogroup(there).applyInArrow(_score(words, (t, n)), "doc_id long, n_words long, target_entropy double, background_entropy double, score double")
