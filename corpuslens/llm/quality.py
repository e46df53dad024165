"""Quality by nearest neighbours among labelled latent-semantic vectors.

A text's terms are its lower-cased words and each word's shape (letters and digits folded to classes),
hashed to 2**HASH_BITS buckets; damped counts times inverse document frequency give its vector. A truncated SVD of
the fitting sample (at most BOUND labelled rows, a parameter) projects to DIMENSIONS. The sample's vectors and labels
are broadcast, BOUND * DIMENSIONS numbers at most; every text gets its exact cosines with all of them, a block of
texts at a time, and its NEIGHBOURS nearest vote by similarity.

Rows: null or empty text: no neighbour is nearer than another, the score is the sample's share of label 1. Null
doc_id: scored, not held out. Repeated rows: each scored. Repeated doc_id in the sample: the smallest text counts, once. Very long texts:
whole. Ties of neighbours (similarities equal to nine digits): the smaller doc_id first. Empty labels: every score is 0.5. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Words, batches, raw, stage
from corpuslens.llm.labelled import held_out, labelled_sample

HASH_BITS = 15
DIMENSIONS = 48
NEIGHBOURS = 15
BOUND = 4096
_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (re.compile(r"\d+"), "0"))


def buckets(word: bytes) -> tuple[int, int]:
    text = word.decode("utf-8", "replace")
    shape = text
    for pattern, into in _SHAPES:
        shape = pattern.sub(into, shape)
    return tuple(xxhash.xxh64_intdigest(t, 9) >> (64 - HASH_BITS) for t in (f"={text.lower()}", f"~{shape}"))


_cache = Words(buckets)


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's terms, and their damped counts: half the weight in words, half in shapes."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    both = np.array([_cache[w] for w in words])
    out = []
    for side in both.T:
        at, n = np.unique(side, return_counts=True)
        out.append((at, 1 + np.log(n)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


class Neighbours:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        n, size = len(rows), 1 << HASH_BITS
        self.labels = labels.astype(float)
        self.prior = float(self.labels.mean()) if n else 0.5
        df = np.zeros(size)
        for at, _ in rows:
            df[np.unique(at)] += 1
        self.idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.1, 0)  # terms that no labelled text has say nothing of neighbours
        x = [(at, self._unit(at, c)) for at, c in rows]
        # Randomized range finder: two passes over the sample's sparse rows.
        random = np.random.default_rng(4)
        k = min(DIMENSIONS, max(1, n))
        q = random.standard_normal((size, k + 8)).astype(np.float32)
        for _ in range(3):
            y = np.stack([c @ q[at] for at, c in x]) if n else np.zeros((0, k + 8))
            y = np.linalg.qr(y)[0] if n else y
            q = np.zeros((size, y.shape[1]), np.float32)
            for (at, c), row in zip(x, y, strict=True):
                np.add.at(q, at, np.outer(c, row).astype(np.float32))
            q = np.linalg.qr(q)[0] if n else q
        self.basis = q[:, :k].astype(np.float32)
        self.vectors = self._normal(np.stack([self.latent(at, c) for at, c in rows])) if n else np.zeros((0, k), np.float32)

    def _unit(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        v = c * self.idf[at]
        return (v / (np.sqrt((v**2).sum()) or 1)).astype(np.float32)

    @staticmethod
    def _normal(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x**2).sum(axis=1, keepdims=True))
        return (x / np.where(size > 0, size, 1)).astype(np.float32)

    def latent(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self._unit(at, c) @ self.basis[at] if len(at) else np.zeros(self.basis.shape[1], np.float32)

    @staticmethod
    def _nearest(near: np.ndarray, k: int) -> np.ndarray:
        """Places of each row's k largest, of equal ones the first."""
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(near, top, 1).min(axis=1, keepdims=True)
        for row in np.flatnonzero((near >= least).sum(axis=1) > k):
            above, equal = np.flatnonzero(near[row] > least[row]), np.flatnonzero(near[row] == least[row])
            top[row] = np.concatenate([above, equal[: k - len(above)]])
        return top

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(vectors), 0.5)
        near = (self._normal(vectors).astype(float) @ self.vectors.T.astype(float)).round(9)
        top = self._nearest(near, min(NEIGHBOURS, near.shape[1]))
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(float) ** 2
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1), self.prior).clip(0, 1)


def _count_rows(it):
    for batch in batches(it):
        found = [counts(x) for x in raw(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.float32()))], ["doc_id", "y", "at", "c"])


def train(docs: DataFrame, labels: DataFrame, fold: int, remainder: int, bound: int = BOUND) -> Neighbours:
    sample = labelled_sample(docs, labels, "quality", fold, remainder, bound)
    rows = stage(sample.mapInArrow(_count_rows, "doc_id long, y int, at array<int>, c array<float>"), "counts").toArrow().sort_by("doc_id")  # the bounded sample
    pairs = [(a.values.to_numpy().astype(np.int64), c.values.to_numpy()) for a, c in zip(rows["at"], rows["c"], strict=True)]
    return Neighbours(pairs, rows["y"].to_numpy())


def _score(model: Neighbours):
    def run(it):
        for batch in batches(it, 256):
            score = model.vote(np.stack([model.latent(*counts(x)) for x in raw(batch["text"])]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 4, remainder: int = 2, bound: int = BOUND, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold, remainder, bound))

    def run(it):
        yield from _score(model.value)(it)

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(fold, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
