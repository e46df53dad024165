"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their prefixes, lower-cased (A-Z) and without punctuation around them, hashed to
2**HASH_BITS buckets. Spark counts the buckets of the fitting sample by label. Every bucket of the sample has a weight and
a vector of RANK numbers, so that pairs of terms (an insult and a group's mention) count beyond their sum; its value grows with
how far the label's share among its texts is from the share overall, in standard deviations, and with its texts' number, so that the many terms
that tell little count little; none is left out.
The machine is fitted by AdaGrad on a sample of at most BOUND labelled rows (a parameter); weights for the sample's
buckets, 2**HASH_BITS at most, are what is broadcast. Every text is scored whole: a bias, its terms' weights and all pairs of their vectors.

Rows: null or empty text: scored by the constant term. Null doc_id: scored, not held out. Repeated rows: each
scored. Repeated doc_id in the sample: the smallest text counts, once. Very long texts: whole. Ties (a score of just 0.5): toxic. Empty labels: the constant
term is 0, every score 0.5 less a rounding. Empty table: no rows. Other columns are ignored (with_score keeps them).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpuslens.llm.common import Words, batches, free_name, raw, release, split_words, stage
from corpuslens.llm.labelled import held_out, labelled_sample

HASH_BITS = 20
RANK = 4
BOUND = 8192
#: Standard deviations at which a term has half of its full value.
TELLING = 6.0
#: Texts of the sample that have a term weigh as much as a squared standard deviation: what many have may tell something in pairs.
COMMON = 50
PREFIXES = (4, 5, 6, 7)
EDGES = b".,;:!?%$&#*|()[]{}<>\"'`-_/\\"


def buckets(word: bytes) -> list[int]:
    """Hash buckets of a word and of its prefixes (whole letters)."""
    core = word.lower().strip(EDGES).decode("utf-8", "replace")
    if not core:
        return []
    terms = [f"={core}", *(f"^{core[:k]}" for k in PREFIXES if len(core) >= k)]
    return [xxhash.xxh64_intdigest(t, 5) >> (64 - HASH_BITS) for t in terms]


def _terms(it):
    cache = Words(buckets)
    for batch in batches(it):
        found = [sorted({b for w in set(x.split()) for b in cache[w]}) for x in raw(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["y"], pa.array(found, pa.list_(pa.int32()))], ["y", "terms"])


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; by a plain sort, which is far quicker than np.unique here."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _sums(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; ends: where each sum's rows end."""
    total = np.concatenate([np.zeros((1, *rows.shape[1:])), np.cumsum(rows, axis=0, dtype=float)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


class Machine:
    """bias; of each term (sorted buckets) the linear weight and the vector, times the term's value."""

    def __init__(self, terms: np.ndarray, values: np.ndarray):
        self.terms, self.values = terms.astype(np.int64), values.astype(np.float32)
        self.bias, self.linear = 0.0, np.zeros(len(terms), np.float32)
        self.vectors = np.random.default_rng(1).normal(0, 0.02, (len(terms), RANK)).astype(np.float32)

    def raw_score(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of texts whose terms are self.terms[at], one text after the other."""
        x = self.values[at]
        v = self.vectors[at] * x[:, None]
        both = _sums(np.column_stack([self.linear[at] * x, (v * v).sum(axis=1), v]), ends)
        return self.bias + both[:, 0] + 0.5 * ((both[:, 2:] ** 2).sum(axis=1) - both[:, 1])

    def fit(self, at: np.ndarray, ends: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.4, decay: float = 1e-4, size: int = 128) -> Machine:
        if not len(y):
            return self
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(share / (1 - share)))
        random = np.random.default_rng(2)
        begins = np.concatenate([[0], ends[:-1]])
        squares, squares_v, squares_b = np.full(len(self.linear), 1e-2, np.float32), np.full(self.vectors.shape, 1e-2, np.float32), 1e-2
        steps = []
        for rows in np.array_split(random.permutation(len(y)), max(1, len(y) // size)):
            count = (ends - begins)[rows]
            mine = at[np.repeat(begins[rows] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            order = np.argsort(mine, kind="stable").astype(np.int32)
            used, first = np.unique(mine[order], return_index=True)
            steps.append((rows, mine, np.repeat(np.arange(len(rows), dtype=np.int32), count), order, used, np.append(first[1:], len(order))))
        for _ in range(epochs):
            for k in random.permutation(len(steps)):
                rows, mine, row, order, used, used_ends = steps[k]
                x = self.values[mine][:, None]
                v = self.vectors[mine] * x
                row_ends = np.searchsorted(row, np.arange(len(rows)), "right")
                both = _sums(v, row_ends)
                score = self.bias + _sums(self.linear[mine] * x[:, 0], row_ends) + 0.5 * ((both**2).sum(axis=1) - _sums((v * v).sum(axis=1), row_ends))
                error = 1 / (1 + np.exp(-score.clip(-30, 30))) - y[rows]
                step = error.mean()
                squares_b += step**2
                self.bias -= rate * step / np.sqrt(squares_b)
                if len(used):
                    each = error[row][:, None] * x / len(rows)
                    sums = _sums(np.column_stack([each, each * (both[row] - v)])[order], used_ends)
                    g, g_v = sums[:, 0] + decay * self.linear[used], sums[:, 1:] + decay * self.vectors[used]
                    squares[used] += g**2
                    squares_v[used] += g_v**2
                    self.linear[used] -= rate * g / np.sqrt(squares[used])
                    self.vectors[used] -= rate * g_v / np.sqrt(squares_v[used])
        return self

    def places(self, found: np.ndarray) -> np.ndarray:
        """Where these buckets are among the terms; those that aren't there are left out."""
        at = np.minimum(np.searchsorted(self.terms, found.astype(np.int64)), max(len(self.terms) - 1, 0))
        return at[self.terms[at] == found].astype(np.int32) if len(self.terms) else at[:0].astype(np.int32)


def train(docs: DataFrame, labels: DataFrame, fold: int, remainder: int, bound: int = BOUND) -> Machine:
    rows = stage(labelled_sample(docs, labels, "toxic", fold, remainder, bound).mapInArrow(_terms, "y int, terms array<int>"), "terms")
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    share = ((totals["p"] or 0) + 0.5) / (totals["n"] + 1)
    # A value of nearly 0 where the label's share among the term's texts is the share overall, of nearly 1 where it is far off.
    tells = (F.col("a") - F.col("c") * share) ** 2 / (F.col("c") * share * (1 - share)) + F.col("c") / COMMON
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("y").alias("a"))
    known = counts.select("term", (tells / (tells + TELLING**2)).alias("value")).orderBy("term").toArrow()  # 2**HASH_BITS rows at most
    machine = Machine(known["term"].to_numpy(), known["value"].to_numpy())
    sample = rows.toArrow()  # the bounded sample, as numbers
    terms = sample["terms"].combine_chunks()
    machine = machine.fit(machine.places(terms.flatten().to_numpy()), np.cumsum(np.asarray(terms.value_lengths()), dtype=np.int64), sample["y"].to_numpy().astype(float))
    del known, sample, terms
    release()
    return machine


def _score(shared: Broadcast, name: str):
    def run(it):
        machine = shared.value
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[machine.terms] = np.arange(len(machine.terms))
        place = memoryview(place)
        cache = Words(lambda w: [k for b in buckets(w) if (k := place[b]) >= 0])
        for batch in batches(it, 4000, 5_000_000):
            distinct, codes, ends = split_words(batch["text"])
            cores = pc.utf8_trim(pc.ascii_lower(distinct), EDGES.decode()).dictionary_encode()  # as `buckets` takes them
            distinct, codes = cores.dictionary, np.asarray(cores.indices)[codes].astype(np.int64)
            terms = [cache[w] for w in distinct.cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, terms), np.int64, len(terms))
            flat, first = np.fromiter(itertools.chain.from_iterable(terms), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes
            text = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
            said = _distinct(text * max(len(distinct), 1) + codes)  # a text's words once
            text, codes = said // max(len(distinct), 1), said % max(len(distinct), 1)
            count = sizes[codes]
            at = flat[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[codes], count)]
            both = _distinct(np.repeat(text, count) * max(len(machine.terms), 1) + at)
            text, at = both // max(len(machine.terms), 1), both % max(len(machine.terms), 1)
            scores = machine.raw_score(at, np.searchsorted(text, np.arange(batch.num_rows), "right"))
            score = 1 / (1 + np.exp(-scores.clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])
            pa.default_memory_pool().release_unused()

    return run


def with_score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """All columns of docs (in place of one of that name), and the score."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(machine), name), schema)


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score under the threshold."""
    name = free_name(docs.columns, "toxicity")
    return with_score(docs, machine, name).where(F.col(name) < threshold).drop(name)


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, remainder: int = 0, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels, fold, remainder, bound))
    return scored.select("doc_id", held_out(fold, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
