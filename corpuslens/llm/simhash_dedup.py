"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last one padded to 23). Every segment
is decoded to the codewords of the binary Golay code within distance 4: one when its nearest codeword is
at distance 2 at most, else six. Two segments that differ in two bits at most always have a codeword in
common. Three errors or more in two of the three segments take six, so two fingerprints within five bits
have an equal key for at least one pair of segments. Keys bring candidates together, each is verified on all
64 bits.

Equal fingerprints are one node. Within a key's run a breadth-first search emits a spanning forest of the
verified links, which is less than one row per member however dense the run is; runs longer than RUN are
dealt into pairs of blocks first, so no task holds a key of any size.

Rows: null or empty text: fingerprint zero, linked like any other. Null doc_id: the row comes back, joins
its group, and never names it. Repeated rows each come back. Very long texts: whole. Ties of a bit: 0. Empty table: no rows. Other columns
are ignored. A run longer than RUN costs run / RUN copies of its rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Rolling, batches, connected_components, mix, perhaps_known, raw, stage, unstage, word_hashes

SEED = 42
BITS = 4
#: The most differing bits for which the keys are complete.
MOST_BITS = 5
RUN = 16_384
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: bytes, words: int) -> int:
    """Majority of the bits of XXH64 over the text's shingles; a tie is 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # sums of bytes that can't overflow
        ones += np.add.reduce(np.unpackbits(h[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _scan(words: int):
    def run(it):
        for batch in batches(it):
            fps = np.array([fingerprint(x, words) for x in raw(batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return run


def _remainder(x: int) -> int:
    """Of the polynomial x over GENERATOR: 0 for codewords, 11 bits else."""
    while (over := x.bit_length() - GENERATOR.bit_length()) >= 0:
        x ^= GENERATOR << over
    return x


@functools.cache
def _golay() -> tuple[np.ndarray, ...]:
    """Remainders of a word's low 12 and high 11 bits; by remainder, the count and the up to six error patterns."""
    low = np.array([_remainder(x) for x in range(1 << 12)])
    high = np.array([_remainder(x << 12) for x in range(1 << 11)])
    count, patterns = np.zeros(2048, np.int64), np.zeros((2048, 6), np.int64)
    for weight in range(5):
        for places in itertools.combinations(range(23), weight):
            error = sum(1 << k for k in places)
            r = low[error & 0xFFF] ^ high[error >> 12]
            patterns[r, count[r]] = error
            count[r] += 1
    return low, high, count, patterns


def near_codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) of every codeword within distance 4; 12 neighbouring bits tell codewords apart."""
    low, high, count, patterns = _golay()
    r = low[x & 0xFFF] ^ high[x >> 12]
    real = np.arange(6) < count[r][:, None]
    return np.nonzero(real)[0], (x[:, None] ^ patterns[r])[real] >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every pair of segments and of their near codewords."""
    n = len(fps)
    near = []
    for low, width in SEGMENTS:
        rows, words = near_codewords((fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64))
        near.append((np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), words))
    out_rows, out_keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ends_a, words_a), (ends_b, words_b) = near[a], near[b]
        na, nb = np.diff(ends_a), np.diff(ends_b)
        rows = np.repeat(np.arange(n), na * nb)
        k = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(na * nb)[:-1]]), na * nb)
        out_rows.append(rows)
        out_keys.append(pair << 24 | words_a[ends_a[rows] + k // nb[rows]] << 12 | words_b[ends_b[rows] + k % nb[rows]])
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _emit(it):
    for batch in batches(it, 4_000):
        fps = batch["fp"].to_numpy(zero_copy_only=False)
        rows, keys = fuzzy_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(fps[rows])], ["key", "fp"])


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Indices of a spanning forest of the links at `bits` differing bits at most."""
    links, left = [], np.arange(1, len(fps))
    todo = [0]
    while todo or len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        k = todo.pop()
        close = np.bitwise_count(fps[left] ^ fps[k]) <= bits
        if close.any():
            new = left[close].tolist()
            links += [(k, x) for x in new]
            todo += new
            left = left[~close]
    return links


def _runs(bits: int):
    def short(keys: np.ndarray, fps: np.ndarray):
        """Links of all runs of equal keys; a run of two needs no search."""
        first = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        size = np.diff(np.concatenate([first, [len(keys)]]))
        two = first[size == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits]
        a, b = [fps[two]], [fps[two + 1]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if links := forest(run := fps[at : at + n], bits):
                i, j = np.array(links).T
                a.append(run[i])
                b.append(run[j])
        return np.concatenate(a), np.concatenate(b)

    def run(it):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in it:
            keys = np.concatenate([keys, batch["run"].to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0  # the last run may go on
            if cut:
                yield _links(*short(keys[:cut], fps[:cut]))
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield _links(*short(keys, fps))

    return run


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])


def fingerprint_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), stored, of distinct fingerprints `fp` at `bits` <= MOST_BITS differing bits: spanning forests of all such links."""
    if bits > MOST_BITS:
        raise ValueError(f"the segments' keys are complete up to {MOST_BITS} bits")
    keyed = stage(fps.select("fp").mapInArrow(_emit, "key int, fp long"), "keys")
    long = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > RUN), "long")
    plain = keyed.join(long, "key", "left_anti").select(F.col("key").cast("long").alias("run"), "fp")
    # A long run: blocks of about RUN / 2, and a run of its own for every pair of blocks.
    blocks = keyed.join(long, "key").withColumn("b", F.ceil(F.col("n") / (RUN // 2)).cast("int")).withColumn("i", F.expr("cast(pmod(xxhash64(fp), b) as int)"))
    blocks = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    blocks = blocks.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).bitwiseOR(F.lit(-(1 << 63))).alias("run"), "fp")
    runs = plain.unionByName(blocks).repartition("run").sortWithinPartitions("run")
    links = stage(runs.mapInArrow(_runs(bits), "a long, b long"), "links")
    unstage(keyed, long)
    return links


def link_fingerprints(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, component) of the distinct fingerprints `fp` that have a link at `bits` <= MOST_BITS differing bits."""
    links = fingerprint_links(fps, bits)
    out = connected_components(links)
    unstage(links)
    return out


def simhash_groups(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text)."""
    prints = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(words), "doc_id long, fp long"), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    labels = nodes.join(link_fingerprints(nodes, bits), F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    labels = stage(labels, "labels")
    # Staged, so that both sides of the join come straight from a shuffle, where AQE splits a hot root.
    roots = stage(labels.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    known = stage(labels.join(roots, "root").select("fp", "component_id"), "known")
    unstage(nodes, labels, roots)
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by similarity: fingerprints, then minwise bands find candidates, shingles decide.
#
# At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, where no few codewords meet for sure; bands of minwise hashes do. So fingerprints' keys
# link the nearest copies, and the bands what is left between the groups.

#: Minwise hashes of a text, in rows of BAND for a key; of each hash four bits are kept to compare texts by.
HASHES, BAND = 128, 5
_MULTIPLIERS = mix(np.arange(101, 101 + HASHES, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64(0x1111111111111111)
SKETCH = HASHES // 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes of a text, sorted; a shorter text is one shingle, one without words none."""
    tokens = word_hashes(text.lower())
    if not len(tokens):
        return np.empty(0, np.uint64)
    at = np.arange(max(1, len(tokens) - words + 1))
    return np.unique(Rolling(tokens).span(at, np.minimum(at + words, len(tokens))))


def minwise(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Keys of a set's bands, and its sketch of four bits a hash; nothing of an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64), bytes(8 * SKETCH)
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _MULTIPLIERS).min(axis=0), out=least)
    least, bands = mix(least), HASHES // BAND
    rows, keys = least[: bands * BAND].reshape(bands, BAND), np.arange(bands, dtype=np.uint64)
    for k in range(BAND):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    nibbles = (least & np.uint64(15)).astype(np.uint8)
    return keys.view(np.int64), (nibbles[::2] | nibbles[1::2] << 4).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sketches (rows of words): how many hashes differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & _LOW).sum(axis=-1, dtype=np.int64)


def reach(similarity: float) -> int:
    """Differing hashes within which nearly all pairs of this similarity are: three and a half standard deviations over the mean."""
    share = (1 - similarity) * 15 / 16
    return math.ceil(HASHES * share + 3.5 * math.sqrt(HASHES * share * (1 - share)))


def _minwise_scan(words: int):
    def run(it):
        for batch in batches(it):
            keys, sketches, sets, fps = [], [], [], []
            for text in raw(batch["text"]):
                hashes = shingle_hashes(text, words)
                k, sketch = minwise(hashes)
                keys.append(k)
                sketches.append(sketch)
                sets.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                fps.append(majority(hashes))
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(sets, pa.binary()), fps, pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "shingles", "fp", "sketch", "keys"]
            )

    return run


def spanning(sketches: np.ndarray, limit: int, classes: np.ndarray, failed: list[list[int]], nodes: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of a minimum spanning forest of a run's pairs within the limit; a class is one already, and pairs that failed don't count."""
    n = len(sketches)
    if (classes == classes[0]).all():
        return []
    bad: dict[int, list[int]] = {}
    if any(failed):
        place = {x: k for k, x in enumerate(nodes.tolist())}
        for i, others in enumerate(failed):
            for j in (place[o] for o in others if o in place):
                bad.setdefault(i, []).append(j)
                bad.setdefault(j, []).append(i)
    links, left, near, by, k = [], np.arange(1, n), np.full(n, 1 << 20), np.zeros(n, np.int64), 0
    while len(left):
        far = apart(sketches[left], sketches[k])
        far[far > limit] = 1 << 20
        if k in bad:
            far[np.isin(left, bad[k])] = 1 << 20
        far[classes[left] == classes[k]] = -1
        closer = far < near[left]
        near[left[closer]], by[left[closer]] = far[closer], k
        at = int(near[left].argmin())
        k = int(left[at])
        if 0 <= near[k] <= limit:
            links.append((int(by[k]), k))
        left = np.delete(left, at)
    return links


def _forests(limit: int):
    """(run, node, the one before it) of runs' spanning forests; rows come run by run, by node, so that runs of the same texts have the same forest."""

    def short(rows: dict) -> pa.RecordBatch:
        first = np.concatenate([[0], np.flatnonzero(np.diff(rows["run"])) + 1, [len(rows["run"])]])
        run, node, near = [], [], []
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            part = {c: x[low:high] for c, x in rows.items()}
            for i, j in spanning(part["sketch"], limit, part["class"], part["failed"], part["node"]):
                run.append(part["run"][0])
                near.append(part["node"][i])
                node.append(part["node"][j])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (run, node, near)], ["run", "node", "o"])

    def run(it):
        held = None
        for batch in it:
            if not batch.num_rows:
                continue
            new = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("run", "node", "class")}
            new["sketch"] = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH)
            new["failed"] = batch["failed"].to_pylist()
            held = new if held is None else {c: held[c] + x if c == "failed" else np.concatenate([held[c], x]) for c, x in new.items()}
            cut = int(np.searchsorted(held["run"] == held["run"][-1], True))  # the last run may go on
            if cut:
                yield short({c: x[:cut] for c, x in held.items()})
                held = {c: x[cut:] for c, x in held.items()}
        if held is not None:
            yield short(held)

    return run


def _verified(words: int, similarity: float):
    def run(it):
        for batch in batches(it, 500):
            keep = []
            for k, (a, b) in enumerate(zip(raw(batch["ta"]), raw(batch["tb"]), strict=True)):
                x, y = shingle_hashes(a, words), shingle_hashes(b, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _runs_of(nodes: DataFrame) -> DataFrame:
    """run, node of nodes (node, keys) that share a key; a long run is dealt into pairs of blocks of about RUN / 2."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = keyed.join(shared, "key").withColumn("b", F.when(F.col("n") > RUN, F.ceil(F.col("n") / (RUN // 2))).otherwise(1).cast("int"))
    members = members.withColumn("i", F.expr("cast(pmod(xxhash64(node), b) as int)")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    run = F.when(F.col("b") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")))
    out = stage(members.select(run.alias("run"), "node"), "members")
    unstage(shared)
    return out


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), stored, of nodes (node, fp) whose fingerprints are linked: the first node of each, and the first with each of its equals."""
    firsts = stage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    links = fingerprint_links(firsts, MOST_BITS)
    near = links.distinct().join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    equal = nodes.select("fp", F.col("node").alias("y")).join(firsts.withColumnRenamed("first", "x"), "fp").where("x <> y")
    out = stage(near.select("x", "y").unionByName(equal.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "pairs")
    unstage(firsts, links)
    return out


def _alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b), stored, whose texts' shingles are as similar; few other texts are shuffled."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    texts = perhaps_known(texts.select("node", "text"), F.xxhash64("node"), asked, F.xxhash64("node"), "asked").where("asked")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return stage(both.select("a", "b", "ta", "tb").mapInArrow(_verified(words, similarity), "a long, b long"), "good")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), component_id of every row of docs (doc_id, text): groups linked by a Jaccard similarity of shingles.

    Fingerprints of the distinct shingles meet by their Golay keys; pairs within MOST_BITS are verified exactly on the shingles of both texts and make the first
    classes. Then texts that share a band of minwise hashes are a run; pairs of 0.8 do in 9,999 of 10,000 cases. Rounds follow: in each run a minimum spanning forest of the
    classes so far, by differing hashes, gives candidates, each verified as before, so no link below the threshold counts. Pairs that
    fail are left out of later rounds, which go on as long as they find links. A run that has become one class, or has no candidates left, never gets new ones: later rounds don't read
    it. Equal sets of shingles are one node; texts without words are one,
    too. A text that only null ids have is linked with none but its equals. Other rows as with simhash_groups.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    prints = stage(rows.mapInArrow(_minwise_scan(words), "doc_id long, text_key long, shingles binary, fp long, sketch binary, keys array<long>"), "prints")
    nodes = prints.groupBy("shingles").agg(
        F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("one")
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers stay as they are stored
    sets = stage(prints.select("doc_id", "text_key", "shingles"), "sets")
    unstage(prints)
    named = nodes.where("one IS NOT NULL")
    pairs = _fingerprint_pairs(named)
    runs = _runs_of(named)
    asked = runs.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = stage(nodes.join(asked, "node", "left_semi").select("node", "sketch", "one.doc_id", "one.text_key"), "wanted")
    key = F.xxhash64("doc_id", "text_key")
    held = wanted.join(perhaps_known(rows, key, wanted, key, "wanted").where("wanted"), ["doc_id", "text_key"])
    texts = stage(held.dropDuplicates(["doc_id", "text_key", "node"]).select("node", "sketch", "text"), "texts")
    good = _alike(pairs, texts, words, similarity)
    classes = stage(connected_components(good), "classes")
    unstage(wanted, pairs, good)
    limit, failed = reach(similarity), []
    while True:
        known = stage(runs.join(classes, "node", "left").select("run", "node", F.coalesce("component", "node").alias("class")), "known")
        several = known.groupBy("run").agg((F.min("class") < F.max("class")).alias("several")).where("several").select("run")
        state = known.join(several, "run", "left_semi")
        if failed:
            tried = functools.reduce(DataFrame.unionByName, failed).groupBy("node").agg(F.collect_list("o").alias("failed"))  # one for each run and round at most
            state = state.join(tried, "node", "left")
        else:
            state = state.withColumn("failed", F.lit(None).cast("array<long>"))
        state = state.join(texts.select("node", "sketch"), "node").select("run", "node", "class", "sketch", F.coalesce("failed", F.array().cast("array<long>")).alias("failed"))
        found = stage(state.repartition("run").sortWithinPartitions("run", "node").mapInArrow(_forests(limit), "run long, node long, o long"), "found")
        edges = stage(found.select("node", "o", F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct(), "edges")
        good = _alike(edges.select("a", "b").distinct(), texts, words, similarity)
        over = good.isEmpty()
        if not over:
            failed.append(stage(edges.join(good, ["a", "b"], "left_anti").select("node", "o"), "failed"))
            more = stage(known.join(found.select("run").distinct(), "run", "left_semi").select("run", "node"), "members")
            merged = stage(connected_components(classes.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(good)), "classes")
            unstage(runs, classes)
            runs, classes = more, merged
        unstage(known, found, edges, good)
        if over:
            break
    labels = nodes.select("node", "shingles", "first_id").join(classes, "node", "left").withColumn("root", F.coalesce("component", "node"))
    labels = stage(labels.select("shingles", "first_id", "root"), "labels")
    roots = stage(labels.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    known = stage(labels.join(roots, "root").select("shingles", "component_id"), "known")
    unstage(nodes, runs, texts, labels, roots, classes, *failed)
    return sets.join(known, "shingles").select("doc_id", "text_key", "component_id")
