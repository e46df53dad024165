"""Very long texts and vectors, hot keys and clashing columns of operators that other tests give small ones only."""

import random

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import common, embedding_dedup, lm_scoring, packing, simhash_dedup
from corpuslens.llm.common import release, stage
from tests.llm.test_operators import TOKENIZER, brute_vectors, check_packed, components, frame, same_rows


def test_long_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((3, 20_000))
    rows = [(k, (base[k % 3] + r.normal(0, 0.05 * (k % 4), 20_000)).astype(np.float32).tolist(), 1) for k in range(24)]
    same_rows([tuple(x) for x in embedding_dedup.embedding_groups(frame(spark, rows, "vec_id long, embedding array<float>, label int")).collect()], brute_vectors(rows))


def test_packing_of_long_texts_with_clashing_columns(spark):
    r = random.Random(2)
    rows = [(1, " ".join(f"w{r.randrange(10**6)}" for _ in range(300_000))), (2, "x" * 200_000), (2, "x" * 200_000), (3, "short"), (None, None)]
    names = ["piece", "start", "length", "share", "number", "sequence_id", "offset", "ids", "n"]
    docs = frame(spark, [(*x, *"abcdefghi") for x in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    check_packed(rows, packing.pack(docs, TOKENIZER).collect())


@pytest.mark.parametrize("word", ["same", "same other"])
def test_a_word_that_most_texts_are_made_of(spark, monkeypatch, word):
    monkeypatch.setattr(lm_scoring, "CHUNK", 5_000)
    monkeypatch.setattr(lm_scoring, "BUCKET", 1_000)
    rows = [(k, f"{word} " * 40) for k in range(900)] + [(1000 + k, f"rare{k} text") for k in range(300)]
    got = lm_scoring.score_lm(frame(spark, rows), frame(spark, [(k,) for k in range(50)], "doc_id long")).collect()
    scores = {x["doc_id"]: x["score"] for x in got}
    assert len(got) == 1200 and len({scores[k] for k in range(900)}) == 1 and scores[0] < min(scores[1000 + k] for k in range(300))


def test_near_copies_of_long_texts_and_large_groups(spark):
    """Texts of MBs, a group of near copies that holds a third of all rows, and texts that share a hot passage but are no copies."""
    r = random.Random(4)
    long = [f"w{r.randrange(10**5)}" for _ in range(300_000)]
    base, passage = [f"b{k}" for k in range(80)], [f"p{k}" for k in range(60)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-300]) + " end")]
    for k in range(300):
        words = list(base)
        words[r.randrange(80)] = f"new{k}"
        rows.append((100 + k, " ".join(words)))
        rows.append((1000 + k, " ".join([f"u{r.randrange(10**6)}" for _ in range(40)] + passage + [f"v{r.randrange(10**6)}" for _ in range(40)])))
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_groups(frame(spark, rows)).collect()}
    assert got[1] == got[2] == 1 and all(got[1000 + k] == 1000 + k for k in range(300))
    # Two of the group are alike to 0.77 or more; only those with changes near each other to 0.8, so the group is made of chains.
    near = [(d, {tuple(t.split()[k : k + 5]) for k in range(76)}) for d, t in rows if 100 <= d < 1000]
    part = components([d for d, _ in near], [(d, e) for d, x in near for e, y in near if d < e and len(x & y) >= 0.8 * len(x | y)])
    assert {d: got[d] for d, _ in near} == part and len(set(part.values())) < 20


def test_freed_memory_goes_back():
    """What a driver or a worker used for one step isn't held on to in the next ones."""
    me = psutil.Process()
    pins, held = [], []
    for _ in range(300_000):
        held.append(np.empty(60))
        if len(held) % 1000 == 0:
            pins.append(np.empty(60))  # what is left after it keeps the heap from shrinking by itself
    used = me.memory_info().rss
    held.clear()
    release()
    assert used - me.memory_info().rss > 100_000_000 and pins


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Without bands the nearest copies are still found; texts whose fingerprints are near are no copies below the threshold."""
    real = simhash_dedup._runs_of
    monkeypatch.setattr(simhash_dedup, "_runs_of", lambda nodes: real(nodes.limit(0)))
    base = [f"b{k}" for k in range(1000)]
    rows = [(7, " ".join(base)), (8, " ".join([*base, "end"])), (9, "start " + " ".join(base))]
    rows += [(20, "x y z"), (21, "x y z v w u"), (22, "other words of a text"), (23, ""), (24, None)]
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_groups(frame(spark, rows)).collect()}
    assert got == {7: 7, 8: 7, 9: 7, 20: 20, 21: 21, 22: 22, 23: 23, 24: 23}
    every = lambda nodes: simhash_dedup.stage(nodes.select(F.col("node").alias("a")).join(nodes.select(F.col("node").alias("b")), F.col("a") < F.col("b")), "pairs")
    monkeypatch.setattr(simhash_dedup, "_fingerprint_pairs", every)
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_groups(frame(spark, rows)).collect()}
    assert got == {7: 7, 8: 7, 9: 7, 20: 20, 21: 21, 22: 22, 23: 23, 24: 23}


def test_rounds_read_only_runs_that_may_change(spark, monkeypatch):
    """Runs that are one class, or without candidates, are left out of later rounds."""
    r, sizes, plain = random.Random(6), [], simhash_dedup.stage

    def counted(df, name, *more):
        out = plain(df, name, *more)
        if name == "known" and "run" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash_dedup, "stage", counted)
    rows, n = [], 0
    for _ in range(60):  # groups of three texts that differ in a few of 200 words, so that they share bands; some links hold, some don't
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for _ in range(3):
            words = list(base)
            for _ in range(r.randrange(1, 8)):
                words[r.randrange(200)] = f"n{r.randrange(10**6)}"
            rows.append((n := n + 1, " ".join(words)))
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.similar_groups(frame(spark, rows)).collect()}
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(196)} for d, t in rows}
    links = [(d, e) for d in sets for e in range(d + 1, d + 3) if e in sets and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])]
    assert got == components(list(sets), links)
    assert len(sizes) > 1 and sizes[-1] < 0.9 * sizes[0], sizes


def shuffled(spark):
    """Bytes that this session's executors have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_near_dedup_shuffles_no_texts_without_candidates(spark):
    r = random.Random(23)
    texts = [" ".join(f"{r.getrandbits(48):x}" for _ in range(1500)) for _ in range(300)]
    rows = [(k, t, "clash", 1) for k, t in enumerate([*texts, texts[7] + " end", texts[9]])]
    docs = stage(frame(spark, rows, "doc_id int, text string, perhaps string, cell int"), "docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on tables that are large
    try:
        before = shuffled(spark)
        left = corpus_pipeline.drop_near_copies(spark, docs, None)
        assert left.columns == docs.columns
        assert sorted(x["doc_id"] for x in left.collect()) == [*range(300)]
        assert shuffled(spark) - before < 0.3 * sum(map(len, texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("spots", [1 << 15, 1 << 24])
def test_rows_perhaps_known(spark, monkeypatch, spots):
    monkeypatch.setattr(common, "SPOTS", spots)
    df = spark.range(60_000).selectExpr("id", "'x' as cell", "if(id % 5 = 0, null, id) as bits")
    known = spark.range(0, 60_000, 3).withColumn("spot", F.lit(1))
    got = common.perhaps_known(df, F.xxhash64("id"), known, F.xxhash64("id"), "flag")
    assert got.columns == ["id", "cell", "bits", "flag"]
    told = {x["known"]: (x["n"], x["yes"]) for x in got.groupBy((F.col("id") % 3 == 0).alias("known")).agg(F.count("*").alias("n"), F.count_if("flag").alias("yes")).collect()}
    assert told[True] == (20_000, 20_000) and told[False][0] == 40_000
    assert told[False][1] < 200 if spots > 1 << 15 else told[False][1] > 10_000
    assert common.perhaps_known(df, F.xxhash64("id"), known.where("id < 0"), F.xxhash64("id"), "flag").where("flag").isEmpty()
