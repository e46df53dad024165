"""Each operator against a brute-force version, on the small tables and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from corpuslens.llm import chat_format, common, decontamination, embedding_dedup, line_dedup, lm_scoring, packing, quality, simhash_dedup, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "two words"), (6, "x " * 3000 + "end"), (7, "x " * 3000 + "end"), (8, "a b\x85c é <|im_end|> \\ <|"), (-9, "one")]


def texts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    return list(zip(table["doc_id"].tolist(), table["text"].tolist(), strict=True))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Shared helpers


def test_words_are_those_of_the_pattern():
    for _, text in AWKWARD:
        text = text or ""
        data, starts, ends = common.word_spans(text.encode())
        assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == WORD.findall(text)
    a, b = common.word_hashes(b"to be or  not to be"), common.word_hashes(b"be\nto")
    assert a[0] == a[4] == b[1] and a[1] == a[5] == b[0] and len(set(a.tolist())) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in common.connected_components(frame(spark, edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == components(nodes, edges)
    assert common.connected_components(frame(spark, [], "a long, b long")).count() == 0


# 1 substring dedup


def brute_substrings(rows, length):
    rows = [(d, WORD.findall(t or "")) for d, t in rows]
    low = {}
    for d, ws in rows:
        for k in range(len(ws) - length + 1):
            if d is not None:
                key = tuple(ws[k : k + length])
                low[key] = min(low.get(key, d), d)
    out = []
    for d, ws in rows:
        keep = [True] * len(ws)
        for k in range(len(ws) - length + 1):
            if d is not None and low[tuple(ws[k : k + length])] < d:
                keep[k : k + length] = [False] * length
        kept = " ".join(w for w, x in zip(ws, keep, strict=True) if x)
        out.append((d, len(ws), len(ws) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def same_rows(a, b):
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_substrings_of_documents_and_awkward_rows(spark, sf_dir):
    rows = texts(spark, sf_dir) + [(d if d is None else d + 10**6, t) for d, t in AWKWARD]
    out = substring_dedup.dedup_substrings(frame(spark, rows))
    same_rows([tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], brute_substrings(rows, 50))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substrings_of_repetitive_texts(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("ab" if k % 2 else "abcdefgh") for _ in range(r.randrange(40, 140))) for k in range(12)]
    rows = [(r.randrange(40), " ".join([*r.choices(pool, k=r.randrange(1, 4)), r.choice("xyz"), *r.choices(pool, k=1)])) for _ in range(60)]
    out = substring_dedup.dedup_substrings(frame(spark, rows), with_text=True)
    got = out.collect()
    same_rows([tuple(r)[:4] for r in got], brute_substrings(rows, 50))
    assert all(hashlib.sha256(" ".join(WORD.findall(x["kept_text"])).encode()).hexdigest() == x["kept_sha256"] for x in got)


def test_substrings_of_nothing(spark):
    assert substring_dedup.dedup_substrings(frame(spark, [])).collect() == []


# 2 decontamination


def test_edit_distance_is_exact():
    def plain(item, text):
        best = len(item)
        for a, b in itertools.combinations_with_replacement(range(len(text) + 1), 2):
            row = list(range(b - a + 1))
            for i, w in enumerate(item, 1):
                new = [i]
                for j, x in enumerate(text[a:b], 1):
                    new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
                row = new
            best = min(best, row[-1])
        return best

    r = random.Random(4)
    for _ in range(60):
        item, text = [r.randrange(4) for _ in range(r.randrange(1, 6))], [r.randrange(4) for _ in range(r.randrange(9))]
        distance, start, end = decontamination.edit_distance(item, text)
        assert distance == plain(item, text) and 0 <= start <= end <= len(text)


def test_leaks_reach_the_target_recall_and_no_more(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(words, k=r.randrange(8, 60)))) for k in range(60)] + [(900, "too short"), (901, None), (None, "a b c d e f")]
    docs, planted, clean = [], set(), set()
    for k in range(600):
        item_id, item = items[r.randrange(60)]
        passage, n = item.split(), len(item.split())
        edits = r.randrange(n // 5 + 1) if k % 3 else n // 2
        for at in r.sample(range(n), edits):
            passage[at] = r.choice([f"new{r.random()}", f"{passage[at]} extra{r.random()}", ""])
        docs.append((k, " ".join([*r.choices(words, k=r.randrange(200)), *passage, *r.choices(words, k=r.randrange(200))]).upper() + "."))
        (planted if k % 3 else clean).add((k, item_id))
    found = {(x["doc_id"], x["item_id"]): x for x in decontamination.find_leaks(frame(spark, docs + [(10**6, None), (10**6 + 1, "")]), frame(spark, items, "item_id long, text string")).collect()}
    assert len(planted & set(found)) >= 0.97 * len(planted)
    assert not clean & set(found)
    by_id = dict(docs), dict(items)
    for (d, i), x in found.items():  # each is verified
        ws = [decontamination.normal(w.encode()) for w in by_id[0][d].split()][x["start_word"] : x["start_word"] + x["n_words"]]
        item = [decontamination.normal(w.encode()) for w in by_id[1][i].split()]
        assert decontamination.edit_distance(item, ws)[0] == x["distance"] <= 0.2 * len(item)
    kept = decontamination.drop_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_leaks_without_items(spark):
    none = frame(spark, [], "item_id long, text string")
    assert decontamination.find_leaks(frame(spark, AWKWARD), none).count() == 0
    assert decontamination.drop_leaks(frame(spark, AWKWARD), none).count() == len(AWKWARD)
    assert decontamination.find_leaks(frame(spark, []), frame(spark, [(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_leaks_that_are_a_shortened_or_short_item_alone(spark):
    r = random.Random(8)
    items = [(k, " ".join(f"w{r.randrange(500)}" for _ in range(n))) for k, n in enumerate([5, 9, 10, 25, 40, 40, 60])] + [(90, "Two words"), (91, "one"), (92, "one"), (93, "- ..."), (94, "")]
    docs, expected = [], set()
    for k, text in items[:7]:
        words = text.split()
        for fewer in range(len(words) // 5 + 2):
            gone = set(r.sample(range(len(words)), fewer))
            docs.append((len(docs), " ".join(w for j, w in enumerate(words) if j not in gone)))
            distance = decontamination.edit_distance([hash(w) for w in words], [hash(w) for w in docs[-1][1].split()])[0]
            if distance <= len(words) // 5:
                expected.add((docs[-1][0], k, distance))
    docs += [(1000, "here are two WORDS, - yes"), (1001, "two"), (1002, "words two"), (1003, "no one."), (1004, "... two"), (1005, "words")]
    expected |= {(1000, 90, 0), (1003, 91, 0), (1003, 92, 0)}
    out = decontamination.find_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"], x["distance"]) for x in out} == expected and len(out) == len(expected)
    assert {(x["doc_id"], x["start_word"], x["n_words"]) for x in out if x["doc_id"] >= 1000} == {(1000, 2, 2), (1003, 1, 1)}
    few = decontamination.find_leaks(frame(spark, docs), frame(spark, items[7:], "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in few} == {(1000, 90), (1003, 91), (1003, 92)}


# 3 embedding near-dedup


def brute_vectors(rows):
    def good(e):
        return e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)

    out = {}
    for size in {len(e) for _, e, _ in rows if e}:
        out |= brute_vectors_of(rows, [k for k, (i, e, label) in enumerate(rows) if i is not None and label is not None and good(e) and len(e) == size])
    return [out.get(k, (i, 0, i, True)) for k, (i, _, _) in enumerate(rows)]


def brute_vectors_of(rows, ok):
    if not ok:
        return {}
    x = np.array([rows[k][1] for k in ok], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([rows[k][2] for k in ok])
    close = (x @ x.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(close, False)
    ids = [rows[k][0] for k in ok]
    part = components(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close), strict=True)])
    return {k: (rows[k][0], int(n), part[rows[k][0]], rows[k][0] == part[rows[k][0]]) for k, n in zip(ok, close.sum(axis=1), strict=True)}


@pytest.mark.parametrize("window", [1024, 16])
def test_vectors(spark, monkeypatch, window):
    monkeypatch.setattr(embedding_dedup, "WINDOW", window)
    r = np.random.default_rng(6)
    centres = r.standard_normal((30, 16))
    rows = [(k, (centres[r.integers(30)] + r.normal(0, s, 16)).astype(np.float32).tolist(), int(r.integers(2))) for k, s in enumerate(r.choice([0.05, 0.1, 0.3], 400))]
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # equal ones
    rows += [(3000 + k, (centres[0] + r.normal(0, 0.03, 16)).astype(np.float32).tolist(), 1) for k in range(100)]  # a run longer than a window of 16
    rows += [(4000 + k, (centres[k % 3][:9] + r.normal(0, 0.05, 9)).astype(np.float32).tolist(), 1) for k in range(60)]  # of another size
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None, *[1.0] * 15], 1), (2004, [1.0] * 3, 1), (2005, rows[0][1], None), (None, rows[0][1], 0), (2006, [], 0), (2007, [float("inf"), *[1.0] * 15], 0), (2008, [2 * x for x in rows[0][1]], rows[0][2])]
    out = embedding_dedup.embedding_groups(frame(spark, [(*x, "clash", -1) for x in rows], "vec_id long, embedding array<float>, label int, node string, rank int"))
    same_rows([tuple(x) for x in out.collect()], brute_vectors(rows))


def test_passes_reach_the_recall_at_the_threshold():
    """Pairs exactly at the threshold among many others, by sorting and windows alone: the share that some pass brings together."""
    r, size, n, window = np.random.default_rng(7), 32, 4000, 64
    x = r.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = r.standard_normal((n, size))
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    bits, passes = embedding_dedup.plan_passes(2 * n, 0.98, 0.99, window)
    both, found = np.concatenate([x, y]), np.zeros(n, bool)
    for _ in range(passes):
        signs = both @ r.standard_normal((size, embedding_dedup.HASHES)) > 0
        codes = signs @ (1 << np.arange(embedding_dedup.HASHES)[::-1])
        rank, prefix = np.argsort(np.argsort(codes, kind="stable")), codes >> (embedding_dedup.HASHES - bits)
        found |= (np.abs(rank[:n] - rank[n:]) <= window) | (prefix[:n] == prefix[n:])
    assert 4 < passes < 60 and found.mean() >= 0.985


def test_a_longer_vector_leaves_the_others_links(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0, 0.0], 1), (5, [1.0, 0.01, 0.0], 1), (6, [float("nan")] * 9, 1), (7, [1.0, 0.0], 2)]
    out = embedding_dedup.embedding_groups(frame(spark, rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, out)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True)]


def test_no_vectors(spark):
    assert embedding_dedup.embedding_groups(frame(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0


# 4 line dedup


def test_lines(spark):
    rows = [(k, "s" if k % 2 else None, f"menu\n\nline {k}\nmenu" if k < 30 else f"own {k}", "x") for k in range(60)] + [(100, "s", None, "x"), (101, "s", "", "x"), (102, "t", "menu", "x"), (103, "s", "menu", "x")]
    out = {x["doc_id"]: x for x in line_dedup.drop_boilerplate(frame(spark, rows, "doc_id long, source string, text string, n_lines string")).collect()}
    assert (out[1]["text"], out[1]["n_lines"], out[1]["n_dropped"]) == ("\nline 1", 4, 2)
    assert (out[2]["text"], out[2]["n_dropped"]) == ("menu\n\nline 2\nmenu", 0)
    assert (out[100]["text"], out[100]["n_lines"], out[101]["text"], out[101]["n_lines"]) == (None, 0, "", 1)
    assert (out[102]["text"], out[103]["text"]) == ("menu", "")
    same = line_dedup.drop_boilerplate(frame(spark, rows, "doc_id long, source string, text string, n_lines string"), counts=False)
    assert same.columns == ["doc_id", "source", "text", "n_lines"] and same.where("n_lines = 'x'").count() == len(rows)
    assert line_dedup.drop_boilerplate(frame(spark, [], "doc_id long, source string, text string")).count() == 0


def test_lines_with_clashing_columns_and_long_texts(spark):
    names = ["doc_id", "source", "text", "lines", "host", "drop", "page", "bad", "kept", "line", "hash"]
    rows = [(k, "s", f"menu\nown {k}" + "\nfiller" * (0 if k else 200_000), *"abcdefgh") for k in range(3)] + [(9, "one page", "menu\nmenu", *"abcdefgh")]
    out = line_dedup.drop_boilerplate(frame(spark, rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names)), ratio=0.5)
    assert out.columns == [*names, "n_lines", "n_dropped"]
    got = {x["doc_id"]: x for x in out.collect()}
    assert all(tuple(x)[3:11] == tuple("abcdefgh") for x in got.values())
    assert [(got[k]["text"][:10], got[k]["n_lines"], got[k]["n_dropped"]) for k in (0, 1, 2, 9)] == [("own 0\nfill", 200_002, 1), ("own 1", 2, 1), ("own 2", 2, 1), ("menu\nmenu", 2, 0)]


# 5 packing


def check_packed(rows, got, size=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % size + 1
        for piece, start in enumerate([0, *range(first, len(ids), size)]):
            part = ids[start : first if not piece else start + size]
            expected[d, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == expected
    bins = defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(x["length"] for x in got) / size


def test_packing(spark, sf_dir):
    rows = texts(spark, sf_dir) + AWKWARD + [(50, "two  spaces \n and <|endoftext|> \n \n x")]
    bins, least = check_packed(rows, packing.pack(frame(spark, rows), TOKENIZER).collect())
    assert bins <= math.ceil(least) + max(2, 0.02 * least)
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


def test_ids_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    tokenizer, encoder, r = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER), random.Random(12)
    letters = [*"abzAB'st 1.,!?-\n\n\t  é\x85\xa0　ñ漢🙂<|>\\\0\x1c", "<|endoftext|>", "  ", "'s", " the", "\r\n", ",", ". "]
    made = ["".join(r.choices(letters, k=r.randrange(25))) for _ in range(20_000)] + [None, "", " ", "\n", "word " * 400_000, "x" * 300_000]
    for k, (text, ids) in enumerate(zip(made, encoder.texts(pa.array(made)), strict=True)):
        assert ids == np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes(), (k, text)
    assert encoder.texts(pa.array([], pa.string())) == []
    assert encoder.texts(pa.array(["a", "b c", "d"]).slice(1, 1)) == encoder.texts(pa.array(["b c"]))


def test_batches_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": ["x" * 1000] * 49 + ["y" * 100_000]})
    got = list(common.batches([batch, batch.slice(0, 0)], 30, 10_000))
    assert pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
    assert all(b.num_rows == 1 or (b.nbytes <= 11_000 and b.num_rows <= 30) for b in got)


def test_plan_uses_every_piece_once():
    r = random.Random(8)
    for _ in range(20):
        counts = Counter(r.choice([r.randrange(1, 1025), r.randrange(1, 200), 1024]) for _ in range(2000))
        plan = packing.plan_bins(counts, 1024)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 1024 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts


# 6 chat formatting


def test_conversations_come_back(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "us\ner", "<|im_end|>\n<|im_start|>assistant\nno \\<|im_end|>\\"), (-8, 1, "assistant", "\\\\<|<\n|"), (-9, 5, None, None), (-9, 7, "assistant", None), (None, 1, "user", "x"), (None, None, "assistant", "y"), (-1, None, "user", "x"), (-1, -5, "user", "long " * 500_000)]
    messages = common.stage(chat_format.messages_of_turns(frame(spark, [(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, node string, k int")), "m")
    out = chat_format.format_paths(chat_format.best_paths(messages), messages)
    got = {x["root"]["conv_id"]: chat_format.read_back(x["formatted"]) for x in out.collect()}
    expected = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)):
        expected[c].append((role or "", text or ""))
    assert got == expected


def test_best_branches_of_trees(spark):
    r = random.Random(9)
    nodes = [(k, None if k < 5 else r.randrange(k), r.random()) for k in range(200)] + [(900, 12345, 0.5), (901, 900, None)]
    parent, score = {k: p for k, p, _ in nodes}, {k: s or 0.0 for k, _, s in nodes}
    parent[900] = None
    kids = set(parent.values())

    def way(k):
        return [*way(parent[k]), k] if parent[k] is not None else [k]

    best = {}
    for leaf in set(parent) - kids:
        path = way(leaf)
        rank = (-sum(score[k] for k in path) / len(path), -len(path), leaf)
        best[path[0]] = min(best.get(path[0], (rank, path)), (rank, path))
    got = defaultdict(list)
    for x in sorted(chat_format.best_paths(frame(spark, nodes, "node long, parent long, score double")).collect(), key=lambda x: x["depth"]):
        got[x["root"]].append(x["node"])
    assert got == {k: v[1] for k, v in best.items()}


def test_trees_with_cycles_and_repeated_nodes(spark):
    nodes = [(1, None, 1.0), (2, 1, 1.0), (2, 1, 9.0), (2, 7, 5.0), (3, 4, 1.0), (4, 3, 1.0), (5, 4, 1.0), (6, 6, 1.0), (None, 1, 99.0), (8, 2, None), (9, None, None), (9, 1, 3.0)]
    rows = chat_format.best_paths(frame(spark, nodes, "node long, parent long, score double"), keep=5).collect()
    assert sorted((x["root"], x["leaf"], x["node"], x["depth"]) for x in rows) == [(1, 8, 1, 0), (1, 8, 2, 1), (1, 8, 8, 2), (9, 9, 9, 0)]
    none = frame(spark, [], "node long, parent long, score double, role string, text string")
    assert chat_format.format_paths(chat_format.best_paths(none), none).count() == 0


# 7 SimHash


def plain_fingerprint(text, n):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bits", [4, 5])
def test_fuzzy_keys_meet_within_most_bits(bits):
    r = np.random.default_rng(10)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    for a in base.tolist():
        b = a
        for k in r.choice(64, bits, replace=False):
            b ^= 1 << int(k)
        rows, keys = simhash_dedup.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


@pytest.mark.parametrize("run", [16_384, 8])
def test_simhash_groups(spark, sf_dir, monkeypatch, run):
    monkeypatch.setattr(simhash_dedup, "RUN", run)
    r = random.Random(11)
    rows = texts(spark, sf_dir) + [(d if d is None else d + 10**6, t) for d, t in AWKWARD]
    words = rows[1][1].split()
    for k in range(120):  # a group of near copies
        rows.append((2 * 10**6 + k, " ".join(w if r.random() > 0.002 else "changed" for w in words)))
    got = [tuple(x) for x in simhash_dedup.simhash_groups(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()]
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    same_rows([x[:2] for x in got], [(d, f"{p:016x}") for (d, _), p in zip(rows, prints, strict=True)])
    ids = defaultdict(list)
    for (d, _), p in zip(rows, prints, strict=True):
        ids[p].append(d)
    f = np.array(list(ids), np.uint64)
    part = components(list(ids), [(int(a), int(f[j])) for k, a in enumerate(f) for j in np.flatnonzero(np.bitwise_count(f[:k] ^ a) <= 4)])
    low = {}
    for p, root in part.items():
        known = [d for d in ids[p] if d is not None]
        low[root] = min([*known, low.get(root, math.inf)])
    same_rows([(d, c) for d, _, c in got], [(d, None if low[part[p]] == math.inf else low[part[p]]) for (d, _), p in zip(rows, prints, strict=True)])


@pytest.mark.parametrize("run", [16_384, 8])
def test_groups_by_similarity(spark, monkeypatch, run):
    monkeypatch.setattr(simhash_dedup, "RUN", run)
    r = random.Random(15)
    rows = []
    for k in range(60):  # copies with some words changed, of similarities about 0.6 to 1
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        for n in range(r.randrange(1, 12)):
            rate = r.choice([0, 0.01, 0.02, 0.03, 0.06])
            rows.append((k * 100 + n, " ".join(w if n == 0 or r.random() >= rate else f"new{r.random()}" for w in words)))
    rows += [(d if d is None else d + 10**6, t) for d, t in AWKWARD]

    def shingles(text):
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    like = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    links = {(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and like(sets[i], sets[j])}
    true = components(list(range(len(rows))), links)
    got = {}
    for x in simhash_dedup.similar_groups(frame(spark, [(*x, "clash", 1) for x in rows], "doc_id long, text string, node string, key int")).collect():
        got.setdefault(x["doc_id"], x["component_id"])
    low = {}
    for k, root in true.items():
        if rows[k][0] is not None:
            low[root] = min(low.get(root, math.inf), rows[k][0])
    expected = {rows[k][0]: low[root] for k, root in true.items() if rows[k][0] is not None}
    assert set(got) == set(expected) | {None}
    by_id = {d: k for k, (d, _) in enumerate(rows)}
    for d, c in got.items():
        if d is not None:
            assert c <= d and true[by_id[c]] == true[by_id[d]]  # no group has what is below the threshold
    gone = [d for d, c in expected.items() if c != d]
    assert len(gone) > 150 and sum(got[d] != d for d in gone) >= 0.97 * len(gone) and sum(got[d] == expected[d] for d in gone) >= 0.95 * len(gone)


# 8 and 10 classifiers, 9 language models


@pytest.mark.parametrize("score,label,fold,rest,wanted", [(toxicity.score_toxicity, "toxic", 5, 0, 0.93), (quality.score_quality, "quality", 4, 2, 0.93)])
def test_classifiers_on_held_out_rows(spark, score, label, fold, rest, wanted):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(d).encode()) % fold == rest for d in out["doc_id"]]).all()
    held = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (held["predicted"] == held[label]).mean() >= wanted


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_on_awkward_rows(spark, score):
    labels = frame(spark, [(4, 1, 1), (5, 0, 0), (5, 1, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(*x, "clash", 1.0) for x in AWKWARD], "doc_id long, text string, label string, score double")
    assert score(docs, labels).where("score between 0 and 1").count() == len(AWKWARD)
    assert score(docs, labels.limit(0)).where("score between 0 and 1").count() == len(AWKWARD)
    assert score(docs.limit(0), labels).count() == 0


def test_toxicity_is_the_plain_sum_over_terms_and_pairs(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(150) for t in ("documents", "labels"))
    rows = texts(spark, sf_dir)[:60] + AWKWARD + [(77, "word " * 300_000 + "hate")]
    machine = toxicity.train(docs, labels, 5, 0)
    place = {int(b): k for k, b in enumerate(machine.terms)}
    assert len(place) == len(machine.terms) > 1000
    got = toxicity.with_score(frame(spark, [(*x, "clash", -1.0) for x in rows], "doc_id long, text string, terms string, score double"), machine).collect()
    expected = []
    for d, t in rows:
        core = {w.strip(toxicity.EDGES.decode()) for w in WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))} - {""}
        said = {f"={w}" for w in core} | {f"^{w[:k]}" for w in core for k in toxicity.PREFIXES if len(w) >= k}
        ks = sorted({place[b] for b in (xxhash.xxh64_intdigest(x, 5) >> 64 - toxicity.HASH_BITS for x in said) if b in place})
        v, w = machine.vectors[ks].astype(float) * machine.values[ks][:, None], machine.linear[ks].astype(float) * machine.values[ks]
        pairs = sum(float(v[i] @ v[j]) for i in range(len(ks)) for j in range(i)) if len(ks) < 300 else float(np.triu(v @ v.T, 1).sum())
        expected.append((d, t, 1 / (1 + math.exp(-(machine.bias + w.sum() + pairs)))))
    key = lambda x: (str(x[0]), str(x[1]))
    for a, b in zip(sorted(((x["doc_id"], x["text"], x["score"]) for x in got), key=key), sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)


def test_machine_learns_pairs_that_no_sum_of_weights_can(spark):
    r = random.Random(3)
    rows = []
    for k in range(3000):  # toxic where both words are there, and where neither is
        insult, group = r.random() < 0.5, r.random() < 0.5
        rows.append((k, " ".join(["insult"] * insult + ["group"] * group + r.choices(["the", "of", "and", "green", "tree"], k=5)), int(insult == group)))
    docs, labels = frame(spark, [x[:2] for x in rows]), frame(spark, [(k, y) for k, _, y in rows], "doc_id long, toxic int")
    out = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, labels).collect()}
    x = np.array([[1, "insult" in t, "group" in t] for _, t, _ in rows], float)
    linear = x @ np.linalg.lstsq(x, np.array([y for *_, y in rows]) - 0.5, rcond=None)[0] >= 0
    assert np.mean([linear[k] == y for k, _, y in rows]) < 0.8
    held = [k for k in out if out[k]["held_out"]]
    assert len(held) > 100 and np.mean([out[k]["predicted"] == rows[k][2] for k in held]) > 0.95


def test_ties_of_neighbours_go_to_the_smaller_ids(spark):
    """Forty texts alike, under ids dealt anyhow: the votes are those of the fifteen smallest ids."""
    r = random.Random(5)
    rows = [(d, "the same words again") for d in r.sample(range(10**6), 40)] + [(10**6 + k, f"quite another text{k}") for k in range(9)]
    labels = [(d, int(k % 3 == 0), 0) for k, (d, _) in enumerate(rows)]
    fitted = sorted((d, y) for d, y, _ in labels if zlib.crc32(str(d).encode()) % 4 != 2 and d < 10**6)[: quality.NEIGHBOURS]
    wanted = sum(y for _, y in fitted) / len(fitted)
    for parts in (1, 7):
        r.shuffle(rows)
        docs = frame(spark, rows).repartition(parts)
        got = {x["doc_id"]: x["score"] for x in quality.score_quality(docs, frame(spark, labels, "doc_id long, quality int, toxic int")).collect()}
        assert all(abs(got[d] - wanted) < 1e-9 for d, _ in rows if d < 10**6)


def test_quality_is_a_plain_vote_of_the_nearest(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, 4, 2)
    marked = {x["doc_id"]: x["quality"] for x in labels.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 4 != 2}
    rows = texts(spark, sf_dir)

    def plain(text):
        """Damped tf-idf of words and shapes, its length 1, projected and again of length 1."""
        bags = [Counter(), Counter()]
        for w in WORD.findall(text or ""):
            for bag, bucket in zip(bags, quality.buckets(w.encode()), strict=True):
                bag[bucket] += 1
        at, c = ([x for bag in bags for x in y(bag)] for y in (lambda b: list(b), lambda b: [1 + math.log(n) for n in b.values()]))
        v = np.array(c) * model.idf[at] if at else np.zeros(0)
        v = v / (np.linalg.norm(v) or 1) @ model.basis[at].astype(float) if at else np.zeros(model.basis.shape[1])
        return v / (np.linalg.norm(v) or 1)

    known = [(plain(t), marked[d]) for d, t in rows if d in marked]
    got = {x["doc_id"]: x["score"] for x in quality.score_quality(docs, labels).collect()}
    off = 0
    for d, t in rows:
        near = sorted(((float(v @ plain(t)), y) for v, y in known), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(s, 0) ** 2 for s, _ in near]
        score = sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight) if sum(weight) else np.mean([y for _, y in known])
        off += abs(got[d] - score) > 1e-3  # single precision may swap neighbours that are equally near
    assert off <= 0.02 * len(rows)


def test_scores_don_t_depend_on_other_columns(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels, 5, 0)
    a = toxicity.with_score(docs, machine).select("doc_id", "score").collect()
    b = toxicity.with_score(docs.selectExpr("doc_id", "text", "'zz' lang"), machine).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)


def test_lm_scores(spark):
    rows = [(1, "a b a b a b"), (2, "a b c"), (3, "c c c c"), (4, None), (5, ""), (None, "a b"), (2, "a b c")]
    got = {x["doc_id"]: x for x in lm_scoring.score_lm(frame(spark, rows), frame(spark, [(1,), (None,)], "doc_id long")).collect()}
    assert (got[4]["n_words"], got[4]["score"], got[5]["score"]) == (0, 0.0, 0.0)
    assert got[1]["score"] < got[2]["score"] < got[3]["score"]
    # The same by plain counting.
    counts = [Counter(), Counter()], [Counter(), Counter()]
    for d, t in rows:
        ws = (t or "").split()
        for k in (0, 1):
            if k or d == 1:
                counts[0][k].update(ws)
                counts[1][k].update(zip(["<s>", *ws], ws, strict=False))
    for d, t in [(1, rows[0][1]), (2, rows[1][1]), (3, rows[2][1])]:
        ws = t.split()
        for k, name in enumerate(("target_entropy", "background_entropy")):
            total = 0
            for h, w in zip(["<s>", *ws], ws, strict=False):
                alone = (counts[0][k][w] + 1) / (sum(counts[0][k].values()) + 5)
                heads = sum(n for (a, _), n in counts[1][k].items() if a == h)
                total -= math.log(0.4 * alone + (0.6 * counts[1][k][h, w] / heads if heads else 0))
            assert got[d][name] == pytest.approx(total / len(ws), rel=1e-5)
    assert lm_scoring.score_lm(frame(spark, []), frame(spark, [], "doc_id long")).count() == 0
    assert lm_scoring.score_lm(frame(spark, rows), frame(spark, [], "doc_id long")).count() == len(rows)


def test_lm_scores_count_rare_words_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 3_000)
    monkeypatch.setattr(lm_scoring, "BUCKET", 10_000)
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["the", "of", "and", f"rare{r.randrange(9000)}"]) for _ in range(r.randrange(300)))) for k in range(400)]  # most words are under 1 / 20,000
    target = {d for d, _ in rows if d % 3 == 0}
    words, pairs, heads = ([Counter(), Counter()] for _ in range(3))
    for d, t in rows:
        ws = t.split()
        for k in (0, 1):
            if k or d in target:
                words[k].update(ws)
                pairs[k].update(zip(["<s>", *ws], ws, strict=False))
                heads[k].update(["<s>", *ws][:-1] if ws else [])
    got = {x["doc_id"]: x for x in lm_scoring.score_lm(frame(spark, rows), frame(spark, [(d,) for d in target], "doc_id long")).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ws = t.split()
        for k, name in enumerate(("target_entropy", "background_entropy")):
            p = [0.4 * (words[k][w] + 1) / (words[k].total() + len(words[1]) + 2) + (0.6 * pairs[k][h, w] / heads[k][h] if heads[k][h] else 0) for h, w in zip(["<s>", *ws], ws, strict=False)]
            assert got[d][name] == pytest.approx(-sum(map(math.log, p)) / max(len(ws), 1), rel=1e-6)


# All that read texts


def test_very_long_texts_empty_tables_and_clashing_columns(spark):
    """Texts of many MB, whole; other columns whose names the operators use themselves; tables without rows."""
    r = random.Random(13)
    own = [" ".join(r.choice("abcdefgh") * r.randrange(60, 200) for _ in range(60_000)) for _ in range(2)]  # about 8 MB each
    assert all(len(t) > 7_000_000 for t in own)
    rows = [(1, own[0]), (2, own[1]), (3, own[0]), (4, "x y " + own[1]), (5, None), (6, "short one")]
    extra = ["tkey", "sha", "anchors", "spans", "fp", "key", "run", "text_key", "chunk", "ids", "hits", "label", "score", "y", "h"]
    docs = frame(spark, [(*x, *extra) for x in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    words = {d: WORD.findall(t or "") for d, t in rows}
    out = {x["doc_id"]: x for x in substring_dedup.dedup_substrings(docs).collect()}
    assert [(out[d]["n_words"], out[d]["n_removed"]) for d in sorted(out)] == [(60_000, 0), (60_000, 0), (60_000, 60_000), (60_002, 60_000), (0, 0), (2, 0)]
    assert out[4]["kept_sha256"] == hashlib.sha256(b"x y").hexdigest()
    prints = {x["doc_id"]: x for x in simhash_dedup.simhash_groups(docs).collect()}
    assert prints[1]["fingerprint"] == f"{plain_fingerprint(own[0], 4):016x}" and prints[3]["component_id"] == 1 and prints[4]["component_id"] == 2
    items = frame(spark, [(7, " ".join(words[2][-20:])), (8, " ".join(words[1][:12]))], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"], x["start_word"], x["distance"]) for x in decontamination.find_leaks(docs, items).collect()} >= {(1, 8, 0, 0), (3, 8, 0, 0), (2, 7, 59_980, 0), (4, 7, 59_982, 0)}
    assert decontamination.drop_leaks(docs, items).columns == docs.columns
    scored = {x["doc_id"]: x for x in lm_scoring.score_lm(docs, frame(spark, [(1,)], "doc_id long")).collect()}
    assert scored[4]["n_words"] == 60_002 and scored[1]["score"] < scored[2]["score"] and scored[1]["score"] == scored[3]["score"]
    labels = frame(spark, [(d, d % 2, d % 2) for d in range(1, 7)], "doc_id long, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality.score_quality):
        assert score(docs, labels).where("score between 0 and 1").count() == 6
    none = docs.limit(0)
    assert simhash_dedup.simhash_groups(none).count() == lm_scoring.score_lm(none, frame(spark, [], "doc_id long")).count() == 0
    assert packing.pack(none, TOKENIZER).count() == substring_dedup.dedup_substrings(none).count() == decontamination.find_leaks(none, items).count() == 0


def test_hot_anchors_lines_and_lengths(spark):
    """A passage, a line, a length and a source that a third of all rows share."""
    r = random.Random(14)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for k in range(300):
        mine = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(30, 90))]
        if k % 3 == 0:  # now and then a word of it is another one
            said = [w if r.random() > 0.01 else f"q{r.randrange(5)}" for w in passage]
            at = r.randrange(len(mine))
            mine = mine[:at] + said + mine[at:]
        rows.append((k, " ".join(mine)))
    got = substring_dedup.dedup_substrings(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same_rows([tuple(x) for x in got], brute_substrings(rows, 50))
    pages = frame(spark, [(k, "hot" if k % 3 else f"s{k}", f"menu\nown {k}") for k in range(900)], "doc_id long, source string, text string")
    out = line_dedup.drop_boilerplate(pages)
    assert out.where("source = 'hot' and text = concat('own ', doc_id)").count() == 600 and out.where("source <> 'hot' and n_dropped = 0").count() == 300
    same = [(k, "word") for k in range(900)] + [(k, "word " * k) for k in range(900, 960)]
    check_packed(same, packing.pack(frame(spark, same), TOKENIZER).collect())


def test_blocks_of_items_find_what_one_block_finds(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = [sorted(map(tuple, decontamination.find_leaks(docs, items, block=n).collect())) for n in (5000, 13)]
    assert found[0] == found[1] != []
    assert sorted(x["doc_id"] for x in decontamination.drop_leaks(docs, items, block=13).collect()) == sorted(x["doc_id"] for x in decontamination.drop_leaks(docs, items).collect())


def test_items_with_one_stem_against_texts_that_repeat_it(spark):
    """Places of a common stem aren't multiplied by the items that share it."""
    import time

    r = random.Random(31)
    stem = [f"stem{k}" for k in range(11)]
    items = [(k, " ".join(stem + [f"w{r.randrange(40_000)}" for _ in range(39)])) for k in range(2000)]
    text = " ".join(" ".join(stem) + " and more" for _ in range(3400))
    began = time.time()
    found = decontamination.Items(items, 0.8)
    rows = decontamination._found(found, pa.array([text, text + " " + items[7][1], items[9][1], None]))
    assert sorted((d, k, e) for d, k, e, *_ in rows) == [(1, 7, 0), (2, 9, 0)]
    assert time.time() - began < 60


@pytest.mark.parametrize("size", [10, 25, 50, 100, 300])
def test_recall_at_the_distance_limit(size):
    """Each text holds an item with as many edits as are allowed, of one kind or mixed."""
    r = random.Random(size)
    items = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(size))) for k in range(60)]
    texts = []
    for _, item in items:
        words = item.split()
        kinds = r.choice(["i", "d", "r", "idr"])
        for _ in range(size // 5):
            at = r.randrange(len(words))
            kind = r.choice(kinds)
            words[at : at + (kind != "i")] = [f"new{r.random()}"] * (kind != "d")
        texts.append(" ".join([f"x{r.random()}" for _ in range(200)] + words + [f"y{r.random()}" for _ in range(200)]))
    rows = decontamination._found(decontamination.Items(items, 0.8), pa.array(texts))
    assert len({(d, k) for d, k, *_ in rows if d == k}) >= 58 and all(d == k for d, k, *_ in rows)
