"""Alignment of two tokenizers against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpuslens.llm import alignment, bpe, queries
from tests.llm.test_operators import AWKWARD, frame, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """All overlaps by testing byte ranges, groups by common ends."""
    t, s = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    a_bytes = bpe.token_bytes(A)
    b_bytes = [bytes([int(p[3:5], 16)]) if s.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, s.id_to_piece(k)) for k in range(s.vocab_size()))]
    found, counts = [], Counter()
    for d, x in rows:
        a = t.encode(" " + (x or ""), add_special_tokens=False).ids
        b = s.encode(x or "")
        want = (" " + (x or "")).encode()
        if not x or b"".join(a_bytes[k] for k in a) != want or b"".join(b_bytes[k] for k in b) != want:
            a, b = [], []
        ea, eb = np.cumsum([len(a_bytes[k]) for k in a]), np.cumsum([len(b_bytes[k]) for k in b])
        sa, sb = ea - [len(a_bytes[k]) for k in a], eb - [len(b_bytes[k]) for k in b]
        links, j = [], 0
        for i in range(len(a)):
            while j and sb[j] > sa[i]:
                j -= 1
            while eb[j] <= sa[i]:
                j += 1
            k = j
            while k < len(b) and sb[k] < ea[i]:
                links.append((a[i], b[k]))
                k += 1
        groups, i, j = [], 0, 0
        for e in sorted(set(ea.tolist()) & set(eb.tolist())):
            x, y = int(np.searchsorted(ea, e, "right")), int(np.searchsorted(eb, e, "right"))
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        counts.update(set(links))
        found.append((d, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    out = [(d, n, m, len(g), len(ls), sum(counts[x] == best[x[0]] for x in ls), sum(counts[x] for x in ls), sha(g)) for d, n, m, g, ls in found]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select(*alignment.OUT, "groups_sha256").collect()), key=repr)


def test_query_on_documents(spark, sf_dir):
    assert got(queries.op11_alignment(spark, sf_dir)) == plain(texts(spark, sf_dir))


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 50, 10_000])
def test_pieces_of_every_size_and_awkward_rows(spark, steps):
    r = random.Random(6)
    pool = ["hello", " ", "  ", "naïve", "\n", "<|endoftext|>", "</s>", "<0x41>", "界隈", "😀", "\t", "123456", "'s", "indivisible", "▁", "x", "\x00"]
    rows = [(k, "".join(r.choice(pool) for _ in range(r.randrange(12)))) for k in range(150)] + [(d, (t or None) and t[:300]) for d, t in AWKWARD] + [(900, "all the same words " * 60), (None, None), (901, " ")]
    docs = frame(spark, [(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_a int, piece string")
    assert got(alignment.align(docs, A, B, steps)) == plain(rows)


def test_a_very_long_text_goes_over_pieces(spark):
    r = random.Random(7)
    rows = [(1, " ".join(r.choice(["straße", "tokenisation", "of", "the", "\nunaligned", "界界"]) for _ in range(60_000))), (2, "y" * 30_000), (3, "short")]
    assert got(alignment.align(frame(spark, rows), A, B, 20_000)) == plain(rows)


def test_diagonals_are_the_merge():
    r = np.random.default_rng(8)
    for _ in range(200):
        a, b = (np.unique(r.integers(1, 60, r.integers(0, 30))) for _ in "ab")
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        at = np.arange(len(merged) + 1)
        assert alignment.diagonals(a, b, at).tolist() == [sum(s == 0 for _, s in merged[:k]) for k in at]


def test_words_apart_are_the_whole_text():
    r = random.Random(9)
    e = alignment.PieceEncoder(B)
    rows = [" ".join("".join(chr(r.choice([r.randrange(33, 127), r.randrange(0xA0, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randrange(1, 6))) for _ in range(5)) for _ in range(3000)]
    rows += ["".join(r.choice(["ab", " ", "\n", "▁", "é", "  ", "the"]) for _ in range(8)) for _ in range(3000)]
    assert e.texts(pa.array(rows)) == [e.whole(x) for x in rows]


def test_nothing(spark):
    assert alignment.align(frame(spark, []), A, B).count() == 0
