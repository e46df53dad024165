"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import bpe, queries
from tests.llm.test_operators import AWKWARD, frame, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(rows, plain=False):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain
    return [e.ids for e in t.encode_batch([x or "" for x in rows], add_special_tokens=False)], t


def ids_of(encoder, rows):
    return [memoryview(x).cast("I").tolist() for x in encoder.texts(pa.array(rows, pa.string()))]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_the_librarys(plain):
    r = random.Random(3)
    pool = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "<|endoftext|>", "1", "２", "՘", "Ᲊ", "!", "aaaa", "　", "\x85", "界", "😀", "the ", "\x00"]
    rows = ["".join(r.choice(pool) for _ in range(r.randrange(14))) for _ in range(4000)]
    rows += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(8)) for _ in range(4000)]
    assert ids_of(bpe.encoder(PATH, plain), rows) == library(rows, plain)[0]


def test_long_words_merge_as_short_ones(monkeypatch):
    r = random.Random(4)
    words = ["a" * n for n in (1, 2, 3, 63, 64, 65, 66, 4000)] + ["".join(r.choice("abetin ") for _ in range(r.randrange(1, 200))).replace(" ", "é") for _ in range(400)]
    e = bpe.RankArrays(PATH)
    assert [e.merge(w.encode()) for w in words] == library(words)[0]
    assert all(e._scan(w.encode()) == e._heap(w.encode()) for w in words)
    long = "ab" * 200_000
    assert e.merge(long.encode()) == library([long])[0][0]


def test_words_in_rows_merge_as_one_by_one():
    r = random.Random(11)
    words = [bytes(r.choice(b"aabetin \xc3\xa9th") for _ in range(r.randrange(1, width + 1))) for width in bpe.WIDTHS for _ in range(300)] + [b"a", b"aa", b"\0", b"\0\0a"]
    e = bpe.RankArrays(PATH)
    for width in bpe.WIDTHS:
        fit = [w for w in words if len(w) <= width]
        got = [memoryview(x).cast("I").tolist() for x in e._scan_rows(fit, width)]
        assert got == [e.merge(w) for w in fit]


def test_decoding_any_ids(spark):
    r = random.Random(5)
    rows = [(k, [r.randrange(50257) for _ in range(r.randrange(8))]) for k in range(300)] + [(300, None), (301, []), (302, [50256, -1, 60000, 220])]
    t = Tokenizer.from_file(PATH)
    got = {x["doc_id"]: x["text"] for x in bpe.decode(frame(spark, rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {k: t.decode([i for i in ids or [] if 0 <= i < 50257], skip_special_tokens=False) for k, ids in rows}


def plain_digests(rows):
    ids, t = library([x for _, x in rows])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted(((d, len(k), sha(",".join(map(str, k))), sha(t.decode(k, skip_special_tokens=False))) for (d, _), k in zip(rows, ids, strict=True)), key=repr)


def test_query_on_documents_and_awkward_rows(spark, sf_dir, tmp_path):
    assert sorted(map(tuple, queries.op12_bpe(spark, sf_dir).collect()), key=repr) == plain_digests(texts(spark, sf_dir))
    rows = [*AWKWARD, (9, "x" * 70_000), (10, "word " * 400_000), (11, "<|endoftext|>"), (None, None)]
    frame(spark, [(d, t, [1], "n") for d, t in rows], "doc_id long, text string, ids array<int>, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op12_bpe(spark, str(tmp_path)).collect()), key=repr) == plain_digests(rows)
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_bpe(spark, f"{tmp_path}/none").count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.RankArrays(public_tokenizers.path("word_bpe_49k.json"))
