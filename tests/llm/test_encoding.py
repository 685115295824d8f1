"""Encoding against the public tokenizers themselves."""

import random

import pytest

from quarrymill.llm import encoding as E
from quarrymill.llm.lexicon import Lexicon, compile_lexicon

DOC = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(E.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_lexicon_holds_exactly_its_words(tmp_path):
    random.seed(1)
    words = {bytes(random.choice(b"abc d") for _ in range(random.randint(1, 7))): [random.randint(0, 9) for _ in range(random.randint(1, 4))] for _ in range(800)}
    (tmp_path / "x").write_bytes(compile_lexicon(list(words.items())))
    lexicon = Lexicon(str(tmp_path / "x"))
    assert all(lexicon.ids(w) == tuple(i) for w, i in words.items())
    for _ in range(2000):
        w = bytes(random.choice(b"abc de") for _ in range(random.randint(0, 8)))
        assert (lexicon.ids(w) is None) == (w not in words)


def test_shared_suffixes_make_it_small():
    many = [(f"{a}{b}ing the same end".encode(), [1]) for a in "abcdefgh" for b in "abcdefgh"]
    states = int.from_bytes(compile_lexicon(many)[:4], "little")
    assert states < 30


def test_ids(spark, reference):
    texts = ["", None, "Hello world's  test\r\n\n  x", "<|endoftext|>", "日本語のテスト é́ 😀‍👩 ​﻿", "\x1c \x85\xa0  a", "   ", "a" * 5000, "12345 ½Ⅷ ²", "don't I'LL we've", "퟿", "x  \t y" * 300]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "c"), (3, "repeated id", "c")], DOC)
    got = [(r.doc_id, r.ids) for r in E.encode_documents(df, lexicon_words=5).collect()]
    assert len(got) == len(texts) + 2
    by = dict(got[: len(texts)])
    for i, t in enumerate(texts):
        want = reference(t) if t else []
        assert (by[i] if i != 3 else dict(x for x in got if x[0] == 3 and x[1] == want)[3]) == want
    assert E.encode_documents(df.limit(0)).count() == 0
    sizes = {r.doc_id: r.size for r in E.token_sizes(df.where("doc_id < 3")).collect()}
    assert sizes == {0: 0, 1: 0, 2: len(reference(texts[2]))}


def test_whole_table(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: r.ids for r in E.encode_documents(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert ids[r.doc_id] == (reference(r.text) if r.text else [])
