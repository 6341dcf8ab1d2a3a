import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm.token_counts import counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "Hello world's best  test", "aaaaaaaaaaaaaaaaaaaaaaaa aaaa", "x" * 3000, "tab\t\there \t x\r\n\r\n y", "a \t \tb", "  lead", "trail  ", "\n\n\nx\n y \n",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "naïve café ¼ ² ３ 日本語 🙂🙂    x", "\x1c\x1d a\x1eb", "it's we're I'LL 'tis", "a\nb\nc d", "é" * 50, "ab " * 1000, "́e​﻿", "0123 45,67!!! ###***",
]


def test_same_as_library():
    lib = Tokenizer.from_file(PATH)
    got = [sum(1 if v is None else v for v in vs) for vs in counter(PATH).batch(TEXTS)]
    assert got == [len(e.ids) for e in lib.encode_batch(TEXTS, add_special_tokens=False)]


def test_every_code_point_class():
    lib = Tokenizer.from_file(PATH)
    texts = ["".join(f"a{chr(c)}b {chr(c)}1" for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in range(0, 0x3400, 256)]
    got = [sum(1 if v is None else v for v in vs) for vs in counter(PATH).batch(texts)]
    assert got == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(PATH)
    want = {r.doc_id: (len(r.text.encode()), len(lib.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, PATH).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "q"), (1, None, "q"), (None, "a b", None), (2, "", "")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(rows, PATH, limit=1).collect()), key=str)
    assert got == [(1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, True)]
    assert token_counts(rows.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_one_long_word(spark, n):
    lib = Tokenizer.from_file(PATH)
    text = "".join(chr(97 + (k * k * 7919 + k // 3) % 26) for k in range(n))
    assert sum(counter(PATH).batch([text])[0]) == len(lib.encode(text).ids)
