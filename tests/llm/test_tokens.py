import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvidex.llm import tokens

NAMES = ["byte_bpe_50k", "byte_bpe_multi_50k"]
pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no vocabularies")
_CACHE: dict = {}


def both(name):
    if name not in _CACHE:
        import tiktoken

        path = os.path.join(tokens.TOKENIZER_DIR, f"{name}.tiktoken")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _CACHE[name] = tokens.Encoder(tokens.load_model(name)), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[name]


ODD = ["", " ", "\n\n  \t x", "<|endoftext|> <unk> </s> no piece", "▁a ▁", "x" * 30_000, "日本語の検索" * 2000, "IT'S we'RE they'll", "naïve café e\u0301", "👩\u200d💻🚀 𝒳𝒴", "0123456789" * 500, "a\u00a0b\u2003c\u200bd", "\x00\x01\x7f", "}{;\r\n\r\n   }"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("text", ODD)
def test_odd_texts(name, text):
    own, other = both(name)
    assert own.encode(text).tolist() == other.encode_ordinary(text)
    assert own.count(text) == len(own.encode(text))
    assert own.decode(own.encode(text)) == text


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    own, other = both("byte_bpe_50k")
    assert own.encode(text).tolist() == other.encode_ordinary(text) and own.decode(own.encode(text)) == text


def test_byte_letters():
    letters = tokens.byte_letters()
    assert len(set(letters.values())) == 256 and not any(c.isspace() for c in letters.values())
    assert tokens.from_letters(tokens.to_letters(bytes(range(256)))) == bytes(range(256))


def test_corpus(spark):
    rows = [(1, "Hello world", "k"), (2, "", "k"), (3, None, None), (1, "Hello world", "k"), (None, "  ", "k"), (5, "long " * 60_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("text_to_encode", F.lit(1))
    got = tokens.encode_corpus(docs).collect()
    own, _ = both("byte_bpe_50k")
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), own.encode(t).tolist()) for i, t, _ in rows)
    assert dict(tokens.encode_corpus(docs).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    back = tokens.decode_corpus(tokens.encode_corpus(docs)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def test_test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, other = both("byte_bpe_50k")
    want = {r["doc_id"]: other.encode_ordinary(r["text"] or "") for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs).collect()} == want
