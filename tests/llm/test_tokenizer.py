import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.llm.tokenizer import encode_texts, encoder, vocabulary_path


@pytest.fixture(scope="module")
def public():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n  \t", "<|endoftext|>", "naïve ﬁnal Ａ１", "مرحبا", "a" * 5000, "ab" * 3000, "0123456789 " * 50, "​﻿", "🧪🧬" * 40, "x" * 20 + "!" * 700, " the" * 100, "\x00\x01", "don't I'LL we've", "é" * 30]


@pytest.mark.parametrize("text", ODD)
def test_odd(public, text):
    ids = encoder().encode(text)
    assert ids == public.encode_ordinary(text) and encoder().decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any(public, text):
    assert encoder().encode(text) == public.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text("aeinrst THE.,-", max_size=80))
def test_words(public, text):
    assert encoder().encode(text) == public.encode_ordinary(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_texts(df).collect())
    assert got == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert encode_texts(df.limit(0)).count() == 0
