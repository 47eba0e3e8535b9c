import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.llm.bpe import TOKENIZERS, Encoder, encoder
from darkslide.llm.encode import count_tokens, decode_ids, encode_texts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def other():
    found = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_public_library(other, text):
    own = encoder()
    assert own.encode(text) == other.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_long_and_special(other):
    for text in ("a" * 20_000, "<|endoftext|> x", " " * 500 + "y", "漢" * 3_000, "\r\n\t" * 50):
        assert encoder().encode(text) == other.encode(text, add_special_tokens=False).ids


def test_rank_file_gives_the_same():
    ranks = Encoder.load(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))
    for text in ("Hello wörld, 12345 it's", "速い茶色の狐", "🙂👩‍👧"):
        assert ranks.encode(text) == encoder().encode(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello world", "z"), (1, "Hello world", "z"), (2, "", None), (3, None, None), (None, " \n", None)], "doc_id bigint, text string, ids string")
    ids = encode_texts(df, "doc_id", "text")
    assert ids.count() == 5
    found = {r.doc_id: r.ids for r in ids.collect()}
    assert found[2] == found[3] == [] and len(found[1]) == 2 and found[None]
    assert {r.doc_id: r.text for r in decode_ids(ids, "doc_id").collect()} == {1: "Hello world", 2: "", 3: "", None: " \n"}
    assert {r.doc_id: r.tokens for r in count_tokens(df, "doc_id", "text").collect()} == {k: len(v) for k, v in found.items()}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
