import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinograph.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.RANK_FILE), reason="no rank file")


@pytest.fixture(scope="module")
def tokenizer():
    with open(T.RANK_FILE, "rb") as file:
        return T.encoding(file.read())


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(T.RANK_FILE.replace(".tiktoken", ".json"))
    found.encode_special_tokens = True
    return found


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet=" \n\t \u0085\x1c'aste1.é中🎬", max_size=80), size=st.integers(1, 20))
def test_parts_of_long_texts_give_the_same_ids(tokenizer, text, size):
    parts = list(T.pieces(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in tokenizer.encode_ordinary(p)] == tokenizer.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=60))
def test_another_library_gives_the_same_ids(tokenizer, other, text):
    assert T.encode(tokenizer, text.encode()) == other.encode(text, add_special_tokens=False).ids


def test_tables(spark, monkeypatch):
    long = "A cook stirs the pot, doesn't she?  \n\n" * 6000
    texts = ["", None, " ", "\n\n", "a<|endoftext|>b", "naïve 中文 🎬🏽‍🍳", long, "x" * 100_000, "same", "same"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    monkeypatch.setattr(T, "BATCH_IDS", 50)
    found = {r.doc_id: r.ids for r in T.encode_texts(documents).collect()}
    with open(T.RANK_FILE, "rb") as file:
        plain = T.encoding(file.read())
    assert found == {k: plain.encode_ordinary(t or "") for k, t in enumerate(texts)}
    assert found[0] == found[1] == [] and 50256 not in found[4]
    assert T.not_restored(documents).count() == 0
    decoded = {r.doc_id: bytes(r.bytes) for r in T.decode_ids(T.encode_texts(documents)).collect()}
    assert decoded == {k: (t or "").encode() for k, t in enumerate(texts)}
    half = spark.createDataFrame([(1, found[5][:-1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.bytes and len(r.bytes) > 0 for r in T.decode_ids(half).collect()} == {1: True, 2: None}
    broken = spark.createDataFrame([(1, bytearray(b"ab\xff"))], "doc_id long, text binary")
    assert T.encode_texts(broken).first().ids == plain.encode_ordinary("ab�")
    assert T.encode_texts(documents.limit(0)).count() == 0
