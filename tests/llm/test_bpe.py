"""Byte-level BPE against the tokenizer library, and by round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm.bpe import Encoder, Utf8Stream, decode_stream, encode_documents, encoder, token_digests

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ENC = encoder(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_like_the_library(text):
    ids = [i for m in regex.findall(PATTERN, text) for i in ENC.encode(m.encode())]
    assert ids == LIBRARY.encode_ordinary(text)
    assert "".join(decode_stream(ids, ENC.bytes_of)) == text


def test_long_repeats_and_few_states():
    small = Encoder(ENC.ranks, max_states=5)
    for piece in ("a" * 700, "ab" * 300, " " + "the" * 90, "é" * 200, "日本語" * 30):
        assert small.encode(piece.encode()) == LIBRARY._encode_single_piece(piece.encode())


@pytest.mark.parametrize("data", [b"a\xff\xc3\xa9", b"\xe0\x80x", b"\xf0\x9f\x91", "日本👍".encode(), b"\xed\xa0\x80"])
def test_utf8_stream(data):
    for size in (1, 2, 5):
        s = Utf8Stream()
        got = "".join(s.feed(data[i:i + size]) for i in range(0, len(data), size)) + s.close()
        assert got == data.decode("utf-8", "replace")


def test_documents(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "it's\n\n  two  ", "x" * 5000, "".join(rng.choice("aé 日\n'9.") for _ in range(20000))]
    df = spark.createDataFrame([(i % 4, t, "7") for i, t in enumerate(texts)], "doc_id int, text string, decoded string")
    got = sorted(map(tuple, token_digests(df, PATH, PATTERN).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i % 4, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want)
    rows = encode_documents(df, PATH, PATTERN).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["token_ids"] == LIBRARY.encode_ordinary(r["text"] or "") for r in rows)
    assert token_digests(df.limit(0), PATH, PATTERN).count() == 0
