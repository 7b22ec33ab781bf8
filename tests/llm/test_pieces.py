from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from trajecta.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = " ▁a\n\t<s>éß梦\x00​the   ing😀x"


def rows(n=300):
    r = random.Random(3)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    return [*texts, "", None, "x" * 5000, " " * 300, "word " * 4000, "same", "same"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_segments_equal_the_library(text):
    v = pieces.vocabulary(PATH)
    ids = [i for c in v.chunks(text) for i in v.segment(c)]
    assert ids == LIBRARY.encode(text)
    assert v.decode(ids) == LIBRARY.decode(ids)
    heap = [v.merged(c) for c in v.chunks(text)]
    assert sum(initial - removed for _, initial, removed in heap) == len(ids)


def test_counts(spark):
    data = list(enumerate(rows()))
    got = {r["doc_id"]: r for r in pieces.count_tokens(spark.createDataFrame(data, "doc_id long, text string"), PATH).collect()}
    for i, t in data:
        assert got[i]["n_tokens"] == len(LIBRARY.encode(t or ""))
        assert got[i]["n_bytes"] == len((t or "").encode())


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, "z")], "doc_id long, text string, n_tokens int, ids string")
    assert pieces.count_tokens(df, PATH).columns == ["doc_id", "text", "ids", "n_bytes", "n_tokens"]
    assert pieces.encode_decode(df, PATH).first()["decoded"] == "a b"


def test_encode_and_decode(spark):
    data = list(enumerate(rows()))
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = pieces.encode_decode(df, PATH, digests=True)
    for r in out.collect():
        ids = LIBRARY.encode(data[r["doc_id"]][1] or "") + [LIBRARY.eos_id()]
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == LIBRARY.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    back = pieces.decode(out.select("doc_id", "ids"), PATH)
    assert all(r["decoded"] == LIBRARY.decode(list(r["ids"])) for r in back.collect())


@pytest.mark.parametrize("f", [pieces.count_tokens, pieces.encode_decode])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
