"""Byte-level BPE against the tokenizer's own library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from motecraft.llm import byte_bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


ODD = [None, "", " ", "a", "x  y \n\n z", "don't we'll I'VE'd", "<|endoftext|>", "\x1c\x1d\x85   nbsp", "一二三 ٣٤ ½ ²", "𝒜𝒷 𝟙𝟚 😀😀 𐐀's", "é́ё҈", "�\x00\x00", "ab" * 3000, " " * 5000, "'s't" * 50, "՘ ࢏ \U00011de0"]


def test_pretokens_and_merges_equal_the_library(library):
    rng = random.Random(5)
    letters = "abc'  \n\t.sté中٣½😀𝒜́​　\x1c"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(800)]
    split, ranks = byte_bpe.splitter(P.PATTERN), byte_bpe.ranks_of(PATH)
    for text in texts:
        assert "".join(split(text)) == text
        assert [i for w in split(text) for i in byte_bpe.merged(w.encode(), ranks)] == library.encode_ordinary(text), text


def test_long_pretokens_take_little_time(library):
    rng = random.Random(6)
    word = "".join(rng.choices("abcdeé", k=60_000))
    assert byte_bpe.merged(word.encode(), byte_bpe.ranks_of(PATH)) == library.encode_ordinary(word)


def test_encode_and_decode_small_blocks_and_clashing_columns(spark, library):
    docs = spark.createDataFrame(list(enumerate(ODD * 2)), "doc_id long, text string").withColumns({c: F.lit("own") for c in ("row", "ids", "word", "block", "items", "codes", "content", "bytes", "id", "token")})
    encoded = byte_bpe.encode(docs.repartition(3), PATH, P.PATTERN, block=40)
    assert encoded.columns == ["row", "ids"] and encoded.select("row.*").columns == [c for c in docs.columns if c != "text"]
    got = {r["row"]["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(ODD * 2)}
    back = byte_bpe.decode(encoded, PATH).collect()
    assert {r["row"]["row"]["doc_id"]: bytes(r["bytes"]) for r in back} == {i: (t or "").encode() for i, t in enumerate(ODD * 2)}


def test_decode_nulls_unknown_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1, 0])], "k int, ids array<int>")
    tokens = {i: t for t, i in byte_bpe.ranks_of(PATH).items()}
    assert {r["row"]["k"]: bytes(r["bytes"]) for r in byte_bpe.decode(rows, PATH).collect()} == {1: b"", 2: b"", 3: tokens[0] + tokens[1] + tokens[0]}
    packed = rows.selectExpr("k", "CASE WHEN k = 3 THEN X'000000000100000000000000' END AS ids")
    assert {r["row"]["k"]: bytes(r["bytes"]) for r in byte_bpe.decode(packed, PATH).collect()} == {1: b"", 2: b"", 3: tokens[0] + tokens[1] + tokens[0]}
    with pytest.raises(Exception, match="60000"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "k int, ids array<int>"), PATH).collect()
    assert byte_bpe.decode(rows.where("k > 9"), PATH).collect() == []
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []
    assert byte_bpe.encode(spark.createDataFrame([("a b",)], "text string"), PATH, P.PATTERN).count() == 1


def test_query_equals_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    found = queries.op11_byte_bpe(spark, sf)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()} == want
    assert found.count() == len(docs) and dict(found.dtypes)["n_tokens"] == "bigint"
