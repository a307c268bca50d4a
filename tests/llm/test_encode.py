import random

import pytest

from phonoduct.llm.encode import decode, encode, encode_text

SCHEMA = "doc_id bigint, text string, k int, t string, ids int"


def texts(seed):
    r = random.Random(seed)
    parts = ["word", " it's", "don't", "  ", "\n\n", "\t", "12345", " 99", "こんにちは", "、", "Привет", "…", "<|endoftext|>", "!!!", "😀", " ", "  x", "é", "'re", "\r\n", "a" * 40, " " * 30, "-" * 25]
    return ["".join(r.choice(parts) for _ in range(r.choice([3, 200, 900]))) for _ in range(60)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 32), (200, 60), (16_384, 1_024)])
def test_ids_equal_those_of_the_whole_text(spark, vocabulary, chunk, overlap):
    t = texts(chunk) + ["x" * 1000, " " * 1000, "\n" * 500 + "end", "あ" * 700, "a b" * 400, "", None]
    df = spark.createDataFrame([(i, x, 1, "clash", 2) for i, x in enumerate(t)], SCHEMA)
    got = {r.doc_id: r.ids for r in encode(df, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: encode_text(x, vocabulary).tolist() if x else [] for i, x in enumerate(t)}


def test_round_trip(spark, vocabulary):
    t = texts(9)
    df = spark.createDataFrame([(i, x, 1, "", 2) for i, x in enumerate(t)], SCHEMA)
    assert {r.doc_id: r.text for r in decode(encode(df, chunk=128, overlap=64)).collect()} == dict(enumerate(t))


def test_special_strings_are_ordinary(spark, vocabulary):
    df = spark.createDataFrame([(1, "<|endoftext|>", 1, "", 2)], SCHEMA)
    ids = encode(df).collect()[0].ids
    assert 50256 not in ids and len(ids) > 1


def test_repeated_rows_null_keys_and_no_rows(spark, vocabulary):
    long = "some words " * 50
    df = spark.createDataFrame([(1, long, 1, "", 2)] * 3 + [(None, long, 1, "", 2), (None, None, 1, "", 2), (2, "", 1, "", 2)], SCHEMA)
    got = encode(df, chunk=100, overlap=50).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == sorted([(1, len(encode_text(long)))] * 3 + [(0, len(encode_text(long))), (0, 0), (2, 0)])
    assert encode(df.limit(0)).count() == 0
